"""Text and URL functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import vocab as v


def normalise_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def title_tokens(title: Column) -> Column:
    """Distinct words of the title without stopwords."""
    words = F.split(normalise_title(title), " ")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(v.STOPWORDS)))


def plain(text: Column) -> Column:
    """Markup out, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), r"[\t\n\x0B\f\r]\s*| \s+", " "))


def plain_words(p: Column) -> Column:
    """Words of a plain text: its single spaces and one."""
    return F.when(p == "", 0).otherwise(F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1)


def word_count(text: Column) -> Column:
    return plain_words(plain(text))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def read_minutes(text: Column, wpm: int = v.WORDS_PER_MINUTE) -> Column:
    return half_up(word_count(text) / wpm)


def has_full_text(text: Column) -> Column:
    return F.length(plain(text)) > v.FULL_TEXT_CHARS


def clean_summary(raw: Column, most: int = v.SUMMARY_CHARS) -> Column:
    """Plain text with entities resolved, cut at a word's end where that keeps over 60 %, with an ellipsis."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]*>", " ")
    # the ampersand comes last, so no entity is resolved twice
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{entity};"), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(text, 1, most)
    space = most - F.instr(F.reverse(cut), " ")  # characters before the last space; most if there is none
    at_word = (F.instr(cut, " ") > 0) & (space > most * 0.6)
    short = F.rtrim(F.when(at_word, F.substring(cut, F.lit(1), space)).otherwise(cut))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(short, F.lit("…")))


def slug(text: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, most), "-+$", "")


def host(url: Column) -> Column:
    """Lower-case host without www; null for what is no URL."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def registrable_domain(name: Column) -> Column:
    """The last two labels, or three where a country code stands behind a short label (co.uk)."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    country = (F.length(F.element_at(parts, -1)) == 2) & (n > 2) & F.get(parts, n - 2).isin("co", "com", "org", "net", "gov", "edu", "ac")
    return F.when(n <= 2, name).otherwise(F.array_join(F.slice(parts, F.when(country, n - 2).otherwise(n - 1), 3), "."))


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))


def iso_seconds(x: Column) -> Column:
    """Seconds of an ISO time in UTC; null for what is none."""
    return F.unix_seconds(F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def week_of(day: Column) -> Column:
    """The Monday of a day's week, both as day numbers."""
    return day - (day + 3) % 7


def group_of(channel: Column) -> Column:
    out = F
    for name, channels in v.GROUPS.items():
        out = out.when(channel.isin(channels), name)
    return out.otherwise("science")


def unsafe_reasons(html: Column) -> Column:
    """Names of the unsafe constructs that a piece of markup has."""
    rules = {"script": r"(?i)<script\b", "iframe": r"(?i)<iframe\b", "object": r"(?i)<(object|embed)\b", "style": r"(?i)<style\b", "form": r"(?i)<form\b", "handler": r"(?i)\son[a-z]+\s*=", "javascript-url": r"(?i)javascript:", "data-url": r"(?i)data:text/html"}
    return F.filter(F.array(*(F.when(html.rlike(r), k) for k, r in rules.items())), lambda x: x.isNotNull())


def match_score(label: Column, typed: Column) -> Column:
    """0 where the label begins with what is typed (or nothing is), 1 and a hundredth for each letter before it within, 2 where its
    letters come in this order, null elsewhere. Case doesn't count."""
    t, x = F.lower(label), F.lower(F.trim(typed))
    place = F.position(x, t)
    # letter by letter: each is looked for behind the one before
    left = F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), t, lambda rest, c: F.when(F.position(c, rest) > 0, F.substr(rest, F.position(c, rest) + 1)))
    return F.when((x == "") | (place == 1), 0.0).when(place > 1, 1 + (place - 1) / 100).when(left.isNotNull(), 2.0)


def is_degenerate(chunk: Column) -> Column:
    """Speech that says nothing: no words, under 30 % different words, or letters repeated over 7.2 times on average."""
    # fixed values: the share of different words, three times the ratio of letters
    w = F.filter(F.split(F.lower(F.coalesce(chunk, F.lit(""))), r"\s+"), lambda x: x != "")
    letters = F.filter(F.split(F.regexp_replace(F.coalesce(chunk, F.lit("")), r"\s", ""), ""), lambda x: x != "")
    return (F.size(w) == 0) | (F.size(F.array_distinct(w)) / F.size(w) < 0.3) | (F.size(letters) / F.size(F.array_distinct(letters)) > 7.2)


def paragraphs(cues: Column, most: int = 500) -> Column:
    """Cues (speaker, text) of a transcript, in order, as paragraphs (speaker, text).

    A cue of another speaker begins a paragraph, and so does what follows a paragraph of at least `most` characters;
    a cue without a speaker goes on with the one before. Blank paragraphs drop out.
    """
    kinds = "struct<speaker: string, text: string>"
    start = F.struct(F.array().cast(f"array<{kinds}>").alias("done"), F.get(cues, 0)["speaker"].alias("speaker"), F.lit("").alias("text"))

    def closed(s: Column) -> Column:
        return F.when(F.trim(s["text"]) == "", s["done"]).otherwise(F.array_append(s["done"], F.struct(s["speaker"].alias("speaker"), F.trim(s["text"]).alias("text"))))

    def step(s: Column, cue: Column) -> Column:
        other = cue["speaker"].isNotNull() & ~cue["speaker"].eqNullSafe(s["speaker"])
        words = F.coalesce(cue["text"], F.lit(""))
        speaker = F.when(other, cue["speaker"]).otherwise(s["speaker"])
        now = F.struct(F.when(other, closed(s)).otherwise(s["done"]).alias("done"), speaker.alias("speaker"), F.when(other | (s["text"] == ""), words).otherwise(F.concat(s["text"], F.lit(" "), words)).alias("text"))
        full = F.length(now["text"]) >= most
        return F.struct(F.when(full, closed(now)).otherwise(now["done"]).alias("done"), F.when(full, cue["speaker"]).otherwise(speaker).alias("speaker"), F.when(full, "").otherwise(now["text"]).alias("text"))

    return F.aggregate(cues, start, step, closed)
