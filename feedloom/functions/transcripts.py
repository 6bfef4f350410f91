"""Machine-made transcripts: loops of words, sentences, advertisements at the start and in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import prose

# fixed values: sizes of word groups that may loop, repeats that make a loop, lengths of real sentences and of an advertisement's rest
LOOP_WORDS, LOOP_REPEATS, REAL_CHARS, REST_CHARS = range(3, 8), 5, 40, 50
# fixed values: signals of real content in short sentences, and openings after an advertisement
SIGNALS = r"(?i)\b(?:today|this week|this episode|this story|last (?:week|month|year)|in \d{4}|we(?:'re)? (?:talking|discussing|exploring|looking)|I'?m (?:here|joined|talking)|welcome to|from (?:NPR|ABC|CBS|BBC|CNN|the new york times|the washington post)|it'?s (?:a story|the story)|it was|they were|she was|he was|the (?:story|question|issue|report|investigation)|heads up|warning|this (?:story|episode) contains|explicit|gun|violence|language)\b"
OPENINGS = r"(?i)^(?:today|now|let'?s|back|so |as we|welcome back|that said|heads up)\b"


def collapse_loops(text: Column) -> Column:
    """A group of 3 to 7 words that stands five times or more in a row, whatever its case, is kept once; shorter groups go first."""
    for n in LOOP_WORDS:
        group = r"\s+".join([r"(\S+)"] * n)
        again = "".join(rf"\s+\{k}" for k in range(2, n + 2)) + r"(?!\S)"
        # the repeats are possessive: a long loop takes no stack
        text = F.regexp_replace(text, rf"(?iu)(?<!\S)({group})(?:{again}){{{LOOP_REPEATS - 1},}}+", "$1")
    return text


def sentences(text: Column) -> Column:
    """Sentences, cut before a capital behind . ! ? and at line breaks; white space is made single."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: s != "")


def without_lead(marked: Column) -> Column:
    """Sentences (text, ad) from the first real one on: no advertisement, and long, with a signal, or not followed by one.

    Where there is none, all stay.
    """

    def real(s: Column, after: Column) -> Column:
        return ~s["ad"] & ((F.length(s["text"]) >= REAL_CHARS) | s["text"].rlike(SIGNALS) | ~F.coalesce(after["ad"], F.lit(False)))

    n = F.greatest(F.size(marked), F.lit(1))
    first = F.array_position(F.zip_with(marked, F.slice(marked, F.lit(2), n), real), F.lit(True))
    return F.slice(marked, F.greatest(first, F.lit(1)).cast("int"), n)


def without_ads(marked: Column) -> Column:
    """Sentences (text, ad) without advertisements, and without the short one behind each.

    A short sentence behind an advertisement goes with it, even if it is one itself, so it takes nothing further with it.
    Every sentence becomes a letter: A and B are advertisements (A short), C is a short other one, D a long one. Then a C
    goes (and becomes an x) behind a B and an even number of As, or behind an odd number of As that no B precedes.
    """
    short = lambda s: (F.length(s["text"]) <= REST_CHARS) & ~s["text"].rlike(OPENINGS)
    letters = F.array_join(F.transform(marked, lambda s: F.when(s["ad"], F.when(short(s), "A").otherwise("B")).when(short(s), "C").otherwise("D")), "")
    kept = F.split(F.regexp_replace(letters, r"(B(?:AA)*+|(?<![AB])A(?:AA)*+)C", "$1x"), "")
    texts = F.zip_with(marked, kept, lambda s, k: F.when(k.isin("C", "D"), s["text"]))
    return F.filter(texts, lambda t: t.isNotNull())


def cleaned(rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose raw transcripts have become prose: loops, leading advertisements, then those in between are taken out.

    Null and blank text give an empty string, and so does a rest of digits only or one with the arrow of a cue's time.
    The steps are columns of their own, so that Spark computes the sentences' marks once.
    """
    marked = F.transform(sentences(collapse_loops(F.coalesce(column, F.lit("")))), lambda s: F.struct(s.alias("text"), prose.is_ad(s).alias("ad")))
    steps = rows.withColumn("__marked", marked).withColumn("__marked", without_lead(F.col("__marked")))
    steps = steps.withColumn(column, F.array_join(without_ads(F.col("__marked")), " ")).drop("__marked")
    return steps.withColumn(column, F.when(F.col(column).rlike(r"^\d+$|-->"), "").otherwise(F.col(column)))
