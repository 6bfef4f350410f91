"""Excerpts, advertisements, leaks of navigation, labels and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import vocab as v

# fixed values: phrases that open an advertisement
TRIGGERS = [r"this (?:message|episode|podcast) (?:comes|is brought) from", r"support for (?:this|the) (?:podcast|show|program|episode)", r"this episode is (?:sponsored|presented) by", r"brought to you by", r"(?:use|enter) (?:code|promo(?:code)?)\b", r"\bpromo ?code\b", r"terms (?:apply|and conditions apply)", r"slash podcast\b", r"(?:go to|visit) [a-z0-9-]+\.com[/\s]", r"\bpodcast\.com[/\s]", r"\bsponsor(?:ed)? (?:by|content)\b", r"\baffiliate (?:link|disclosure)\b"]
# fixed values: names of sponsors
BRANDS = ["schwab", "squarespace", "betterhelp", "expressvpn", "nerdwallet", "linkedin", "indeed", "audible", "hellofresh", "blinkist", "masterclass", "wix", "shopify", "raycon", "athletic greens", "ag1", "factor", "mint mobile", "dollar shave", "bombas", "brooklyn bedding", "casper", "helix", "eight sleep", "ritual", "calm", "headspace", "noom", "hims", "hers", "roman", "keeps", "quip", "nutrafol", "prose", "gusto", "freshbooks", "quickbooks", "notion", "monday", "asana", "zocdoc", "teladoc", "peloton", "whoop", "oura", "aura", "nordvpn", "surfshark", "cyberghost", "ghostbed", "purple", "dreamcloud", "betterment", "wealthfront", "sofi", "creditkarma", "identityguard", "lifelock", "aarp", "selectquote", "policygenius", "ladder", "babbel", "duolingo", "skillshare", "udemy", "coursera", "brilliant", "grammarly", "lastpass", "1password", "dashlane", "airtable", "hubspot", "salesforce", "zendesk", "intercom", "typeform"]
# fixed values: turns of phrase of advertisements
LEXICON = [r"\binvest(?:ing|ment|or|s)?\b", r"\bfinancial (?:planning|advisor|goal|freedom|wellness)\b", r"\blife stage\b", r"\bself.directed\b", r"\bwealth (?:management|building|advisor)\b", r"\bportfolio\b", r"\basset (?:management|allocation|class)\b", r"\bpromo(?:tion)?\b", r"\bdiscount code\b", r"\bexclusive (?:offer|deal|discount)\b", r"\bfree trial\b", r"\bfirst (?:month|order|box|shipment) free\b", r"\b(?:percent|%) off\b", r"\bsave \$?[\d]+\b", r"\bcoupon\b", r"\baffiliate\b", r"\bsponsored\b", r"\badvertisement\b", r"\bself.paced\b", r"\bsubscription (?:plan|box|service)\b", r"\bcheck out [a-z]+\.com\b", r"\blearn more at\b", r"\bsign up (?:at|for|today)\b", r"\bdownload (?:the app|now)\b", r"\bclick the link\b", r"\blink in (?:the )?(?:bio|description|show notes)\b", r"\bshow notes\b", r"\bno (?:commitment|contract) required\b", r"\bcancel anytime\b", r"\binvest your way\b", r"\bknow how\b", r"\bamount to invest\b", r"\bno matter your\b", r"\byour (?:financial|investing|retirement)\b"]
# fixed values: density of an advertisement, characters of an excerpt, share behind which a sentence's end is taken
AD_DENSITY, EXCERPT_CHARS, SENTENCE_SHARE = 5, 180, 0.4


def sponsor_density(text: Column) -> Column:
    """Two points for each brand, one for each turn of phrase, each counted once."""
    hits = [(r"\b" + b + r"\b", 2) for b in BRANDS] + [(p, 1) for p in LEXICON]
    # constant patterns, so each is compiled once
    return F.aggregate(F.array(*(F.when(text.rlike("(?i)" + p), n).otherwise(0) for p, n in hits)), F.lit(0), lambda a, b: a + b)


def is_ad(text: Column) -> Column:
    exact = text.rlike("(?i)(?:" + "|".join(TRIGGERS) + ")")
    return exact | (sponsor_density(text) >= AD_DENSITY)


def is_leaky(body: Column) -> Column:
    """Four links in the first 600 characters, or a skip link at the start."""
    b = F.coalesce(body, F.lit(""))
    return (F.regexp_count(F.substring(b, 1, 600), F.lit("<a ")) >= 4) | F.trim(b).rlike(r"(?i)^\s*<a[^>]*>skip to")


def strip(body: Column) -> Column:
    """Prose of a document with components: imports, code, tags and braces out."""
    b = F.coalesce(body, F.lit(""))
    for pattern, by in ((r"(?m)^import\s.+$", ""), (r"```[\s\S]*?```", ""), ("<[^>]+>", " "), (r"\{[^}]*\}", " "), (r"\s+", " ")):
        b = F.regexp_replace(b, pattern, by)
    return F.trim(b)


def _last(text: Column, mark: str) -> Column:
    """Characters before the mark's last place and one; 0 where it is missing."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at > 0, F.length(text) - at - len(mark) + 2).otherwise(0)


def excerpt(body: Column, most: int = EXCERPT_CHARS) -> Column:
    """The start of the prose: to the end of a sentence if that is far enough, else of a word, with an ellipsis."""
    p = strip(body)
    window, cut = F.substring(p, 1, most + 1), F.substring(p, 1, most)
    sentence = F.greatest(*(_last(window, m) for m in (". ", "? ", "! ")))
    word = _last(cut, " ") - 1
    whole = F.trim(F.substring(window, F.lit(1), sentence))
    part = F.concat(F.trim(F.substring(cut, F.lit(1), F.when(word > 0, word).otherwise(most))), F.lit("…"))
    return F.when(F.length(p) <= most, p).when(sentence - 1 > most * SENTENCE_SHARE, whole).otherwise(part)


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1e6, 1).cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.round(n / 1e3, 1).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def parse_reply(reply: Column) -> list[Column]:
    """score and topics of a model's reply; topics outside the vocabulary are left out."""
    bare = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(bare, "score double, topics array<string>")
    known = F.array(*map(F.lit, v.CHANNELS))
    return [parsed["score"].alias("score"), F.coalesce(F.filter(parsed["topics"], lambda t: F.array_contains(known, t)), F.array().cast("array<string>")).alias("topics")]
