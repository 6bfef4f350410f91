"""What speaks against drafts and libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import ground

# fixed values: words for each component at most; words from which a text with too few components is egregious
WORDS_PER_ISLAND, EGREGIOUS_WORDS, LEAST_ISLANDS = 1000, 1500, 2
# fixed value: share by which figures of one label may differ
FIGURE_SHARE = 0.0005


def tags(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("<([a-z][a-z0-9]*)"), 1))


def richness(drafts: DataFrame, islands: list[str]) -> DataFrame:
    """id, words, islands (different components of those named), words_per_island, rich, egregious."""
    rows = drafts.select("id", text.word_count(F.col("html")).cast("bigint").alias("words"), F.size(F.array_intersect(tags(F.col("html")), F.array(*map(F.lit, islands)))).cast("bigint").alias("islands"))
    w, i = F.col("words"), F.col("islands")
    return rows.select("id", w, i, F.try_divide(w.cast("double"), i.cast("double")).alias("words_per_island"), (w / F.greatest(i, F.lit(1)) <= WORDS_PER_ISLAND).alias("rich"), ((w >= EGREGIOUS_WORDS) & (i < LEAST_ISLANDS)).alias("egregious"))


def violations(drafts: DataFrame, known: list[str]) -> DataFrame:
    """(id, rule) for drafts (id, html, grounded): no title, not grounded, unknown components, unsafe markup."""
    html = F.coalesce("html", F.lit(""))
    unknown = F.transform(F.array_except(tags(F.col("html")), F.array(*map(F.lit, known))), lambda t: F.concat(F.lit("unknown component "), t))
    one = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    rules = F.concat(one(~html.rlike("(?i)<title"), "no title"), one(~F.col("grounded"), "not grounded"), unknown, one(F.size(text.unsafe_reasons(html)) > 0, "unsafe markup"))
    return drafts.select("id", F.explode(rules).alias("rule"))


def library_violations(slots: DataFrame, families: int = 3, least: int = 5) -> DataFrame:
    """(what, rule) for slots (slot, entry, family, body): entries with too few families or slots, citations in texts."""
    entries = slots.groupBy("entry").agg(F.count_distinct("family").alias("f"), F.count("*").alias("n"))
    few = F.filter(F.array(F.when(F.col("f") < families, "fewer than three families"), F.when(F.col("n") < least, "fewer than five slots")), lambda x: x.isNotNull())
    cited = slots.where(F.col("body").rlike(r"\[\d+\]")).select(F.col("slot").alias("what"), F.lit("citation in the text").alias("rule"))
    return entries.select(F.col("entry").alias("what"), F.explode(few).alias("rule")).union(cited)


def code_check(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(code, state) of all codes that are wanted or found: ok, missing, extra or duplicate."""
    a = wanted.select("code").distinct().withColumn("__wanted", F.lit(True))
    b = found.groupBy("code").agg(F.count("*").alias("__n"))
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__wanted").isNull(), "extra").when(F.col("__n") > 1, "duplicate").otherwise("ok")
    return a.join(b, "code", "full_outer").select("code", state.alias("state"))


def inconsistent_figures(texts: DataFrame, key: str) -> DataFrame:
    """(key, label, lo, hi): labels whose figures in the texts of a key differ materially. Extremes are enough, no pairs are made."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(r"([a-z]+) (\d+)"), 1).alias("label"), F.regexp_extract_all("text", F.lit(r"([a-z]+) (\d{1,15})"), 2).alias("n"))
    rows = texts.select(key, F.explode(pairs).alias("p")).select(key, "p.label", F.col("p.n").cast("double").alias("n"))
    spans = rows.groupBy(key, "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return spans.where((F.col("hi") - F.col("lo")) / F.greatest(F.abs("hi"), F.lit(1e-9)) > FIGURE_SHARE)


def verified(drafts: DataFrame, citations: DataFrame, ledger: DataFrame, claims: DataFrame, claim_citations: DataFrame, components: list[str], islands: list[str]) -> DataFrame:
    """One row a draft (id, html): ok, errors (sorted), and its figures.

    citations (draft, url) against the ledger (url, tier, domain, origin): n_cited, grounded, independent; words and
    islands of the text; claims (draft, claim, load_bearing, high_stakes) with their citations (claim, url): coverage and
    corroboration, for drafts that have claims. Errors are: broken rules of the text (a citation that the ledger lacks
    counts as not grounded), too few islands in a long text, claims that don't hold.
    """
    loose = ground.ungrounded(citations, ledger).select(F.col("draft").alias("id")).distinct().withColumn("__loose", F.lit(True))
    rows = drafts.join(loose, "id", "left").select("id", "html", F.col("__loose").isNull().alias("grounded"))
    broken = violations(rows, components).groupBy("id").agg(F.collect_list("rule").alias("broken"))
    rich = richness(rows, islands).select("id", "words", "islands", "egregious")
    cited = ground.citation_stats(citations, ledger).select(F.col("draft").alias("id"), F.col("n").alias("n_cited"), F.col("grounded").alias("grounded_share"), "independent")
    held = ground.claim_verdicts(claims, claim_citations, ledger).select(F.col("draft").alias("id"), "coverage", "corroboration", "passed")
    every = rows.select("id").join(broken, "id", "left").join(rich, "id").join(cited, "id", "left").join(held, "id", "left")
    one = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(F.coalesce("broken", F.array().cast("array<string>")), one(F.col("egregious"), "too few components"), one(F.coalesce(~F.col("passed"), F.lit(False)), "claims do not hold"))
    out = every.withColumn("errors", F.array_sort(errors)).na.fill(0, ["n_cited", "independent"]).na.fill(1.0, ["grounded_share"])
    return out.select("id", (F.size("errors") == 0).alias("ok"), "errors", "words", "islands", "n_cited", F.col("grounded_share").alias("grounded"), "independent", "coverage", "corroboration")
