"""Citation grounding, candidate sources, and data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions import sources, text
from feedloom.operators.graph import small

#: Domains of registered sources that may be broadcast.
DOMAINS = 200_000


def ungrounded(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    return citations.join(ledger.select("url").distinct(), "url", "left_anti")


def citation_stats(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per draft: citations by tier, share that the ledger knows (1 without citations), independent sources."""
    known = ledger.groupBy("url").agg(F.min("tier").alias("tier"), F.min("domain").alias("domain"), F.min("origin").alias("origin"))
    rows = citations.join(known, "url", "left")
    return rows.groupBy("draft").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "med", "low")), F.coalesce(F.try_divide(F.count_if(F.col("tier").isNotNull()).cast("double"), F.count("*").cast("double")), F.lit(1.0)).alias("grounded"), F.count_distinct(F.when(F.col("tier").isNotNull(), F.concat_ws("::", "domain", "origin"))).alias("independent")
    )


def claim_verdicts(claims: DataFrame, citations: DataFrame, ledger: DataFrame, drafts: DataFrame | None = None, coverage: float = 0.9, corroboration: float = 0.6) -> DataFrame:
    """Per draft, from claims (draft, claim, load_bearing, high_stakes), citations (claim, url) and the ledger (url, domain, origin): do they hold?

    coverage: the share of all claims that cite the ledger; corroboration: the share of load-bearing claims with two
    independent sources (different domain or origin), 1 without such claims; unknown: citations that the ledger lacks;
    risky: load-bearing claims of high stakes without two sources. A draft passes with both shares high enough and
    nothing unknown or risky; one without claims (drafts: all there are) doesn't.
    """
    known = ledger.groupBy("url").agg(F.min("domain").alias("domain"), F.min("origin").alias("origin")).withColumn("known", F.lit(True))
    cited = citations.join(known, "url", "left").groupBy("claim").agg(F.count_if("known").alias("backed"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_distinct(F.when(F.col("known"), F.struct("domain", "origin"))).alias("independent"))
    rows = claims.join(cited, "claim", "left").na.fill(0, ["backed", "unknown", "independent"])
    bearing, twice = F.col("load_bearing"), F.col("independent") >= 2
    agg = rows.groupBy("draft").agg(F.count("*").alias("n"), F.count_if(F.col("backed") > 0).alias("covered"), F.count_if(bearing).alias("k"), F.count_if(bearing & twice).alias("twice"), F.sum("unknown").alias("unknown"), F.count_if(bearing & F.col("high_stakes") & ~twice).alias("risky"))
    if drafts is not None:
        agg = drafts.select("draft").distinct().join(agg, "draft", "left").na.fill(0, ["n", "covered", "k", "twice", "unknown", "risky"])
    c = F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("n").cast("double")), F.lit(0.0))
    t = F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col("twice").cast("double"), F.col("k").cast("double")), F.lit(1.0)))
    return agg.select("draft", "n", c.alias("coverage"), t.alias("corroboration"), "unknown", "risky", ((F.col("n") > 0) & (c >= coverage) & (t >= corroboration) & (F.col("unknown") == 0) & (F.col("risky") == 0)).alias("passed"))


def frequent_domains(items: DataFrame, registered: DataFrame, least: int = 3) -> DataFrame:
    """(domain, seen): where items (url, source_type) of aggregators lead at least `least` times; sources and platforms are left out."""
    rows = items.where(F.col("source_type").isin(v.AGGREGATORS)).select(text.host(F.col("url")).alias("domain"))
    return _foreign(rows.groupBy("domain").agg(F.count("*").alias("seen")).where(F.col("seen") >= least), registered)


def mined_domains(items: DataFrame, registered: DataFrame, least_total: float = 0.0) -> DataFrame:
    """(domain, seen): domains that the bodies of items (id, url, body, total) link to, once an item; not the item's own, no sources, no platforms."""
    links = F.regexp_extract_all("body", F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), 1)
    hosts = F.array_distinct(F.transform(F.filter(links, lambda x: x.rlike("(?i)^https?://")), text.host))
    rows = items.where((F.coalesce("total", F.lit(0)) >= least_total) & F.col("body").isNotNull())
    rows = rows.select(text.host(F.col("url")).alias("own"), F.explode(hosts).alias("domain")).where(~F.col("domain").eqNullSafe(F.col("own")))
    return _foreign(rows.groupBy("domain").agg(F.count("*").alias("seen")), registered)


def _foreign(domains: DataFrame, registered: DataFrame) -> DataFrame:
    found = domains.where(F.col("domain").isNotNull()).where(~sources.is_ignored(F.col("domain")))
    return found.join(small(registered.where("domain is not null").distinct(), DOMAINS), "domain", "left_anti")


def merge_candidates(rows: DataFrame) -> DataFrame:
    """One candidate a domain: the first row's URL, all evidence, how often seen, the first feed that is known."""
    first_feed = F.min_by("feed_url", F.when(F.col("feed_url").isNotNull(), F.col("ord")))
    return rows.groupBy("domain").agg(F.min_by("url", "ord").alias("url"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.sum("seen").alias("seen"), first_feed.alias("feed_url"))


def appraised(candidates: DataFrame, appraisals: DataFrame) -> DataFrame:
    """Candidates with the last appraisal of their domain; rejected and unappraised ones drop out."""
    last = appraisals.groupBy("domain").agg(F.max_by(F.struct("decision", "trust"), "ord").alias("a"))
    return candidates.join(last, "domain").where("a.decision <> 'reject'").select("domain", "url", "feed_url", "a.decision", "a.trust")


def verdicts(candidates: DataFrame, registered: DataFrame, approve: float = 0.7, queue: float = 0.4) -> DataFrame:
    """(domain, decision, reason) of candidates (domain, url, feed_url, channels, trust): no feed, known domain (of the site or the feed) and
    no known channel are rejected, in this order; the others go by trust."""
    known = small(registered.select("domain").where("domain is not null").distinct(), DOMAINS)
    rows = candidates.withColumn("__feed", text.host(F.col("feed_url")))
    for name, column in (("__site_known", "domain"), ("__feed_known", "__feed")):
        rows = rows.join(known.select(F.col("domain").alias(column), F.lit(True).alias(name)), column, "left")
    valid = F.arrays_overlap("channels", F.array(*map(F.lit, v.CHANNELS)))
    t = F.col("trust")
    reason = F.when(F.col("feed_url").isNull(), "no-feed").when(F.coalesce("__site_known", "__feed_known", F.lit(False)), "duplicate").when(~F.coalesce(valid, F.lit(False)), "no-valid-channels").when(t >= approve, "auto-add").when(t >= queue, "queue-review").otherwise("low-trust")
    return rows.select("domain", F.when(reason == "auto-add", "add").when(reason == "queue-review", "queue").otherwise("reject").alias("decision"), reason.alias("reason"))


def violations(rows: DataFrame, key: str, rules: dict) -> DataFrame:
    """(key, rule) for each rule that a row breaks. A rule is a condition that holds for bad rows."""
    broken = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, rule): duplicate nodes, edges to unknown nodes, self loops, values that aren't positive."""
    name = F.concat_ws(">", F.col("a").cast("string"), F.col("b").cast("string"))
    twice = nodes.groupBy("node").count().where("count > 1").select(F.col("node").cast("string").alias("what"), F.lit("duplicate node").alias("rule"))
    known = nodes.select("node").distinct()
    loose = edges.join(known, edges["a"] == known["node"], "left_anti").union(edges.join(known, edges["b"] == known["node"], "left_anti")).distinct()
    return twice.union(loose.select(name, F.lit("unknown node"))).union(edges.where("a = b").select(name, F.lit("self loop"))).union(edges.where("value <= 0").select(name, F.lit("value not positive")))


def unregistered(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """Candidates (url) whose host is that of no registered source, by its url or its resolved_url; those without one drop out."""
    known = registered.select(F.explode(F.array(text.host(F.col("url")), text.host(F.col("resolved_url")))).alias("__host")).where("__host is not null").distinct()
    return candidates.withColumn("__host", text.host(F.col("url"))).where("__host is not null").join(small(known, DOMAINS), "__host", "left_anti").drop("__host")


def independent_sources(citations: DataFrame, ledger: DataFrame, by: str) -> DataFrame:
    """How many different (domain, origin) of the ledger are cited, by draft or claim."""
    known = ledger.groupBy("url").agg(F.min("domain").alias("domain"), F.min("origin").alias("origin"))
    return citations.join(known, "url").groupBy(by).agg(F.count_distinct("domain", "origin").alias("n"))


def generated(generators: dict[str, DataFrame]) -> DataFrame:
    """All candidates of all generators with origin, the generator's name; repeats stay, columns that one lacks are null there."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in generators.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
