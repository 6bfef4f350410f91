"""Queries on source health, discovery, grounding, world events, data quality and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import text
from feedloom.operators import analytics, graph, ground, health, world
from feedloom.plans import sql as q
from feedloom.plans.texts import _CITED_URL, _IGNORED, cited_url
from feedloom.sources.entities import items, outcomes, pick, registry, table
from feedloom.streaming import streams

_HOST = "nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\\.', ''), '')"


@query(q.with_(q.REGISTRY, q.OUTCOMES) + f""", j AS (SELECT r.*, o.ok, o.http_status, o.item_count, r.status = 'disabled' AS off, {q.PERMANENT} AS perm FROM registry r LEFT JOIN outcomes o ON o.id = r.id),
    k AS (SELECT *, coalesce(perm AND NOT off AND strikes + 1 >= 3, false) AS gone FROM j)
    SELECT id, CASE WHEN ok IS NULL THEN status WHEN ok THEN CASE WHEN item_count > 0 THEN 'active' ELSE 'dormant' END WHEN off OR gone THEN 'disabled' ELSE 'failing' END AS status,
      CASE WHEN ok IS NULL THEN enabled WHEN ok AND off THEN true WHEN NOT ok AND (off OR gone) THEN false ELSE enabled END AS enabled,
      CASE WHEN ok IS NULL OR (off AND NOT ok) THEN strikes WHEN ok THEN 0 WHEN perm THEN strikes + 1 ELSE strikes END AS strikes,
      CASE WHEN ok THEN NULL WHEN NOT ok AND (off OR gone) THEN {v.NOW} ELSE disabled_s END AS disabled_s, CASE WHEN ok THEN {v.NOW} ELSE last_ok_s END AS last_ok_s,
      CASE WHEN NOT ok THEN CASE WHEN perm THEN 'permanent' ELSE 'transient' END END AS last_error, gone AS rediscover FROM k""")
def stf_01_health(spark: SparkSession, sf: str) -> DataFrame:
    return health.reconcile(registry(spark, sf), outcomes(spark, sf), v.NOW)


@query(q.with_(q.REGISTRY) + f"SELECT id FROM registry WHERE NOT enabled AND status = 'disabled' AND (disabled_s IS NULL OR {v.NOW} - disabled_s >= {7 * v.DAY})")
def flt_14_reprobe(spark: SparkSession, sf: str) -> DataFrame:
    return health.reprobe_eligible(registry(spark, sf), v.NOW).select("id")


@query(q.with_(q.REGISTRY) + f"SELECT id, CASE WHEN strikes >= 3 THEN 'disable' ELSE 'flag-stale' END AS action FROM registry WHERE enabled AND (strikes >= 3 OR {v.NOW} - last_ok_s > {30 * v.DAY})")
def stf_03_prune(spark: SparkSession, sf: str) -> DataFrame:
    return health.prune(registry(spark, sf), v.NOW)


_CHANNELS = ", ".join(f"('{c}')" for c in [*v.CHANNELS, "none"])


@query(q.with_(q.REGISTRY) + f"SELECT c.channel, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled AND status = 'disabled') AS disabled, coalesce(array_to_string(list_sort(list_distinct(list({q.array(v.SOURCE_TYPES)}[n % 9 + 1]) FILTER (NOT enabled AND status = 'disabled'))), ','), '') AS lost_types, count(*) FILTER (enabled) < 2 AS underserved FROM (VALUES {_CHANNELS}) c(channel) LEFT JOIN registry r ON r.channel = c.channel GROUP BY c.channel")
def agg_25_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Where sources are missing: too few left in a channel, or lost by failures, with the lost types."""
    rows = registry(spark, sf).withColumn("type", pick(v.SOURCE_TYPES, F.col("n") % 9))
    gaps = analytics.channel_gaps(rows, spark.createDataFrame([(c,) for c in [*v.CHANNELS, "none"]], "channel string"))
    return gaps.withColumn("lost_types", F.array_join("lost_types", ","))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").where("page_id % 3 <> 0")
    n = F.col("page_id")
    return p.select("url", text.host(F.col("url")).alias("domain"), F.when(n % 3 == 1, "high").when(n % 2 == 0, "med").otherwise("low").alias("tier"), F.when(n % 5 == 0, "curated").otherwise("researched").alias("origin"))


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    """Ten citations a draft; four in a row are of one page."""
    pages, docs = table(spark, sf, "pages"), table(spark, sf, "documents")
    return docs.select(F.expr("doc_id div 10").alias("draft"), F.expr("doc_id div 4").alias("page_id")).join(pages.select("page_id", "url"), "page_id").select("draft", "url")


_CITED = f"""ledger AS (SELECT url, {_HOST} AS domain, CASE WHEN page_id % 3 = 1 THEN 'high' WHEN page_id % 2 = 0 THEN 'med' ELSE 'low' END AS tier, CASE WHEN page_id % 5 = 0 THEN 'curated' ELSE 'researched' END AS origin FROM pages WHERE page_id % 3 <> 0),
cited AS (SELECT CAST(doc_id // 10 AS BIGINT) AS draft, url FROM documents JOIN pages ON page_id = doc_id // 4)"""


@query(q.with_(_CITED) + "SELECT draft, url FROM cited WHERE url NOT IN (SELECT url FROM ledger WHERE url IS NOT NULL)")
def jon_09_ungrounded(spark: SparkSession, sf: str) -> DataFrame:
    return ground.ungrounded(_citations(spark, sf), _ledger(spark, sf)).select("draft", "url")


@query(q.with_(_CITED, "l AS (SELECT url, min(tier) AS tier, min(domain) AS domain, min(origin) AS origin FROM ledger GROUP BY url)") + "SELECT draft, count(*) AS n, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'med') AS med, count(*) FILTER (tier = 'low') AS low, round(count(tier) / count(*), 6) AS grounded, count(DISTINCT CASE WHEN tier IS NOT NULL THEN domain || '::' || origin END) AS independent FROM cited LEFT JOIN l USING (url) GROUP BY draft")
def agg_27_citations(spark: SparkSession, sf: str) -> DataFrame:
    return ground.citation_stats(_citations(spark, sf), _ledger(spark, sf)).withColumn("grounded", F.round("grounded", 6))


_CLAIMS = f"""led AS (SELECT url, min({q.REGISTRABLE.format(x='h')}) AS domain, min(CASE WHEN page_id % 2 = 0 THEN 'curated' ELSE 'researched' END) AS origin FROM (SELECT *, {_HOST} AS h FROM pages WHERE page_id % 40 <> 0) GROUP BY url),
    claim AS (SELECT doc_id AS claim, doc_id // 8 AS draft, doc_id % 3 <> 0 AS lb, doc_id % 10 = 0 AS hs, n_chars % 7 AS s FROM documents),
    cites AS (SELECT claim, url FROM (SELECT claim, (claim * 7 + unnest(range(CAST(s AS BIGINT))) * 13) % (SELECT count(*) FROM pages) AS page_id FROM claim) JOIN pages USING (page_id)),
    per AS (SELECT claim, count(l.url) AS backed, count(*) - count(l.url) AS unknown, count(DISTINCT CASE WHEN l.url IS NOT NULL THEN domain || '::' || origin END) AS ind FROM cites LEFT JOIN led l USING (url) GROUP BY claim),
    a AS (SELECT draft, count(*) AS n, count(*) FILTER (backed > 0) AS covered, count(*) FILTER (lb) AS k, count(*) FILTER (lb AND ind >= 2) AS twice, CAST(coalesce(sum(unknown), 0) AS BIGINT) AS unknown, count(*) FILTER (lb AND hs AND coalesce(ind, 0) < 2) AS risky FROM claim LEFT JOIN per USING (claim) GROUP BY draft)"""


@query(q.with_(_CLAIMS) + "SELECT draft, n, round(covered / n, 6) AS coverage, round(coalesce(twice / nullif(k, 0), 1.0), 6) AS corroboration, unknown, risky, covered / n >= 0.9::DOUBLE AND coalesce(twice / nullif(k, 0), 1) >= 0.6::DOUBLE AND unknown = 0 AND risky = 0 AS passed FROM a")
def agg_28_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Do the claims of drafts (eight documents each) hold against a ledger of pages?"""
    return ground.claim_verdicts(*_claims(spark, sf)).withColumns({"coverage": F.round("coverage", 6), "corroboration": F.round("corroboration", 6)})


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims, their citations, and the ledger; what is cited is spread over all pages."""
    n, p = F.col("doc_id"), table(spark, sf, "pages")
    docs = table(spark, sf, "documents")
    claims = docs.select(n.alias("claim"), F.floor(n / 8).alias("draft"), (n % 3 != 0).alias("load_bearing"), (n % 10 == 0).alias("high_stakes"))
    many = F.broadcast(p.agg(F.count("*").alias("pages")))  # one row
    named = docs.crossJoin(many).select(n.alias("claim"), F.explode(F.when(F.col("n_chars") % 7 > 0, F.transform(F.sequence(F.lit(0), (F.col("n_chars") % 7 - 1).cast("int")), lambda j: (n * 7 + j * 13) % F.col("pages")))).alias("page_id"))
    ledger = p.where("page_id % 40 <> 0").select("url", text.registrable_domain(text.host(F.col("url"))).alias("domain"), F.when(F.col("page_id") % 2 == 0, "curated").otherwise("researched").alias("origin"))
    return claims, named.join(p.select("page_id", "url"), "page_id").select("claim", "url"), ledger


@query(f"""WITH p AS (SELECT page_id, {_CITED_URL} AS url FROM pages), h AS (SELECT page_id, {_HOST} AS domain FROM p) SELECT domain, count(*) AS seen FROM h WHERE page_id % 3 < 2 AND domain IS NOT NULL AND NOT {_IGNORED.format(x='domain')} AND domain NOT IN (SELECT domain FROM h WHERE page_id % 60 = 5 AND domain IS NOT NULL) GROUP BY domain HAVING count(*) >= 3""")
def agg_22_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Domains that items of aggregators lead to again and again, without those that are sources already or platforms."""
    n = F.col("page_id")
    p = table(spark, sf, "pages").select(n, cited_url().alias("url"), F.when(n % 3 == 0, "hn").when(n % 3 == 1, "reddit").otherwise("rss").alias("source_type"))
    return ground.frequent_domains(p, p.where("page_id % 60 = 5").select(text.host(F.col("url")).alias("domain")), 3)


_CAND = f"cand AS (SELECT {_HOST} AS domain, page_id AS ord, url, CASE page_id % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'reddit' ELSE 'hn' END AS evidence, page_id % 4 + 1 AS seen, CASE WHEN page_id % 2 = 0 THEN url || '/feed' END AS feed_url FROM pages)"


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, sf, "pages").select(text.host(F.col("url")).alias("domain"), n.alias("ord"), "url", F.when(n % 3 == 0, "link").when(n % 3 == 1, "reddit").otherwise("hn").alias("evidence"), (n % 4 + 1).alias("seen"), F.when(n % 2 == 0, F.concat("url", F.lit("/feed"))).alias("feed_url"))


@query(q.with_(_CAND) + "SELECT domain, arg_min(url, ord) AS url, array_to_string(list_sort(list_distinct(list(evidence))), ',') AS evidence, CAST(sum(seen) AS BIGINT) AS seen, arg_min(feed_url, ord) FILTER (feed_url IS NOT NULL) AS feed_url FROM cand GROUP BY domain")
def agg_24_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ground.merge_candidates(_candidates(spark, sf)).withColumn("evidence", F.array_join("evidence", ","))


_APP = "app AS (SELECT domain, ord, CASE WHEN ord % 4 = 0 THEN 'reject' ELSE 'approve' END AS decision, (ord % 11) / 10.0::DOUBLE AS trust FROM cand WHERE ord % 5 <> 0)"


def _appraised(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf)
    appraisals = rows.where("ord % 5 <> 0").select("domain", "ord", F.when(F.col("ord") % 4 == 0, "reject").otherwise("approve").alias("decision"), (F.col("ord") % 11 / 10).alias("trust"))
    return ground.appraised(ground.merge_candidates(rows), appraisals)


@query(q.with_(_CAND, _APP) + "SELECT domain, url, decision, trust FROM (SELECT domain, arg_min(url, ord) AS url FROM cand WHERE domain IS NOT NULL GROUP BY domain) JOIN (SELECT domain, arg_max(decision, ord) AS decision, arg_max(trust, ord) AS trust FROM app GROUP BY domain) USING (domain) WHERE decision <> 'reject'")
def jon_15_appraisals(spark: SparkSession, sf: str) -> DataFrame:
    return _appraised(spark, sf).drop("feed_url")


_LADDER = """, a AS (SELECT domain, arg_max(decision, ord) AS decision, arg_max(trust, ord) AS trust FROM app WHERE domain IS NOT NULL GROUP BY domain),
    f AS (SELECT domain, arg_min(feed_url, ord) FILTER (feed_url IS NOT NULL) AS feed_url FROM cand WHERE domain IS NOT NULL GROUP BY domain),
    y AS (SELECT domain, trust, CASE WHEN feed_url IS NULL THEN 'no-feed' WHEN domain IN (SELECT domain FROM cand WHERE ord % 97 = 0 AND domain IS NOT NULL) THEN 'duplicate' WHEN length(domain) % 5 = 0 THEN 'no-valid-channels' WHEN trust >= 0.7::DOUBLE THEN 'auto-add' WHEN trust >= 0.4::DOUBLE THEN 'queue-review' ELSE 'low-trust' END AS reason FROM a JOIN f USING (domain) WHERE decision <> 'reject')"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on appraised candidates; a fifth of the domains, by their length, name no known channel."""
    channels = F.when(F.length("domain") % 5 == 0, F.array(F.lit("nonsense"))).otherwise(F.array(F.lit("nonsense"), F.lit("ai")))
    found = _appraised(spark, sf).withColumn("channels", channels)
    return ground.verdicts(found, _candidates(spark, sf).where("ord % 97 = 0"))


@query(q.with_(_CAND, _APP) + _LADDER + " SELECT domain, CASE reason WHEN 'auto-add' THEN 'add' WHEN 'queue-review' THEN 'queue' ELSE 'reject' END AS decision, reason FROM y")
def stf_04_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)


_AREAS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in t) + ")" for t in world.THEATERS)


@query(f"""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, (event_id % 181 - 90)::DOUBLE AS lat, (event_id * 7 % 361 - 180)::DOUBLE AS lng FROM events), a(theater, n, s, ea, w, st, en, status) AS (VALUES {_AREAS})
    SELECT event_id, min(theater) AS theater FROM e LEFT JOIN a ON lat BETWEEN s AND n AND lng BETWEEN w AND ea AND at_s >= st AND (en IS NULL OR at_s < en) AND status <> 'proposed' AND (status <> 'archived' OR en IS NOT NULL) GROUP BY event_id""")
def jon_12_theaters(spark: SparkSession, sf: str) -> DataFrame:
    from feedloom.sources.entities import seconds

    n = F.col("event_id")
    e = table(spark, sf, "events").select(n, seconds(F.col("ts")).alias("at_s"), (n % 181 - 90).cast("double").alias("lat"), (n * 7 % 361 - 180).cast("double").alias("lng"))
    return world.membership(e, world.theaters(spark)).select("event_id", "theater")


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS x, CASE c_custkey % 3 WHEN 0 THEN 'ci' WHEN 1 THEN 'se' ELSE 'none' END AS k FROM customer)
    SELECT c_custkey, round(CASE k WHEN 'ci' THEN x - 10 WHEN 'se' THEN x - 5 ELSE x END, 4) AS lo, round(CASE k WHEN 'ci' THEN x + 10 WHEN 'se' THEN x + 5 ELSE x END, 4) AS hi, round(CASE k WHEN 'ci' THEN x - 10 WHEN 'se' THEN x - 1.96::DOUBLE * 5 ELSE x END, 4) AS lo95, round(CASE k WHEN 'ci' THEN x + 10 WHEN 'se' THEN x + 1.96::DOUBLE * 5 ELSE x END, 4) AS hi95 FROM c""")
def prj_12_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """One standard error for the range mark, 1.96 for the readout."""
    n, x = F.col("c_custkey"), F.col("c_acctbal")
    k = F.when(n % 3 == 0, "ci").when(n % 3 == 1, "se").otherwise("none")
    ends = {z: world.readout(k, x, x - 10, x + 10, F.lit(5.0), z) for z in (1.0, 1.96)}
    return table(spark, sf, "customer").select("c_custkey", F.round(ends[1.0][0], 4).alias("lo"), F.round(ends[1.0][1], 4).alias("hi"), F.round(ends[1.96][0], 4).alias("lo95"), F.round(ends[1.96][1], 4).alias("hi95"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS amount, CASE WHEN o_orderkey % 6 = 0 THEN 'derived-only' ELSE 'redistribute-raw-ok' END AS tier, o_orderkey % 4 = 0 AS raw, o_orderkey % 9 <> 0 AS disclosed, 2000 + o_orderkey % 20 AS y0, 2000 + o_orderkey % 17 AS y1 FROM orders)
    SELECT o_orderkey, unnest(list_filter([CASE WHEN tier = 'derived-only' AND raw THEN 'derived-only is redistributed' END, CASE WHEN y1 < y0 THEN 'period ends before it starts' END, CASE WHEN NOT disclosed AND amount > 300000 THEN 'undisclosed amount is given' END], lambda x: x IS NOT NULL)) AS rule FROM o""")
def dq_03_contract_rules(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(n, F.col("o_totalprice").alias("amount"), F.when(n % 6 == 0, "derived-only").otherwise("redistribute-raw-ok").alias("tier"), (n % 4 == 0).alias("raw"), (n % 9 != 0).alias("disclosed"), (2000 + n % 20).cast("string").alias("y0"), (2000 + n % 17).cast("string").alias("y1"))
    same = world.period_grain(F.col("y0")) == world.period_grain(F.col("y1"))
    return ground.violations(rows, "o_orderkey", {"derived-only is redistributed": (F.col("tier") == "derived-only") & F.col("raw"), "period ends before it starts": same & (F.col("y1") < F.col("y0")), "undisclosed amount is given": ~F.col("disclosed") & (F.col("amount") > 300000)})


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("node")).where("node < 20").union(table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint")))
    edges = table(spark, sf, "supplier").select((F.col("s_suppkey") % 25).alias("a"), (F.col("s_suppkey") * 3 % 25).alias("b"), F.col("s_acctbal").alias("value"))
    return nodes, edges


@query("""WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey < 20 UNION ALL SELECT CAST(r_regionkey AS BIGINT) FROM region), e AS (SELECT s_suppkey % 25 AS a, s_suppkey * 3 % 25 AS b, s_acctbal AS value FROM supplier), x AS (SELECT DISTINCT * FROM e WHERE a NOT IN (SELECT node FROM n) OR b NOT IN (SELECT node FROM n))
    SELECT CAST(node AS VARCHAR) AS what, 'duplicate node' AS rule FROM n GROUP BY node HAVING count(*) > 1 UNION ALL SELECT a || '>' || b, 'unknown node' FROM x UNION ALL SELECT a || '>' || b, 'self loop' FROM e WHERE a = b UNION ALL SELECT a || '>' || b, 'value not positive' FROM e WHERE value <= 0""")
def grf_04_graph_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ground.graph_violations(*_graph(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey * 22 % 97 AS b FROM supplier), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node FROM r WHERE a = b""")
def grf_03_cycles(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return graph.cycles(table(spark, sf, "supplier").select(s.alias("a"), (s * 22 % 97).alias("b")))


@query(q.with_(q.EVENTS) + f"SELECT at_s // {v.DAY} AS day, count(*) AS n, round(sum({q.WEIGHT}), 4) AS w FROM ev GROUP BY 1")
def stm_03_daily_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The stream drained batch by batch into a running table of daily weights."""
    rows = streams.event_stream(spark, sf, "events").where("type is not null").withColumn("day", F.floor(F.unix_timestamp("at_ts") / v.DAY))
    out = streams.rollup_batches(rows, ["day"], "w", "daily")
    return out.select("day", "n", F.round("w", 4).alias("w"))


@query("SELECT event_id, event_type AS raw_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def stm_01_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The intake stream's rejects."""
    rows = streams.event_stream(spark, sf, "events").where("type is null").select("event_id", "raw_type")
    return streams.drain(rows, "rejects")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WHERE event_type IN ('view', 'click', 'purchase')), s AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, n) AS k FROM g) SELECT user_id AS device, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def stm_07_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session windows of the stream, written as a whole by each batch."""
    s = streams.complete(streams.sessions(streams.event_stream(spark, sf, "events"), "6 hours").select("device", "n"), "sessions")
    return s.groupBy("device").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query(q.with_(q.ITEMS) + f"SELECT id, published_s FROM items WHERE ord % 2 = 0 UNION ALL SELECT id, published_s FROM items WHERE ord % 2 = 1 AND id NOT IN (SELECT id FROM items WHERE ord % 2 = 0)")
def jon_05_load_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh items first, then those of the archive that aren't among them."""
    from feedloom.operators.feed import upsert

    every = items(spark, sf).select("id", "ord", "published_s")
    return upsert(every, every.where("ord % 2 = 0")).select("id", "published_s")
