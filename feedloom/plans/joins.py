"""Queries on joins, sets, scans and sinks, catalogues and their orders, drafts and whole passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import sources, text
from feedloom.operators import analytics, catalogue, drafts, feed, ground, health
from feedloom.operators.graph import Workspace
from feedloom.plans import sql as q
from feedloom.plans.feeds import scored, written
from feedloom.plans.sources_and_rules import _APP, _CAND, _CITED, _HOST, _LADDER, _appraised, _candidates, _citations, _judged, _ledger
from feedloom.sources import files
from feedloom.sources.entities import engagements, features, items, outcomes, registry, seconds, table
from feedloom.streaming import streams

_OK = f"({q.minutes('body')} >= 7)"


@query(q.with_(q.ITEMS, q.EVENTS) + "SELECT event_id, id, source, kind FROM ev JOIN items ON id = item_id")
def jon_01_events_items(spark: SparkSession, sf: str) -> DataFrame:
    """Events with what they were on; events on unknown items drop out."""
    i = items(spark, sf).select("id", "source", "kind")
    return engagements(spark, sf)[0].join(i, F.col("item_id") == F.col("id")).select("event_id", "id", "source", "kind")


@query(q.with_(q.REGISTRY, q.OUTCOMES) + "SELECT r.id, ok, http_status, item_count, status FROM registry r LEFT JOIN outcomes o ON o.id = r.id")
def jon_04_registry_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return registry(spark, sf).join(outcomes(spark, sf), "id", "left").select("id", "ok", "http_status", "item_count", "status")


@query(q.FULL_RANK + f"SELECT id FROM ranked WHERE id NOT IN (SELECT id FROM ranked WHERE {_OK} ORDER BY place LIMIT 10)")
def jon_06_not_featured(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    return rows.join(F.broadcast(feed.featured(rows)), "id", "left_anti").select("id")


@query(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), known AS (SELECT host FROM h WHERE page_id % 9 = 0 UNION SELECT 'resolved' || page_id || '.example' FROM h WHERE page_id % 9 = 1) SELECT page_id FROM h WHERE host IS NOT NULL AND host NOT IN (SELECT host FROM known WHERE host IS NOT NULL)")
def jon_07_unregistered(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose domain is that of no registered source, by its address or by where that leads."""
    n, p = F.col("page_id"), table(spark, sf, "pages")
    known = p.where("page_id % 9 <= 1").select(F.when(n % 9 == 0, F.col("url")).alias("url"), F.when(n % 9 == 1, F.concat(F.lit("https://resolved"), n.cast("string"), F.lit(".example/"))).alias("resolved_url"))
    return ground.unregistered(p, known).select("page_id")


_ASSIGNED = "asg AS (SELECT c_custkey AS k, ['d' || (c_custkey // 2), 'd' || (c_custkey * 3), 'nope', 'd' || (c_custkey // 3)] AS ids FROM customer)"


@query(q.with_(q.ITEMS, _ASSIGNED) + ", u AS (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS n FROM asg) SELECT k, string_agg(title, '|' ORDER BY n) AS titles FROM u JOIN items USING (id) GROUP BY k")
def jon_17_assigned_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items of a list in the list's order; what is missing drops out."""
    n = F.col("c_custkey")
    d = lambda x: F.concat(F.lit("d"), x.cast("string"))
    lists = table(spark, sf, "customer").select(n.alias("k"), F.array(d(F.expr("c_custkey div 2")), d(n * 3), F.lit("nope"), d(F.expr("c_custkey div 3"))).alias("ids"))
    return catalogue.looked_up(lists, "k", "ids", items(spark, sf).select("id", "title")).select("k", F.array_join(F.transform("found", lambda x: x["title"]), "|").alias("titles"))


@query("""WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'licensed' WHEN s_suppkey % 5 = 1 THEN 'wikipedia' END AS src FROM supplier) SELECT s_suppkey, coalesce(src, 'link-out') AS provider FROM l""")
def jon_18_providers(spark: SparkSession, sf: str) -> DataFrame:
    """The licensed result if it is enabled and valid, else the free one, else a link."""
    s = table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    licensed = s.where(k % 3 == 0).select(k, F.struct(F.lit("licensed").alias("name")).alias("a"))
    free = s.where((k % 5 == 1) | (k % 3 == 0)).select(k, F.struct(F.lit("wikipedia").alias("name")).alias("b"))
    return s.join(licensed, "s_suppkey", "left").join(free, "s_suppkey", "left").select("s_suppkey", F.coalesce("a.name", "b.name", F.lit("link-out")).alias("provider"))


@query(q.with_(_CITED) + ", l AS (SELECT url, min(domain) AS domain, min(origin) AS origin FROM ledger GROUP BY url) SELECT draft, count(DISTINCT domain || '::' || origin) AS n FROM cited JOIN l USING (url) GROUP BY draft")
def jon_19_independent_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How many independent sources (domain and origin) the ledger knows of a draft's claims."""
    return ground.independent_sources(_citations(spark, sf), _ledger(spark, sf), "draft")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'front' WHEN l.k IS NOT NULL THEN 'ledger' END AS dated_by, CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) ELSE l.s END AS at_s FROM orders LEFT JOIN (SELECT o_orderkey AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 86400 AS s FROM orders WHERE o_orderkey % 3 = 0) l ON l.k = o_orderkey")
def jon_20_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A date from the front matter, else from the ledger."""
    o, k, t = table(spark, sf, "orders"), F.col("o_orderkey"), seconds(F.col("o_orderdate"))
    led = o.where(k % 3 == 0).select(k, (t + v.DAY).alias("l"))
    return o.select(k, F.when(k % 4 == 0, t).alias("f")).join(led, "o_orderkey", "left").select("o_orderkey", F.when(F.col("f").isNotNull(), "front").when(F.col("l").isNotNull(), "ledger").alias("dated_by"), F.coalesce("f", "l").alias("at_s"))


@query(q.with_(q.ITEMS, q.SESSIONS) + "SELECT key, CAST(session AS BIGINT) AS session, count(*) AS n, min(published_s) AS first_s, max(published_s) AS last_s FROM sessions WHERE session IS NOT NULL GROUP BY key, session")
def win_10_session_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Items of one title whose gaps are at most 36 hours, as groups."""
    s = feed.title_sessions(written(spark, sf, "id", "title", "published_s")).where("session is not null")
    return s.groupBy("key", F.col("session").cast("bigint").alias("session")).agg(F.count("*").alias("n"), F.min("published_s").alias("first_s"), F.max("published_s").alias("last_s"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[.!?]\\s+'), lambda x: x <> '') AS a FROM conversations), f AS (SELECT conv_id, turn, list_reduce(list_prepend({'k': [], 'skip': false}, list_transform(a, lambda x: {'k': [x], 'skip': false})), lambda p, c: CASE WHEN p.skip THEN {'k': p.k, 'skip': false} WHEN length(c.k[1]) % 5 = 0 THEN {'k': p.k, 'skip': true} ELSE {'k': list_concat(p.k, c.k), 'skip': false} END) AS r FROM s)
    SELECT conv_id, turn, array_to_string(r.k, '|') AS kept FROM f""")
def win_13_skip_next(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences without those of a kind (here: of a length divisible by five) and the one behind each."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"[.!?]\s+"), lambda x: x != "").alias("s"))
    return rows.select("conv_id", "turn", F.array_join(catalogue.skip_next("s", lambda x: F.length(x) % 5 == 0), "|").alias("kept"))


@query("SELECT 'link' AS origin, count(*) AS n FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'outline', count(*) FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT 'search', count(*) FROM pages WHERE page_id % 3 = 2")
def set_01_generators(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of all generators."""
    p, n = table(spark, sf, "pages"), F.col("page_id")
    parts = [p.where(n % 3 == k).select("url", F.lit(name).alias("origin")) for k, name in enumerate(("link", "outline", "search"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count("*").alias("n"))


@query(q.with_(q.ITEMS) + f"SELECT id, array_to_string(CASE WHEN topics[1] = topics[2] THEN list_filter([topics[1], {q.array(v.CHANNELS)}[ord % 5 + 1]], lambda x, i: i = 1 OR x <> topics[1]) ELSE list_filter([topics[1], topics[2], {q.array(v.CHANNELS)}[ord % 5 + 1]], lambda x, i: i < 3 OR (x <> topics[1] AND x <> topics[2])) END, ',') AS topics FROM items")
def set_03_array_union(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays united in order, the first places counting."""
    other = F.array(F.get(F.array(*map(F.lit, v.CHANNELS)), (F.col("ord") % 5).cast("int")))
    return items(spark, sf).select("id", F.array_join(F.array_distinct(F.concat("topics", other)), ",").alias("topics"))


@query("SELECT c_nationkey AS key FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 4 <> 1")
def set_04_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Keys asked for that nobody has."""
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")).subtract(table(spark, sf, "supplier").where("s_nationkey % 4 <> 1").select(F.col("s_nationkey").alias("key")))


@query(q.with_(q.ITEMS, q.EVENTS, q.PROFILE) + ", a AS (SELECT term, v FROM profile WHERE kind = 'topic'), b AS (SELECT topics[1] AS term, count(*) AS n FROM items GROUP BY 1) SELECT coalesce(a.term, b.term) AS term, round(coalesce(v, 0), 6) AS v, coalesce(n, 0) AS n FROM a FULL JOIN b ON a.term = b.term")
def set_05_key_union(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of two maps with both values, zero where one lacks them."""
    p = feed.taste_profile(engagements(spark, sf)[0], items(spark, sf), v.NOW).where("kind = 'topic'").select("term", "v")
    n = items(spark, sf).groupBy(F.get("topics", 0).alias("term")).agg(F.count("*").alias("n"))
    return p.join(n, "term", "full_outer").select("term", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))


def _half_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, every third without its markup, so that safe ones are among them."""
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<[^>]*>", " ")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", html.alias("html"))


@query("WITH pages AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '<[^>]*>', ' ', 'g') ELSE html END AS html FROM pages) SELECT page_id, NOT regexp_matches(coalesce(html, ''), '(?i)(<script\\b|<iframe\\b|<(object|embed)\\b|<style\\b|<form\\b|\\son[a-z]+\\s*=|javascript:|data:text/html)') AS safe FROM pages")
def set_06_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Safe rows and dropped ones, together all of them."""
    safe, dropped = files.split_safe(_half_plain(spark, sf), "html")
    return safe.select("page_id", F.lit(True).alias("safe")).union(dropped.select("page_id", F.lit(False)))


#: Rows that one loose file holds.
FILE_ROWS = 500
# scans and sinks ------------------------------------------------------------------------------------------------------

_RAW = "r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'o' || o_orderkey END AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'bogus' ELSE 'link' END AS kind, CAST(floor(o_totalprice) AS BIGINT) AS score FROM orders)"


def _raw_array(spark: SparkSession, sf: str) -> str:
    """Orders written as files with one JSON array each, as a feed's raw items."""
    k, folder = F.col("o_orderkey"), Workspace(spark).folder("raw")
    one = F.to_json(F.struct(F.when(k % 5 != 0, F.concat(F.lit("o"), k.cast("string"))).alias("id"), F.when(k % 7 == 0, "bogus").otherwise("link").alias("kind"), F.floor("o_totalprice").alias("score")))
    table(spark, sf, "orders").groupBy(F.floor(k / FILE_ROWS).alias("f")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value")).write.partitionBy("f").text(folder)
    return folder


@query(q.with_(_RAW) + "SELECT id, score FROM r WHERE id IS NOT NULL AND kind <> 'bogus'")
def src_01_raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of items: each element is checked by itself, bad ones drop out, what is no array gives nothing."""
    good, _ = files.json_arrays(spark, _raw_array(spark, sf), "id string, kind string, score bigint", (F.col("id").isNotNull()) & F.col("kind").isin(v.ITEM_KINDS))
    return good.select("id", "score")


_SUMMARY = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(body, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(q.with_(q.ITEMS, f"s AS (SELECT id, published_s, {_SUMMARY} AS t FROM items)", "c AS (SELECT *, substr(t, 1, 280) AS x, CASE WHEN contains(substr(t, 1, 280), ' ') THEN 280 - strpos(reverse(substr(t, 1, 280)), ' ') ELSE 0 END AS b FROM s)") + "SELECT id, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(CASE WHEN b > 168 THEN substr(x, 1, b) ELSE x END) || '…' END AS summary FROM c")
def src_03_archive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The archive with clean summaries."""
    return feed.archived(items(spark, sf)).select("id", "summary")


@query(q.with_(q.ITEMS) + "SELECT id, 'archive' AS origin FROM items")
def src_04_first_that_has_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The curated file, else the archive: the first that is there and has rows."""
    space = Workspace(spark)
    space.write(items(spark, sf).select("id").limit(0), "curated")
    space.write(items(spark, sf).select("id"), "archive")
    return files.first_filled(spark, {k: space.folder(k) for k in ("missing", "curated", "archive")}, "id string")


@query("SELECT o_orderkey % 3 AS shard, count(*) AS n FROM orders GROUP BY 1")
def src_05_ledger_shards(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger and its shards as one table, with the file each row is from."""
    space = Workspace(spark)
    for k in range(3):
        table(spark, sf, "orders").where(F.col("o_orderkey") % 3 == k).select("o_orderkey").write.json(space.folder(f"ledgers/{k}.ledger"))
    rows = files.shards(spark, space.folder("ledgers"), "*.ledger", "o_orderkey bigint")
    return rows.groupBy(F.regexp_extract("file", r"(\d+)\.ledger", 1).cast("bigint").alias("shard")).agg(F.count("*").alias("n"))


@query(q.with_(q.REGISTRY) + "SELECT id, CASE WHEN n % 3 = 0 THEN 'failing' ELSE status END AS status, CASE WHEN n % 3 = 0 THEN 9 ELSE strikes END AS strikes FROM registry")
def src_06_registry_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The seed registry where there is no other, under the stored health."""
    space, r = Workspace(spark), registry(spark, sf)
    space.write(r, "seed")
    stored = r.where("n % 3 = 0").select("id", F.lit("failing").alias("status"), F.lit(9).cast("bigint").alias("strikes"))
    seed = files.first_filled(spark, {k: space.folder(k) for k in ("registry", "seed")}, r.schema)
    return health.overlaid(seed, stored, ["status", "strikes"]).select("id", "status", "strikes")


@query("SELECT c_custkey AS id FROM customer")
def src_07_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Pending sources, as a list or as an object that has one."""
    k, folder = F.col("c_custkey"), Workspace(spark).folder("pending")
    listed = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(k.alias("id")))), ","), F.lit("]"))
    table(spark, sf, "customer").groupBy(F.floor(k / FILE_ROWS).alias("f")).agg(listed.alias("a")).select(F.when(F.col("f") % 2 == 0, F.col("a")).otherwise(F.concat(F.lit('{"sources": '), F.col("a"), F.lit("}"))).alias("value")).write.text(folder)
    return files.listed(spark, folder, "sources", "id bigint")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'ai' ELSE 'tech' END AS topic, CAST(c_custkey % 10 AS DOUBLE) AS v FROM customer")
def src_08_taste_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of numbers without what is no number."""
    k = F.col("c_custkey")
    payload = F.concat(F.lit('{"topics": {"'), F.when(k % 2 == 0, "ai").otherwise("tech"), F.lit('": '), (k % 10).cast("string"), F.lit(', "iot": "many", "diy": null}}'))
    return table(spark, sf, "customer").select(k.alias("k"), F.explode(files.numbers(payload, "topics")).alias("topic", "v"))


@query(f"SELECT domain, min(page_id) AS first FROM (SELECT page_id, {_HOST} AS domain FROM pages) WHERE domain IS NOT NULL GROUP BY domain")
def src_14_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of an outline, one a domain, the first of them; only addresses of the web."""
    n = F.col("page_id")
    line = F.concat(F.lit('<outline text="t'), n.cast("string"), F.lit('" xmlUrl="'), F.concat("url", F.lit("/feed")), F.lit('" htmlUrl="'), F.col("url"), F.lit('"/>'))
    return files.outline(table(spark, sf, "pages").select(n.alias("n"), F.coalesce(line, F.lit("")).alias("line")), "n", "line").select("domain", F.col("n").alias("first"))


@query("WITH pages AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '<[^>]*>', ' ', 'g') ELSE html END AS html FROM pages) SELECT page_id FROM pages WHERE NOT regexp_matches(coalesce(html, ''), '(?i)(<script\\b|<iframe\\b|<(object|embed)\\b|<style\\b|<form\\b|\\son[a-z]+\\s*=|javascript:|data:text/html)')")
def snk_01_safe_sink(spark: SparkSession, sf: str) -> DataFrame:
    """What a sink with a safety net has written, read back; unsafe rows lie in quarantine."""
    space = Workspace(spark)
    files.write_safe(_half_plain(spark, sf), "html", space.folder("curated"), space.folder("quarantine"))
    return spark.read.parquet(space.folder("curated")).select("page_id")


@query(q.with_(q.REGISTRY) + "SELECT id, status FROM registry WHERE strikes <= 1")
def snk_02_registry_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Checked rows replace a table as a whole."""
    path = Workspace(spark).folder("registry")
    files.write_checked(registry(spark, sf), path, F.col("strikes") >= 0)
    files.write_checked(registry(spark, sf), path, F.col("strikes") <= 1)
    return spark.read.parquet(path).select("id", "status")


@query("SELECT o_orderkey % 10 AS run, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT -1, count(*) FROM orders")
def snk_03_run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Records appended to a log, read back as one."""
    path, o = Workspace(spark).folder("log"), table(spark, sf, "orders")
    files.append_log(o.groupBy((F.col("o_orderkey") % 10).alias("run")).agg(F.count("*").alias("n")), path)
    files.append_log(o.agg(F.count("*").alias("n")).select(F.lit(-1).cast("bigint").alias("run"), "n"), path)
    return spark.read.schema("run bigint, n bigint").json(path)


@query("WITH d AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, CASE WHEN day % 2 = 0 THEN n ELSE 0 END AS n FROM d")
def snk_04_day_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger by day; a day that is written again replaces its row."""
    path = Workspace(spark).folder("days")
    days = table(spark, sf, "events").groupBy(F.floor(seconds(F.col("ts")) / v.DAY).alias("day")).agg(F.count("*").alias("n"))
    files.upsert_days(days.withColumn("n", F.lit(0).cast("bigint")), path)
    return files.upsert_days(days.where("day % 2 = 0"), path)


# projections ------------------------------------------------------------------------------------------------------------


@query(q.with_(q.ITEMS) + f"SELECT id, topics, published_s, trust, kind FROM items WHERE published_s >= {v.NOW - 14 * v.DAY}")
def prj_01_archive_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the archive keeps of an item."""
    a = feed.archive(items(spark, sf), items(spark, sf).limit(0), v.NOW)
    return a.select("id", "topics", "published_s", "trust", "kind")


@query(q.FULL_SCORE + "SELECT id, round(total - affinity, 5) AS base, topics, entities FROM total")
def prj_02_personalise(spark: SparkSession, sf: str) -> DataFrame:
    """What the browser needs to rank by its own profile: the score without taste, topics and entities."""
    return scored(spark, sf).select("id", F.round(F.col("total") - F.col("affinity"), 5).alias("base"), "topics", "entities")


_CARDS = """read AS (SELECT id, title, topics, source, kind, published_s, {m} AS read_min, strftime(to_timestamp(published_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date_label FROM items)""".format(m=f"greatest(1, {q.minutes('body', 230)})")


@query(q.with_(q.ITEMS, _CARDS) + "SELECT id, title, read_min, date_label FROM read")
def prj_04_cards(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.cards(items(spark, sf)).select("id", "title", "read_min", "date_label")


@query("SELECT c_custkey AS k, 'seg-' || lower(c_mktsegment) || CASE WHEN rn + (CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 0 END) = 1 THEN '' ELSE '-' || (rn + CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE 0 END) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer)")
def prj_06_source_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids base, base-2, base-3 and so on; here base seg-building is taken up to 3."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("seg-"), F.lower("c_mktsegment")).alias("base"))
    taken = spark.createDataFrame([("seg-building",), ("seg-building-2",), ("seg-building-3",)], "id string")
    return catalogue.allocated_ids(c, "k", taken)


@query(q.with_(q.ITEMS) + f"SELECT id, channel, {q.group('channel')} AS grp FROM (SELECT id, coalesce(CASE WHEN ord % 9 <> 0 THEN topics[1] END, 'tech') AS channel FROM items)")
def prj_07_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The primary channel, tech where there is none, and its group."""
    c = F.coalesce(F.when(F.col("ord") % 9 != 0, F.get("topics", 0)), F.lit("tech"))
    return items(spark, sf).select("id", c.alias("channel"), text.group_of(c).alias("grp"))


@query(q.with_(_CITED) + ", l AS (SELECT url, min(tier) AS tier, min(origin) AS origin FROM ledger GROUP BY url) SELECT draft, url, tier, origin FROM cited LEFT JOIN l USING (url)")
def prj_09_enriched_citations(spark: SparkSession, sf: str) -> DataFrame:
    known = _ledger(spark, sf).groupBy("url").agg(F.min("tier").alias("tier"), F.min("origin").alias("origin"))
    return _citations(spark, sf).join(known, "url", "left").select("draft", "url", "tier", "origin")


@query(q.with_(q.ITEMS) + f"SELECT id, {q.minutes('body')} AS minutes, length({q.plain('body')}) > 800 AS full_text FROM items")
def prj_10_synthetic_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up bodies that have the read minutes and the full-text flag of the real ones."""
    b = features(spark, sf).select("id", catalogue.synthetic_body(F.col("minutes"), F.col("n_plain") > v.FULL_TEXT_CHARS).alias("body"))
    return b.select("id", text.read_minutes(F.col("body")).alias("minutes"), text.has_full_text(F.col("body")).alias("full_text"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS score, round(greatest(0.35::DOUBLE * CASE WHEN o_custkey > 0 THEN least(greatest((log10(o_custkey * 1000) - 3) / 4, 0), 1) ELSE 0 END + 0.2::DOUBLE * CASE WHEN floor(o_totalprice) <= 0 THEN 0 WHEN o_custkey <= 0 THEN 0.5 ELSE least(floor(o_totalprice) / (o_custkey * 1000), 1) END + 0.15::DOUBLE * least(greatest(1 - (o_orderkey % 1000)::DOUBLE / 730, 0), 1), 0.2), 6) AS trust, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'known' END, 'channel ' || o_custkey) AS author FROM orders")
def prj_11_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Videos with their views as score, the greater of credibility and a floor as trust, the channel as author where there is none."""
    k, views, subs = F.col("o_orderkey"), F.floor("o_totalprice"), F.col("o_custkey") * 1000
    trust = F.greatest(sources.credibility(subs, views, F.lit(None).cast("bigint"), (k % 1000).cast("double"), F.lit(120)), F.lit(0.2))
    return table(spark, sf, "orders").select("o_orderkey", views.alias("score"), F.round(trust, 6).alias("trust"), F.coalesce(F.when(k % 3 == 0, "known"), F.concat(F.lit("channel "), F.col("o_custkey").cast("string"))).alias("author"))


@query("SELECT o_orderkey, greatest(a, b) AS score, coalesce(a, 0) + coalesce(b, 0) AS volume FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS a, CASE WHEN o_orderkey % 2 > 0 THEN o_custkey % 50 END AS b FROM orders)")
def prj_13_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The greater of two metrics, absent where both are; their volume."""
    k = F.col("o_orderkey")
    a, b = F.when(k % 3 > 0, k % 50), F.when(k % 2 > 0, F.col("o_custkey") % 50)
    return table(spark, sf, "orders").select("o_orderkey", F.greatest(a, b).alias("score"), (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias("volume"))


@query(f"WITH h AS (SELECT {_HOST} AS host, url, page_id FROM pages) SELECT draft, count(*) AS citations, count(DISTINCT host) AS hosts, max(page_id) AS newest FROM (SELECT CAST(doc_id // 10 AS BIGINT) AS draft, doc_id // 4 AS p FROM documents) JOIN h ON page_id = p WHERE host IS NOT NULL GROUP BY draft")
def prj_14_read_records(spark: SparkSession, sf: str) -> DataFrame:
    """A record a draft: its valid citations, their hosts, the newest."""
    c = table(spark, sf, "documents").select(F.expr("doc_id div 10").alias("draft"), F.expr("doc_id div 4").alias("page_id")).join(table(spark, sf, "pages").select("page_id", text.host(F.col("url")).alias("host")), "page_id")
    return c.where("host is not null").groupBy("draft").agg(F.count("*").alias("citations"), F.count_distinct("host").alias("hosts"), F.max("page_id").alias("newest"))


# catalogues and orders --------------------------------------------------------------------------------------------------

_ENRICHED = q.with_(q.ITEMS, q.REGISTRY, f"own AS (SELECT 's' || (ord // 3) AS id, count(*) AS n, floor(avg(greatest(1, {q.minutes('body')})) * 10 + 0.5) / 10 AS minutes, max(published_s) AS last_s FROM items GROUP BY 1)",
    "e AS (SELECT r.id, r.n AS num, channel, enabled, strikes, coalesce(o.n, 0) AS n_items, coalesce(minutes, 0) AS minutes, last_s, r.n % 101 / 100.0::DOUBLE AS trust, CASE WHEN r.n % 4 = 0 THEN 'x' WHEN r.n % 4 = 1 THEN 'rss' ELSE 'news' END AS type FROM registry r LEFT JOIN own o USING (id))",
    "s AS (SELECT *, CASE WHEN NOT enabled THEN CASE WHEN type = 'x' THEN 'deferred' ELSE 'disabled' END WHEN strikes > 0 THEN 'failing' WHEN n_items > 0 THEN 'producing' ELSE 'dormant' END AS state FROM e)")


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with what they have produced and their state."""
    own = features(spark, sf).withColumn("source", F.concat(F.lit("s"), F.expr("ord div 3").cast("string")))
    n = F.col("n")
    reg = registry(spark, sf).withColumns({"trust": n % 101 / 100, "type": F.when(n % 4 == 0, "x").when(n % 4 == 1, "rss").otherwise("news")})
    return catalogue.enriched(reg, own)


@query(_ENRICHED + "SELECT 'all' AS facet, 'total' AS value, count(*) AS n, round(avg(trust), 6) AS mean_trust FROM s UNION ALL SELECT 'state', state, count(*), NULL FROM s GROUP BY state UNION ALL SELECT 'type', type, count(*), NULL FROM s GROUP BY type UNION ALL SELECT 'channel', channel, count(*), NULL FROM s GROUP BY channel")
def agg_13_source_facets(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.source_facets(enriched(spark, sf)).withColumn("mean_trust", F.round("mean_trust", 6))


@query(q.with_(q.ITEMS, _CARDS) + "SELECT 'all' AS facet, 'total' AS value, count(*) AS n, CAST(sum(read_min) AS BIGINT) AS minutes FROM read UNION ALL SELECT 'kind', kind, count(*), NULL FROM read GROUP BY kind UNION ALL SELECT 'channel', channel, count(*), NULL FROM (SELECT unnest(topics) AS channel FROM read) GROUP BY channel")
def agg_15_reads_index(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.reads_index(catalogue.cards(items(spark, sf)))


@query(q.with_(q.REGISTRY) + f"SELECT channel, pos, count(*) AS n, arg_min(id, (-(n % 101), id)) AS best FROM (SELECT *, CASE WHEN n % 13 = 0 THEN 'unsorted' ELSE channel END AS channel, coalesce(list_position({q.array(v.CHANNELS)}, CASE WHEN n % 13 = 0 THEN 'unsorted' ELSE channel END), 99) AS pos FROM (SELECT id, n, channel FROM registry)) GROUP BY 1, 2".replace("SELECT *, CASE", "SELECT id, n, CASE"))
def agg_26_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by channel in the vocabulary's order, the unsorted last; the most trusted of each."""
    r = registry(spark, sf).withColumns({"channels": F.when(F.col("n") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("channel")), "trust": F.col("n") % 101})
    return catalogue.by_channel(r).select("channel", "pos", "n", "best")


@query(f"WITH c AS (SELECT o_custkey AS channel, floor(o_totalprice) AS views, o_orderkey AS k FROM orders) SELECT channel, arg_max(k, (views, -k)) AS k, CAST(max(views) AS BIGINT) AS views, count(*) AS seen FROM c GROUP BY channel")
def agg_29_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Channels found several times: the signals of the most viewed, the first of equals."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("channel"), F.floor("o_totalprice").alias("views"), F.col("o_orderkey").alias("k"))
    best = F.max(F.struct("views", (-F.col("k")).alias("k")))
    return o.groupBy("channel").agg(best.alias("b"), F.count("*").alias("seen")).select("channel", (-F.col("b.k")).alias("k"), F.col("b.views").alias("views"), "seen")


@query("WITH s AS (SELECT n_name, sum(c_acctbal) FILTER (c_custkey % 2 = 0) AS a, sum(c_acctbal) FILTER (c_custkey % 2 = 1) AS b FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) SELECT n_name, round(coalesce(a, 0) / greatest(abs(coalesce(a, 0)), abs(coalesce(b, 0))), 6) AS left_share, CASE WHEN coalesce(a, 0) > coalesce(b, 0) THEN 'left' WHEN coalesce(a, 0) < coalesce(b, 0) THEN 'right' ELSE 'even' END AS side FROM s")
def agg_35_forces(spark: SparkSession, sf: str) -> DataFrame:
    """Two sides by country: the one's share of the greater, and which is ahead."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    x = F.col("c_acctbal")
    s = c.groupBy("n_name").agg(F.coalesce(F.sum(F.when(F.col("c_custkey") % 2 == 0, x)), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(F.col("c_custkey") % 2 == 1, x)), F.lit(0.0)).alias("b"))
    return s.select("n_name", F.round(F.try_divide("a", F.greatest(F.abs("a"), F.abs("b"))), 6).alias("left_share"), F.when(F.col("a") > F.col("b"), "left").when(F.col("a") < F.col("b"), "right").otherwise("even").alias("side"))


@query(q.with_(q.ITEMS) + f"SELECT id, row_number() OVER (ORDER BY published_s DESC, id) - 1 AS place FROM items WHERE published_s >= {v.NOW - 14 * v.DAY}")
def srt_03_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The whole archive, the newest first."""
    rows = items(spark, sf).where(F.col("published_s") >= v.NOW - 14 * v.DAY).select("id", "published_s")
    return feed.ranked(rows, [F.desc("published_s"), F.col("id")]).select("id", "place")


@query(q.with_(q.ITEMS, q.EVENTS, q.PROFILE) + "SELECT term, round(v, 6) AS v FROM profile WHERE kind = 'entity' ORDER BY profile.v DESC, term LIMIT 20")
def srt_04_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best liked entities."""
    p = feed.taste_profile(engagements(spark, sf)[0], items(spark, sf), v.NOW).where("kind = 'entity'")
    return p.orderBy(F.desc("v"), "term").limit(20).select("term", F.round("v", 6).alias("v"))


@query(q.FULL_RANK + "SELECT title FROM ranked WHERE place < 12")
def srt_06_ticker(spark: SparkSession, sf: str) -> DataFrame:
    return feed.top(scored(spark, sf), 12).select("title")


def _order_sql(keys: dict[str, str]) -> str:
    return ", ".join(f"row_number() OVER (ORDER BY {o}) - 1 AS {k}" for k, o in keys.items())


@query(q.with_(q.ITEMS, _CARDS) + f"SELECT id, {_order_sql({'newest': 'published_s DESC, id', 'longest': 'read_min DESC, published_s DESC, id', 'by_kind': f'list_position({q.array(v.ITEM_KINDS)}, kind), published_s DESC, id'})} FROM read")
def srt_07_read_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Places of reads by date, by length, by kind in the canonical order."""
    rank = F.array_position(F.array(*map(F.lit, v.ITEM_KINDS)), F.col("kind"))
    new = [F.desc("published_s"), F.col("id")]
    return catalogue.places(catalogue.cards(items(spark, sf)).select("id", "published_s", "read_min", "kind"), {"newest": new, "longest": [F.desc("read_min"), *new], "by_kind": [rank, *new]})


@query(q.with_(q.ITEMS) + f"SELECT id, {_order_sql({'newest': 'published_s DESC, id', 'by_channel': f'list_position({q.array(v.CHANNELS)}, topics[1]), published_s DESC, id', 'by_source': 'source, published_s DESC, id'})} FROM items")
def srt_08_build_orders(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, v.CHANNELS)), F.get("topics", 0))
    new = [F.desc("published_s"), F.col("id")]
    return catalogue.places(items(spark, sf).select("id", "published_s", "topics", "source"), {"newest": new, "by_channel": [rank, *new], "by_source": [F.col("source"), *new]})


@query(_ENRICHED + f"SELECT id, {_order_sql({'by_name': 'id', 'by_items': 'n_items DESC, id', 'by_failures': 'strikes DESC, id', 'by_activity': 'last_s DESC NULLS LAST, id', 'by_trust': 'trust DESC, id'})} FROM s")
def srt_09_source_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Places of sources by five keys; those that were never active come last."""
    i = F.col("id")
    return catalogue.places(enriched(spark, sf).select("id", "n_items", "strikes", "last_s", "trust"), {"by_name": [i], "by_items": [F.desc("n_items"), i], "by_failures": [F.desc("strikes"), i], "by_activity": [F.desc_nulls_last("last_s"), i], "by_trust": [F.desc("trust"), i]})


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN try_cast(x AS DOUBLE) IS NULL THEN 1 ELSE 0 END, try_cast(x AS DOUBLE), x, c_custkey) - 1 AS place FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE CAST(c_custkey * 37 % 1000 AS VARCHAR) END AS x FROM customer)")
def srt_10_mixed_column(spark: SparkSession, sf: str) -> DataFrame:
    """A column of numbers and words: numbers by value, then words; equal ones keep their order."""
    n = F.col("c_custkey")
    c = table(spark, sf, "customer").select(n, F.when(n % 4 == 0, F.col("c_mktsegment")).otherwise((n * 37 % 1000).cast("string")).alias("x"))
    number = F.col("x").try_cast("double")
    return feed.ranked(c, [number.isNull(), number, F.col("x"), n]).select("c_custkey", "place")


@query(q.FULL_RANK + ", t AS (SELECT id, affinity FROM ranked ORDER BY affinity DESC, id LIMIT 150) SELECT id FROM t")
def srt_13_top_taste(spark: SparkSession, sf: str) -> DataFrame:
    """The 150 best liked."""
    return scored(spark, sf).orderBy(F.desc("affinity"), "id").limit(150).select("id")


@query(q.FULL_RANK + "SELECT id, place // 40 AS page FROM ranked")
def srt_15_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 40."""
    return feed.ranked(scored(spark, sf), feed.by_total()).select("id", F.floor(F.col("place") / 40).alias("page"))


# state and streams ------------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT o_custkey AS k, max(floor(o_totalprice)) AS views FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, c_custkey % 10 / 10.0::DOUBLE AS t FROM customer) SELECT k, t AS was, round(least(views / 300000, 1), 1) AS now FROM r JOIN c USING (k) WHERE t <> round(least(views / 300000, 1), 1)")
def stf_06_rerated(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose trust is rated anew, from and to; the others are not in the log."""
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10 / 10).alias("trust"))
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.least(F.max(F.floor("o_totalprice")) / 300000, F.lit(1.0)), 1).alias("rated"))
    return health.rerated(r, c)[1].select(F.col("id").alias("k"), F.col("was"), F.col("now"))


@query(q.with_(q.ITEMS, q.EVENTS, q.PROFILE) + "SELECT kind, term, round(v, 6) AS v FROM profile")
def stf_07_live_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile from the stream of events, kept as decayed sums by item and made a profile at the end."""
    e = streams.event_stream(spark, sf, "events").where("type is not null")
    return streams.live_profile(e, items(spark, sf), v.NOW).select("kind", "term", F.round("v", 6).alias("v"))


@query(f"WITH a AS (SELECT user_id AS id, max(CAST(floor(epoch(ts)) AS BIGINT)) AS published_s FROM events GROUP BY user_id) SELECT id, published_s FROM a WHERE published_s >= {v.NOW - 14 * v.DAY}")
def stm_04_rolling_archive(spark: SparkSession, sf: str) -> DataFrame:
    """A stream merged into an archive batch by batch: the newest row an id, the last 14 days."""
    raw = streams.event_stream(spark, sf, "events").select(F.col("device").alias("id"), F.unix_timestamp("at_ts").alias("published_s"))
    return streams.rolling_archive(raw, v.NOW, v.ARCHIVE_DAYS)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 2000")
def stm_05_latest_mirror(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 2000 events of the stream, replaced batch by batch (the cap is the feature)."""
    return streams.latest(streams.event_stream(spark, sf, "events").select("event_id", "at_ts"), 2000).select("event_id")


@query(f"""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, (event_id % 181 - 90)::DOUBLE AS lat, (event_id * 7 % 361 - 180)::DOUBLE AS lng FROM events WHERE event_type IN ('view', 'click', 'purchase')), a(theater, n, s, ea, w, st, en, status) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in t) + ")" for t in __import__("feedloom.operators.world", fromlist=["x"]).THEATERS)}),
    m AS (SELECT event_id, min(theater) AS theater FROM e LEFT JOIN a ON lat BETWEEN s AND n AND lng BETWEEN w AND ea AND at_s >= st AND (en IS NULL OR at_s < en) AND status <> 'proposed' AND (status <> 'archived' OR en IS NOT NULL) GROUP BY event_id) SELECT event_id, theater FROM m WHERE theater IS NOT NULL""")
def stm_06_staged(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the stream that fall into a theater, as they come."""
    from feedloom.operators import world

    n = F.col("event_id")
    e = streams.event_stream(spark, sf, "events").where("type is not null").select("event_id", F.unix_timestamp("at_ts").alias("at_s"), (n % 181 - 90).cast("double").alias("lat"), (n * 7 % 361 - 180).cast("double").alias("lng"))
    return streams.drain(world.membership(e, world.theaters(spark)).where("theater is not null").select("event_id", "theater"), "staged")


# rules ------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'derived-only is redistributed' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'derived-only has no computed origin' END], lambda x: x IS NOT NULL)) AS rule FROM orders")
def dq_01_licence_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """What may only be derived is not redistributed and has a computed origin."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k, (k % 3 == 0).alias("derived_only"), (k % 2 == 0).alias("redistributed"), F.when(k % 5 == 0, "computed").otherwise("source").alias("origin"))
    return ground.violations(rows, "o_orderkey", {"derived-only is redistributed": F.col("derived_only") & F.col("redistributed"), "derived-only has no computed origin": F.col("derived_only") & (F.col("origin") != "computed")})


@query("""WITH n AS (SELECT c_custkey AS k, 'arch' || (c_custkey % 20) AS arch, c_mktsegment AS family, CASE WHEN c_custkey % 6 = 0 THEN 'see [1]' ELSE 'text' END AS body FROM customer)
    SELECT arch AS what, 'fewer than three families' AS rule FROM n GROUP BY arch HAVING count(DISTINCT family) < 3 UNION ALL SELECT CAST(k AS VARCHAR), 'citation in the text' FROM n WHERE regexp_matches(body, '\\[\\d+\\]') UNION ALL SELECT arch, 'fewer than five slots' FROM n GROUP BY arch HAVING count(*) < 5""")
def dq_05_library(spark: SparkSession, sf: str) -> DataFrame:
    """A library's entries: enough families and slots, no citations in their texts."""
    k = F.col("c_custkey")
    n = table(spark, sf, "customer").select(k.cast("string").alias("slot"), F.concat(F.lit("arch"), (k % 20).cast("string")).alias("entry"), F.col("c_mktsegment").alias("family"), F.when(k % 6 == 0, "see [1]").otherwise("text").alias("body"))
    return drafts.library_violations(n)


_DRAFT = f"d AS (SELECT page_id AS id, html, {_HOST} AS host, coalesce(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)), []) AS tags, {q.words('html')} AS words FROM pages)"


@query(q.with_(_DRAFT) + ", e AS (SELECT id, len(list_filter(tags, lambda t: t IN ('img', 'table', 'figure', 'pre', 'blockquote', 'ul'))) AS islands, words FROM d) SELECT id, words, islands, CASE WHEN islands > 0 THEN words / islands::DOUBLE END AS words_per_island, words / greatest(islands, 1)::DOUBLE <= 1000 AS rich, words >= 1500 AND islands < 2 AS egregious FROM e")
def dq_07_richness(spark: SparkSession, sf: str) -> DataFrame:
    """Words for each kind of component; long texts with hardly any are egregious."""
    return drafts.richness(table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html"), ["img", "table", "figure", "pre", "blockquote", "ul"])


@query(q.with_(_DRAFT) + """SELECT id, 'no title' AS rule FROM d WHERE NOT regexp_matches(coalesce(html, ''), '(?i)<title') UNION ALL SELECT id, 'not grounded' FROM d WHERE host IS NULL OR id % 4 = 0 UNION ALL SELECT id, 'unknown component ' || t FROM (SELECT id, unnest(tags) AS t FROM d) WHERE t NOT IN ('html', 'head', 'body', 'p', 'div', 'a', 'title')
    UNION ALL SELECT id, 'unsafe markup' FROM d WHERE regexp_matches(coalesce(html, ''), '(?i)(<script\\b|<iframe\\b|<(object|embed)\\b|<style\\b|<form\\b|\\son[a-z]+\\s*=|javascript:|data:text/html)')""")
def dq_06_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """All that speaks against a draft: fields, grounding, components, markup."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html", ((text.host(F.col("url")).isNotNull()) & (F.col("page_id") % 4 != 0)).alias("grounded"))
    return drafts.violations(p, ["html", "head", "body", "p", "div", "a", "title"])


@query("WITH a AS (SELECT n_nationkey AS code, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT s_nationkey AS code, count(*) AS n FROM supplier GROUP BY 1) SELECT coalesce(a.code, b.code) AS code, CASE WHEN b.code IS NULL THEN 'missing' WHEN a.code IS NULL THEN 'extra' WHEN b.n > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM a FULL JOIN b ON a.code = b.code")
def dq_08_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes that ought to be there against those that are."""
    return drafts.code_check(table(spark, sf, "nation").select(F.col("n_nationkey").alias("code")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("code")))


@query("SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'novelty out of range' END, CASE WHEN l_discount > 0.08 THEN 'depth out of range' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem")
def dq_11_slate(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings out of their range."""
    rows = table(spark, sf, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    return ground.violations(rows, "key", {"novelty out of range": F.col("l_quantity") > 45, "depth out of range": F.col("l_discount") > 0.08}).select("key.*", "rule")


@query("""WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '([a-z]+) (\\d+)', 1)) AS label, CAST(unnest(regexp_extract_all(text, '([a-z]+) (\\d{1,15})', 2)) AS DOUBLE) AS n FROM (SELECT conv_id, turn, text || ' total ' || (10 + turn % 3) AS text FROM conversations)),
    g AS (SELECT conv_id, label, min(n) AS lo, max(n) AS hi FROM m GROUP BY conv_id, label) SELECT conv_id, label, lo, hi FROM g WHERE (hi - lo) / greatest(abs(hi), 1e-9) > 0.0005""")
def str_19_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of one label in one text that differ by more than five in ten thousand."""
    t = table(spark, sf, "conversations").select("conv_id", F.concat("text", F.lit(" total "), (10 + F.col("turn") % 3).cast("string")).alias("text"))
    return drafts.inconsistent_figures(t, "conv_id")


# whole passes -----------------------------------------------------------------------------------------------------------


@query(q.with_(q.ITEMS, q.REGISTRY, q.OUTCOMES, "fresh AS (SELECT 's' || (ord % (SELECT count(*) FROM customer) + 1) AS id, count(*) AS n_new FROM items GROUP BY 1)",
    "j AS (SELECT r.id, r.status, o.ok, o.item_count, r.status = 'disabled' AS off, " + q.PERMANENT + " AND r.status <> 'disabled' AND r.strikes + 1 >= 3 AS gone FROM registry r LEFT JOIN outcomes o ON o.id = r.id)")
    + "SELECT id, CASE WHEN ok IS NULL THEN status WHEN ok THEN CASE WHEN item_count > 0 THEN 'active' ELSE 'dormant' END WHEN off OR gone THEN 'disabled' ELSE 'failing' END AS status, coalesce(n_new, 0) AS n_new FROM j LEFT JOIN fresh USING (id)")
def pip_02_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """One round of ingestion: the registry after its outcomes, and how many items each source has brought (all of them)."""
    every = F.broadcast(table(spark, sf, "customer").agg(F.count("*").alias("n")))  # one row
    rows = features(spark, sf).select("id", "ord").dropDuplicates(["id"]).crossJoin(every)
    fresh = rows.groupBy(F.concat(F.lit("s"), (F.col("ord") % F.col("n") + 1).cast("string")).alias("id")).agg(F.count("*").alias("n_new"))
    after = health.reconcile(registry(spark, sf), outcomes(spark, sf), v.NOW)
    return after.join(fresh, "id", "left").select("id", "status", F.coalesce("n_new", F.lit(0)).alias("n_new"))


@query(f"WITH c AS (SELECT {_HOST} AS domain, page_id AS ord, url, page_id % 4 + 1 AS seen FROM pages) SELECT domain, arg_min(url, ord) AS url, CAST(sum(seen) AS BIGINT) AS seen FROM c WHERE domain IS NOT NULL GROUP BY domain HAVING sum(seen) >= 3 AND domain NOT IN (SELECT domain FROM c WHERE ord % 9 = 0 AND domain IS NOT NULL)")
def pip_03_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of all generators, one a domain, seen often enough and not yet registered."""
    known = table(spark, sf, "pages").where("page_id % 9 = 0").select("url", F.lit(None).cast("string").alias("resolved_url"))
    return ground.unregistered(ground.merge_candidates(_candidates(spark, sf)).where("domain is not null and seen >= 3"), known).select("domain", "url", "seen")


@query(q.with_(_CAND, _APP) + _LADDER + " SELECT domain, round(trust, 6) AS trust FROM y WHERE reason = 'auto-add'")
def pip_04_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Appraised candidates that become sources."""
    new = _judged(spark, sf).where("decision = 'add'").select("domain")
    return _appraised(spark, sf).join(new, "domain", "left_semi").select("domain", F.round("trust", 6).alias("trust"))


_SERVED = ", ".join(f"('{c}', '{f}', {f not in v.BRIEF_FORMATS})" for f, cs in v.FORMATS.items() for c in cs)


@query(q.FULL_SCORE + f""", col AS (SELECT *, row_number() OVER (ORDER BY total DESC, id) - 1 AS pos FROM total WHERE list_contains(topics, 'history') QUALIFY pos < 4),
    s AS (SELECT cluster_id, sum(total) + log10(1 + count(*)) AS score, max(published_s) AS newest, count(*) AS n, arg_min(title, (-total, id)) AS title, coalesce(arg_min(topics[1], (-total, id)), 'ideas') AS channel FROM total WHERE cluster_id NOT IN (SELECT cluster_id FROM col) GROUP BY cluster_id),
    t AS (SELECT *, row_number() OVER (ORDER BY score DESC, newest DESC, cluster_id) AS turn FROM s QUALIFY turn <= 2),
    served(channel, format, long) AS (VALUES {_SERVED}),
    f AS (SELECT turn, arg_min(coalesce(format, 'field-notes'), (CASE WHEN n >= 2 THEN NOT coalesce(long, false) ELSE coalesce(long, false) END, coalesce(format, 'field-notes'))) AS format FROM t LEFT JOIN served USING (channel) GROUP BY turn)
    SELECT 0 AS turn, 'chronicle' AS format, 'history' AS channel, (SELECT title FROM col WHERE pos = 0) AS title, true AS is_column, id, pos FROM col
    UNION ALL SELECT CAST(t.turn AS INTEGER), format, t.channel, t.title, false, i.id, row_number() OVER (PARTITION BY t.turn ORDER BY i.total DESC, i.id) - 1 FROM t JOIN f USING (turn) JOIN total i USING (cluster_id)""")
def pip_05_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """What to write on a Sunday: the weekly column, then the best stories, each with its format and its items."""
    return catalogue.assignments(Workspace(spark).write(scored(spark, sf), "scored"), None, 6, 3)


_CHECKED = f"""led AS (SELECT url, min(CASE WHEN page_id % 3 = 1 THEN 'high' WHEN page_id % 2 = 0 THEN 'med' ELSE 'low' END) AS tier, min({q.REGISTRABLE.format(x='h')}) AS domain, min(CASE WHEN page_id % 5 = 0 THEN 'curated' ELSE 'researched' END) AS origin FROM (SELECT *, {_HOST} AS h FROM pages WHERE page_id % 7 <> 0) GROUP BY url),
    np AS (SELECT count(*) AS np FROM pages), cit AS (SELECT draft, url FROM (SELECT page_id AS draft, (page_id * 3 + unnest(range(page_id % 4)) * 11) % np AS page_id FROM pages, np) JOIN pages USING (page_id)),
    cs AS (SELECT draft, count(*) AS n_cited, round(count(l.url) / count(*), 6) AS grounded, count(DISTINCT CASE WHEN l.url IS NOT NULL THEN domain || '::' || origin END) AS independent, count(l.url) < count(*) AS loose FROM cit LEFT JOIN led l USING (url) GROUP BY draft),
    cl AS (SELECT page_id AS draft, page_id * 2 + unnest([0, 1]) AS claim, page_id % 10 = 0 AS hs FROM pages WHERE page_id % 3 > 0), cc AS (SELECT claim, url FROM (SELECT claim, (claim * 5 + unnest(range(1 + claim % 3)) * 2) % np AS page_id FROM cl, np) JOIN pages USING (page_id)),
    pc AS (SELECT claim, count(l.url) AS backed, count(*) - count(l.url) AS unknown, count(DISTINCT CASE WHEN l.url IS NOT NULL THEN domain || '::' || origin END) AS ind FROM cc LEFT JOIN led l USING (url) GROUP BY claim),
    cv AS (SELECT draft, count(*) FILTER (backed > 0) / count(*) AS coverage, count(*) FILTER (claim % 2 = 0 AND ind >= 2) / count(*) FILTER (claim % 2 = 0) AS corroboration, sum(unknown) = 0 AND count(*) FILTER (claim % 2 = 0 AND hs AND ind < 2) = 0 AS clean FROM cl JOIN pc USING (claim) GROUP BY draft),
    e AS (SELECT d.id, words, len(list_filter(tags, lambda t: t IN ('img', 'table', 'figure', 'pre', 'blockquote', 'ul'))) AS islands, coalesce(n_cited, 0) AS n_cited, coalesce(grounded, 1) AS grounded, coalesce(independent, 0) AS independent, coalesce(loose, false) AS loose, coverage, corroboration, clean, html, tags FROM d LEFT JOIN cs ON cs.draft = d.id LEFT JOIN cv ON cv.draft = d.id),
    x AS (SELECT *, list_concat([CASE WHEN NOT regexp_matches(coalesce(html, ''), '(?i)<title') THEN 'no title' END, CASE WHEN loose THEN 'not grounded' END, CASE WHEN regexp_matches(coalesce(html, ''), '(?i)(<script\\b|<iframe\\b|<(object|embed)\\b|<style\\b|<form\\b|\\son[a-z]+\\s*=|javascript:|data:text/html)') THEN 'unsafe markup' END,
      CASE WHEN words >= 1500 AND islands < 2 THEN 'too few components' END, CASE WHEN NOT (coverage >= 0.9::DOUBLE AND corroboration >= 0.6::DOUBLE AND clean) THEN 'claims do not hold' END], list_transform(list_filter(tags, lambda t: t NOT IN ('html', 'head', 'body', 'p', 'div', 'a', 'title', 'script', 'style')), lambda t: 'unknown component ' || t)) AS er FROM e)"""


@query(q.with_(_DRAFT, _CHECKED) + "SELECT id, len(list_filter(er, lambda y: y IS NOT NULL)) = 0 AS ok, array_to_string(list_sort(list_filter(er, lambda y: y IS NOT NULL)), '|') AS errors, words, islands, n_cited, CAST(grounded AS DOUBLE) AS grounded, independent, round(coverage, 6) AS coverage, round(corroboration, 6) AS corroboration FROM x")
def pip_06_verified(spark: SparkSession, sf: str) -> DataFrame:
    """The report on all drafts: rules of the text, components, citations against the ledger, claims."""
    n, p = F.col("page_id"), table(spark, sf, "pages")
    many = F.broadcast(p.agg(F.count("*").alias("np")))  # one row
    urls = p.select("page_id", "url")
    ledger = p.where("page_id % 7 <> 0").select("url", F.when(n % 3 == 1, "high").when(n % 2 == 0, "med").otherwise("low").alias("tier"), text.registrable_domain(text.host(F.col("url"))).alias("domain"), F.when(n % 5 == 0, "curated").otherwise("researched").alias("origin"))
    times = lambda k: F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int")))
    cited = p.crossJoin(many).select(n.alias("draft"), F.explode(F.transform(times(n % 4), lambda j: (n * 3 + j * 11) % F.col("np"))).alias("page_id")).join(urls, "page_id").select("draft", "url")
    claims = p.where("page_id % 3 > 0").select(n.alias("draft"), F.explode(F.array(n * 2, n * 2 + 1)).alias("claim"), (n % 10 == 0).alias("high_stakes")).withColumn("load_bearing", F.col("claim") % 2 == 0)
    c = F.col("claim")
    claimed = claims.crossJoin(many).select("claim", F.explode(F.transform(times(1 + c % 3), lambda j: (c * 5 + j * 2) % F.col("np"))).alias("page_id")).join(urls, "page_id").select("claim", "url")
    out = drafts.verified(p.select(n.alias("id"), "html"), cited, ledger, claims, claimed, ["html", "head", "body", "p", "div", "a", "title", "script", "style"], ["img", "table", "figure", "pre", "blockquote", "ul"])
    return out.withColumns({"errors": F.array_join("errors", "|"), **{x: F.round(x, 6) for x in ("grounded", "coverage", "corroboration")}})


@query(q.with_(q.ITEMS) + "SELECT source_type AS grp, count(*) AS n, round(avg(coalesce(trust, 0)), 6) AS trust, count(DISTINCT source) AS sources, max(published_s) AS last_s FROM items GROUP BY source_type")
def pip_08_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard's head figures by type of source, in one pass."""
    return features(spark, sf).groupBy(F.col("source_type").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("trust", F.lit(0.0))), 6).alias("trust"), F.count_distinct("source").alias("sources"), F.max("published_s").alias("last_s"))


@query(q.FULL_SCORE + ", t AS (SELECT * FROM total ORDER BY affinity DESC, id LIMIT 150) SELECT topics[1] AS channel, count(*) AS n, count(DISTINCT cluster_id) AS stories, round(max(total), 5) AS best FROM t GROUP BY 1")
def pip_09_context(spark: SparkSession, sf: str) -> DataFrame:
    """What a writer gets: the 150 best liked items, summed up by channel."""
    t = scored(spark, sf).orderBy(F.desc("affinity"), "id").limit(150)
    return t.groupBy(F.get("topics", 0).alias("channel")).agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("stories"), F.round(F.max("total"), 5).alias("best"))


_FRESH = "u AS (SELECT id, published_s - CASE WHEN ord % 3 = 1 THEN 60 ELSE 0 END AS t FROM items)"


@query(q.with_(q.ITEMS, _FRESH) + f"SELECT id, row_number() OVER (ORDER BY t DESC, id) - 1 AS place FROM u WHERE t >= {v.NOW - 14 * v.DAY}")
def pip_10_archive_update(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh items (every third, a minute earlier) into the archive of all, the last 14 days, the newest first."""
    every = items(spark, sf)
    fresh = every.where("ord % 3 = 1").withColumn("published_s", F.col("published_s") - 60)
    kept = feed.archive(every, fresh, v.NOW).select("id", "published_s")
    return feed.ranked(kept, [F.desc("published_s"), F.col("id")]).select("id", "place")
