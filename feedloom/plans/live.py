"""Queries on reportings and peers, on plugged-in sources, and on streams with keyed state and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import ORACLE_SQL, query
from feedloom.functions import text
from feedloom.operators import divergence as dv
from feedloom.operators import health, measures, timeline
from feedloom.operators.graph import Workspace
from feedloom.plans import sql as q
from feedloom.plans import sources_and_rules  # noqa: F401  its SQL is used here
from feedloom.sources import files, plugin
from feedloom.sources.entities import outcomes, registry, table
from feedloom.streaming import keyed, streams

_REPLICATES = 32


def _reportings(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as reportings: the label is the event, every 23rd vector is of one outlet, outlets lean from -2 to 2."""
    n = F.col("vec_id")
    return table(spark, sf, "embeddings").select(F.col("label").alias("event"), n.alias("id"), (n % 23).alias("outlet"), (n % 23 % 5 - 2).alias("lean"), F.col("embedding").alias("vector"))


_REPORTED = f"""r AS MATERIALIZED (SELECT label AS event, vec_id AS id, vec_id % 23 AS outlet, vec_id % 23 % 5 - 2 AS lean, list_transform(embedding, lambda y: CAST(y AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * z)))) AS u FROM embeddings WHERE label IS NOT NULL),
    d AS MATERIALIZED (SELECT event, id, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM r),
    w AS MATERIALIZED (SELECT event, id, b, len(list_filter({dv.DRAWS}, lambda t: t <= CAST('0x' || substr(md5(id || ':' || b), 1, 8) AS BIGINT))) AS w FROM r, (SELECT unnest(range({_REPLICATES})) AS b)),
    s AS (SELECT event, i, sum(x) AS s FROM d GROUP BY ALL), l AS (SELECT event, sum(s * s) AS l FROM s GROUP BY event), n AS (SELECT event, count(*) AS n FROM r GROUP BY event),
    sb AS (SELECT event, b, sum(s * s) AS l FROM (SELECT event, b, i, sum(w * x) AS s FROM d JOIN w USING (event, id) GROUP BY ALL) GROUP BY ALL), wb AS (SELECT event, b, sum(w) AS m, sum(w * w) AS k FROM w GROUP BY ALL),
    e AS (SELECT event, list_sort(list(50 * (1 - (l - k) / (m * m - k))) FILTER (m * m - k > 0)) AS e FROM sb JOIN wb USING (event, b) GROUP BY event),
    a AS (SELECT event, id, outlet, lean, sum(x * s) / sqrt(any_value(l)) AS near FROM d JOIN s USING (event, i) JOIN l USING (event) JOIN r USING (event, id) GROUP BY ALL),
    index AS (SELECT event, n, CASE WHEN n > 1 THEN 50 * (1 - (l - n) / (n * n - n)) END AS divergence, CASE WHEN n > 1 THEN e[greatest(1, CAST(ceil(0.025::DOUBLE * len(e)) AS BIGINT))] END AS low, CASE WHEN n > 1 THEN e[CAST(ceil(0.975::DOUBLE * len(e)) AS BIGINT)] END AS high FROM n JOIN l USING (event) JOIN e USING (event)),
    agreed AS (SELECT event, 100 * count(*) FILTER (near >= 0.3::DOUBLE) / count(*) AS corroboration, count(DISTINCT outlet) AS outlets, count(DISTINCT outlet) FILTER (near >= 0.3::DOUBLE) AS confirming,
      bool_or(near >= 0.3::DOUBLE AND lean < 0) AND bool_or(near >= 0.3::DOUBLE AND lean > 0) AS both_sides, arg_min(id, (-near, id)) AS quoted FROM a GROUP BY event)"""


@query(q.with_(_REPORTED) + "SELECT event, n, round(divergence, 6) AS divergence, round(low, 6) AS low, round(high, 6) AS high, round(corroboration, 6) AS corroboration, outlets, confirming, both_sides, quoted FROM index JOIN agreed USING (event)")
def spc_02_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """How far the reportings of each event lie apart, with resampled bounds, and which outlets agree with its core."""
    out = dv.divergence(_reportings(spark, sf), _REPLICATES, 0.3)
    return out.withColumns({c: F.round(c, 6) for c in ("divergence", "low", "high", "corroboration")})


@query(q.with_(_REPORTED) + "SELECT event, n < 60 AS provisional, round(CASE WHEN n < 60 THEN greatest(0, divergence - 2 * (divergence - low)) ELSE low END, 6) AS low, round(CASE WHEN n < 60 THEN least(100, divergence + 2 * (high - divergence)) ELSE high END, 6) AS high FROM index")
def spc_04_provisional(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of few rows are shown with ranges twice as wide."""
    out = dv.widened(dv.divergence(_reportings(spark, sf), _REPLICATES, 0.3), 60)
    return out.select("event", "provisional", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH o AS (SELECT DISTINCT o_custkey AS event, o_orderkey % 11 AS outlet, o_orderkey % 11 % 3 - 1 AS lean FROM orders), n AS (SELECT event, count(*) FILTER (lean < 0) AS "left", count(*) FILTER (lean = 0) AS center, count(*) FILTER (lean > 0) AS "right" FROM o GROUP BY event)
    SELECT event, "left", center, "right", CASE WHEN "right" >= 2 AND "left" <= 0.1::DOUBLE * "right" THEN 'left' WHEN "left" >= 2 AND "right" <= 0.1::DOUBLE * "left" THEN 'right' END AS blind FROM n""")
def spc_05_blindspots(spark: SparkSession, sf: str) -> DataFrame:
    """Events (here: customers, reported on by orders) that one side hardly covers."""
    k = F.col("o_orderkey")
    return dv.blindspots(table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), (k % 11).alias("outlet"), (k % 11 % 3 - 1).alias("lean")), 0.1, 2)


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS key, year(o_orderdate) AS period, CASE WHEN o_orderkey % 17 <> 0 THEN floor(o_totalprice / 500) END AS value FROM orders)
    SELECT id, CASE WHEN value IS NOT NULL THEN count(value) OVER g END AS n, CASE WHEN value IS NOT NULL THEN round(100 * (rank() OVER (PARTITION BY key, period, value IS NULL ORDER BY value) - 1 + count(*) OVER (PARTITION BY key, period, value) / 2) / count(value) OVER g, 6) END AS percentile FROM c WINDOW g AS (PARTITION BY key, period)""")
def spc_01_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Mid-rank percentiles among the orders of one priority and year; those without a value are no peers."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("key"), F.year("o_orderdate").alias("period"), F.when(k % 17 != 0, F.floor(F.col("o_totalprice") / 500)).alias("value"))
    return measures.percentiles(rows, ["key", "period"], "value", "id").select("id", "n", F.round("percentile", 6).alias("percentile"))


# plugged-in sources ---------------------------------------------------------------------------------------------------

_PLUGGED = "SELECT doc_id AS ord, source, length(text) AS n, 'feedloom_items' AS source_id, 'rss' AS source_type FROM documents"


def _plugged(df: DataFrame) -> DataFrame:
    return df.select("ord", "source", F.length("body").cast("bigint").alias("n"), "source_id", "source_type")


@query(_PLUGGED)
def ext_01_source_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All items of a plugged-in source, split by row groups."""
    return _plugged(spark.read.format(plugin.register(spark, plugin.ParquetItems)).option("path", f"{sf}/documents.parquet").load())


@query(_PLUGGED)
def ext_02_source_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same source read as a stream, whose offsets are numbers of splits."""
    stream = spark.readStream.format(plugin.register(spark, plugin.ParquetItems)).option("path", f"{sf}/documents.parquet").load()
    return streams.drain(_plugged(stream), "items")


# keyed state and event time -------------------------------------------------------------------------------------------


@query(ORACLE_SQL["stf_01_health"])
def stf_01_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Source health as state by key in a stream of outcomes; sources without an outcome stay as the registry has them."""
    r = registry(spark, sf)
    seen = outcomes(spark, sf).withColumns({"permanent": health.permanent(), "at_ts": F.timestamp_seconds(F.lit(v.NOW))})
    rows, _ = keyed.fed([seen.select("id", "at_ts", "ok", "permanent", "item_count")], Workspace(spark), "health", lambda s: keyed.source_health(s, r))
    now = keyed.last_turns(rows.where("kind = 'outcome'"), "id").drop("turn", "kind")
    rest = r.join(now.select("id"), "id", "left_anti").select("id", "status", "enabled", "strikes", "disabled_s", "last_ok_s", F.lit(None).cast("string").alias("last_error"), F.lit(False).alias("rediscover"))
    return now.unionByName(rest)


@query(q.with_(q.EVENTS) + f"SELECT item_id, max(at_s) AS at_s, round(sum(({q.WEIGHT}) * power(0.5::DOUBLE, ((SELECT max(at_s) FROM ev f WHERE f.item_id = ev.item_id) - at_s) / {7.0 * v.DAY}::DOUBLE)), 6) AS w FROM ev GROUP BY item_id")
def stf_07_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's engagement as state by key, decayed to its last event, in three parts that come out of order."""
    rows = table(spark, sf, "events")
    e = streams.weighted(rows).where("type is not null").select("item_id", "at_ts", "w", F.day("at_ts").alias("day"))
    parts = [e.where(c).drop("day") for c in ("day between 11 and 20", "day <= 10", "day > 20")]
    out, _ = keyed.fed(parts, Workspace(spark), "weights", keyed.item_weights)
    return keyed.last_turns(out, "item_id").select("item_id", "at_s", F.round("w", 6).alias("w"))


@query(f"""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) // {v.DAY} AS day FROM events), k AS (SELECT day, count(*) AS n FROM e GROUP BY day)
    SELECT CAST(day AS VARCHAR) AS what, n FROM k UNION ALL SELECT 'behind the watermark', count(*) FROM e WHERE day < (SELECT min(day) FROM e) + 10""")
def stm_08_event_time(spark: SparkSession, sf: str) -> DataFrame:
    """Events once each by event time; repeats within two days go, and rows behind the watermark are counted.

    The table comes in order in three parts; the second repeats the end of the first, and the last is followed by the first
    ten days again under new ids, all of them behind the watermark by then.
    """
    day = F.floor(F.unix_timestamp("at_ts") / v.DAY)
    e = streams.weighted(table(spark, sf, "events")).select(F.col("event_id").cast("string").alias("key"), "at_ts", day.alias("day"))
    first = e.agg(F.min("day")).first()[0] or 0
    span = lambda a, b: e.where(F.col("day").between(first + a, first + b))
    again = span(0, 9).withColumn("key", F.concat(F.lit("again-"), "key"))
    parts = [span(0, 14), span(14, 20), e.where(F.col("day") > first + 20), again]
    rows, late = keyed.fed(parts, Workspace(spark), "once", lambda s: keyed.distinct_events(s, "key", "at_ts", "2 days"), "append")
    days = rows.groupBy("day").agg(F.count("*").alias("n")).select(F.col("day").cast("string").alias("what"), "n")
    return days.union(spark.createDataFrame([("behind the watermark", late)], "what string, n bigint"))


# transcripts, timelines, shards ---------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, role, list_filter(string_split_regex(text, '[.!?]\\s+'), lambda y: y <> '') AS s FROM conversations), c AS (SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS x, CASE WHEN generate_subscripts(s, 1) = 1 THEN role END AS who FROM t),
    l AS (SELECT conv_id, list({'d': [{'speaker': CAST(NULL AS VARCHAR), 'text': ''}][1:0], 'who': who, 't': x} ORDER BY turn, k) AS l, arg_min(who, (turn, k)) AS w FROM c GROUP BY conv_id),
    r AS (SELECT conv_id, list_reduce(list_prepend({'d': [{'speaker': CAST(NULL AS VARCHAR), 'text': ''}][1:0], 'who': w, 't': ''}, l), lambda p, y: CASE WHEN y.who IS NOT NULL AND y.who IS DISTINCT FROM p.who
        THEN CASE WHEN length(y.t) >= 500 THEN {'d': list_append(CASE WHEN trim(p.t) = '' THEN p.d ELSE list_append(p.d, {'speaker': p.who, 'text': trim(p.t)}) END, {'speaker': y.who, 'text': trim(y.t)}), 'who': y.who, 't': ''} ELSE {'d': CASE WHEN trim(p.t) = '' THEN p.d ELSE list_append(p.d, {'speaker': p.who, 'text': trim(p.t)}) END, 'who': y.who, 't': y.t} END
        WHEN length(CASE WHEN p.t = '' THEN y.t ELSE p.t || ' ' || y.t END) >= 500 THEN {'d': list_append(p.d, {'speaker': p.who, 'text': trim(CASE WHEN p.t = '' THEN y.t ELSE p.t || ' ' || y.t END)}), 'who': y.who, 't': ''}
        ELSE {'d': p.d, 'who': p.who, 't': CASE WHEN p.t = '' THEN y.t ELSE p.t || ' ' || y.t END} END) AS r FROM l)
    SELECT conv_id, CAST(n AS INTEGER) AS n, p.speaker AS speaker, p.text AS text FROM (SELECT conv_id, unnest(range(len(f))) AS n, unnest(f) AS p FROM (SELECT conv_id, CASE WHEN trim(r.t) = '' THEN r.d ELSE list_append(r.d, {'speaker': r.who, 'text': trim(r.t)}) END AS f FROM r))""")
def str_12_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts: the sentences of a turn are cues, of which the first names the speaker; cues become paragraphs."""
    s = F.filter(F.split("text", r"[.!?]\s+"), lambda x: x != "")
    cues = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.posexplode(s).alias("k", "x"))
    cue = F.struct("turn", "k", F.when(F.col("k") == 0, F.col("role")).alias("speaker"), F.col("x").alias("text"))
    talks = cues.groupBy("conv_id").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    return talks.select("conv_id", F.posexplode(text.paragraphs(F.col("cues"))).alias("n", "p")).select("conv_id", "n", "p.speaker", "p.text")


@query()
def win_14_label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as labels on a timeline for each customer: from their day on, as long as their price is high."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    labels = table(spark, sf, "orders").select(F.col("o_custkey").alias("timeline"), F.col("o_orderkey").alias("ord"), day.alias("start"), (day + F.floor(F.col("o_totalprice") / 1000).cast("int")).alias("stop"))
    return timeline.packed_rows(labels, 2).select("timeline", "ord", "row")


@query(f"SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) // {v.DAY} AS day, CASE WHEN event_id % 5 = 0 AND day(ts) > 20 THEN value + 1 ELSE value END AS value FROM events")
def spc_06_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Events in shards by day; fresh values for some rows of the last days replace the old ones there, other shards keep their files."""
    path = Workspace(spark).folder("shards")
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"), "value", F.day("ts").alias("d"))
    files.write_shards(e.drop("d"), path, ["day"])
    fresh = e.where("id % 5 = 0 and d > 20").withColumn("value", F.col("value") + 1).drop("d")
    return files.write_shards(fresh, path, ["day"]).select("id", F.col("day").cast("bigint").alias("day"), "value")
