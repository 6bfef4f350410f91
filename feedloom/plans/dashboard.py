"""Queries behind the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import text
from feedloom.operators import analytics
from feedloom.plans import sql as q
from feedloom.plans.feeds import scored
from feedloom.sources.entities import items, table


@query(q.with_(q.ITEMS, "t AS (SELECT ord, unnest(topics) AS c FROM items)") + "SELECT a.c AS a, b.c AS b, count(*) AS n FROM t a JOIN t b ON a.ord = b.ord AND a.c <> b.c GROUP BY ALL")
def agg_05_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.cooccurrence(items(spark, sf))


@query(q.FULL_SCORE + f""", r AS (SELECT *, {q.group('topics[1]')} AS grp, topics[1] AS channel FROM total), c AS (SELECT cluster_id, grp, channel, count(*) AS n FROM r GROUP BY ALL),
    g AS (SELECT cluster_id, grp, sum(n) AS g FROM c GROUP BY ALL), bg AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY g DESC, grp) AS rn, sum(g) OVER (PARTITION BY cluster_id) AS size FROM g),
    bc AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, grp ORDER BY n DESC, channel) AS rn FROM c), bt AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, id) AS rn FROM r)
    SELECT cluster_id, CAST(size AS BIGINT) AS size, grp, bc.channel, bt.title, round(bt.total, 5) AS best FROM bg JOIN bc USING (cluster_id, grp) JOIN bt USING (cluster_id) WHERE bg.rn = 1 AND bc.rn = 1 AND bt.rn = 1""")
def agg_06_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.cluster_summary(scored(spark, sf)).withColumn("best", F.round("best", 5))


@query(q.with_(q.ITEMS, "t AS (SELECT unnest(topics) AS channel, coalesce(trust, 0) AS x FROM items)") + "SELECT channel, count(*) AS n, round(avg(x), 6) AS mean FROM t GROUP BY channel")
def agg_08_channels(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.per_channel(items(spark, sf)).withColumn("mean", F.round("mean", 6))


@query(q.with_(q.ITEMS) + "SELECT source, count(*) AS n, round(avg(coalesce(trust, 0)), 6) AS mean FROM items GROUP BY source")
def agg_09_sources(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("trust", F.lit(0.0))), 6).alias("mean"))


@query(q.with_(q.ITEMS) + "SELECT source_type, kind, count(*) AS n FROM items GROUP BY ALL")
def agg_10_tally(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy("source_type", "kind").agg(F.count("*").alias("n"))


@query(q.with_(q.ITEMS, f"m AS (SELECT *, {q.minutes('body')} AS m FROM items)") + "SELECT count(*) AS n, round(sum(m) / 60.0, 6) AS hours, median(m) AS median, count(DISTINCT topics[1]) AS channels, count(DISTINCT source) AS sources, count(*) FILTER (m >= 5) AS long_reads, min(published_s) AS first_s, max(published_s) AS last_s FROM m")
def agg_12_hero(spark: SparkSession, sf: str) -> DataFrame:
    m = items(spark, sf).withColumn("m", text.read_minutes(F.col("body"))).withColumn("channel", F.get("topics", 0))
    return m.agg(F.count("*").alias("n"), F.round(F.sum("m") / 60, 6).alias("hours"), F.percentile("m", F.lit(0.5)).alias("median"), F.count_distinct("channel").alias("channels"), F.count_distinct("source").alias("sources"), F.count_if(F.col("m") >= 5).alias("long_reads"), F.min("published_s").alias("first_s"), F.max("published_s").alias("last_s"))


@query(q.with_(q.ITEMS, f"h AS (SELECT least({q.minutes('body')} // 2, 29) AS bin, count(*) AS n FROM items GROUP BY 1)") + "SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(30) r LEFT JOIN h ON h.bin = r.range")
def agg_16_read_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.histogram(items(spark, sf), text.read_minutes(F.col("body")), 2, 30)


@query("WITH h AS (SELECT least(CAST(floor(l_discount / 0.1::DOUBLE) AS BIGINT), 9) AS bin, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1) SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(10) r LEFT JOIN h ON h.bin = r.range")
def agg_17_trust_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """On the large star view, where the discount stands for trust."""
    return analytics.histogram(table(spark, sf, "lineitem"), F.col("l_discount"), 0.1, 10)


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, greatest(5, least(40, CAST(ceil(log2(count(value))) AS BIGINT) + 1)) AS bins FROM events)
    SELECT CAST(least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS BIGINT) AS bin, bins, count(*) AS n FROM events, s WHERE value IS NOT NULL GROUP BY ALL""")
def agg_18_bins(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.equal_bins(table(spark, sf, "events"), "value")


@query(q.with_(q.ITEMS, f"m AS (SELECT source_type, {q.minutes('body')} AS m FROM items)") + "SELECT source_type, min(m) AS lo, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS median, quantile_cont(m, 0.75) AS q3, max(m) AS hi, count(m) AS n FROM m GROUP BY source_type")
def agg_19_box(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.box(items(spark, sf).withColumn("m", text.read_minutes(F.col("body"))), "source_type", "m")


_G = list(v.GROUPS)


@query(q.with_(q.ITEMS, f"w AS (SELECT published_s // {v.DAY} - (published_s // {v.DAY} + 3) % 7 AS week, {q.group('topics[1]')} AS grp FROM items)") + f"SELECT week, {', '.join(f'count(*) FILTER (grp = {g!r}) AS {g}' for g in _G)} FROM w GROUP BY week ORDER BY week DESC LIMIT 26")
def agg_20_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.weekly(items(spark, sf))


@query(q.with_(q.ITEMS, f"d AS (SELECT published_s // {v.DAY} AS day, count(*) AS n FROM items GROUP BY 1)", "e AS (SELECT min(day) AS lo, max(day) AS hi FROM d)") + "SELECT r.day, coalesce(n, 0) AS n FROM (SELECT unnest(range(CASE WHEN hi - lo + 1 > 400 THEN hi - 364 ELSE lo END, hi + 1)) AS day FROM e) r LEFT JOIN d ON d.day = r.day")
def agg_21_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.calendar(items(spark, sf))


@query(q.with_(q.REGISTRY, "o AS (SELECT 's' || o_custkey AS id, o_totalprice / 100000 AS trust, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS p FROM orders)") + "SELECT r.id, status, count(o.id) AS n_items, floor(coalesce(avg(trust), 0) * 10 + 0.5) / 10 AS mean_trust, max(p) AS last_s FROM registry r LEFT JOIN o ON o.id = r.id GROUP BY r.id, status")
def jon_02_source_health(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with and without items: orders stand for the items."""
    from feedloom.sources.entities import registry, seconds

    orders = table(spark, sf, "orders").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("source"), (F.col("o_totalprice") / 100000).alias("trust"), seconds(F.col("o_orderdate")).alias("published_s"))
    return analytics.source_health(orders, registry(spark, sf))


@query("WITH s AS (SELECT l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, round(v, 4) AS v, round(v / sum(v) OVER (), 6) AS share, round(v / max(v) OVER (), 6) AS ratio FROM s")
def agg_36_shares(spark: SparkSession, sf: str) -> DataFrame:
    s = analytics.shares(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    return s.select("l_returnflag", F.round("v", 4).alias("v"), F.round("share", 6).alias("share"), F.round("ratio", 6).alias("ratio"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS live, coalesce(b.n, 0) AS snapshot FROM (SELECT event_type AS k, count(*) AS n FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1) a FULL JOIN (SELECT event_type AS k, count(*) AS n FROM events WHERE user_id % 2 = 1 AND event_type <> 'error' GROUP BY 1) b ON a.k = b.k")
def jon_13_live_and_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("event_type", "k")
    count = lambda rows: rows.groupBy("k").agg(F.count("*").alias("n"))
    return analytics.compare_counts(count(e.where("user_id % 2 = 0 and k <> 'view'")), count(e.where("user_id % 2 = 1 and k <> 'error'")), "k")


@query("SELECT count(*) AS n, sum(try_cast(regexp_extract(props, '(\\d+)', 1) AS DOUBLE)) AS total FROM events")
def agg_31_coerced_sum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.sum(F.regexp_extract("props", r"(\d+)", 1).try_cast("double")).alias("total"))


_PAIR = "list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])"


@query(f"WITH t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations), g AS (SELECT conv_id, turn, unnest({_PAIR}) AS g FROM t WHERE len(w) >= 3), c AS (SELECT conv_id, turn, g, count(*) AS n FROM g GROUP BY ALL) SELECT conv_id, turn, max(n) AS most FROM c GROUP BY ALL")
def win_15_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """How often a turn's most frequent three-word sequence occurs in it."""
    w = F.filter(F.split(text.normalise_title(F.col("text")), " "), lambda x: x != "")
    t = table(spark, sf, "conversations").select("conv_id", "turn", w.alias("w")).where(F.size("w") >= 3)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    return t.select("conv_id", "turn", F.explode(grams).alias("g")).groupBy("conv_id", "turn", "g").agg(F.count("*").alias("n")).groupBy("conv_id", "turn").agg(F.max("n").alias("most"))


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def win_03_first(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w).cast("bigint")).where("n = 1").select("user_id", "event_id", "n")


@query("SELECT regr_slope(l_extendedprice, l_quantity) IS NOT NULL AS fitted, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem")
def mth_17_linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    slope = F.regr_slope("l_extendedprice", "l_quantity")
    return table(spark, sf, "lineitem").agg(slope.isNotNull().alias("fitted"), F.round(slope, 3).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 1).alias("intercept"))
