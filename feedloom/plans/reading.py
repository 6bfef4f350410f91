"""More queries: sources and videos, cluster selection, order keys, retention, shares, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import scoring, sources, text
from feedloom.operators import feed, ground, health
from feedloom.plans import sql as q
from feedloom.plans.feeds import rank, scored, scored_table, written
from feedloom.sources.entities import engagements, items, outcomes, pick, registry, seconds, table

_HOST = "coalesce(nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\\.', ''), ''), '')"
_PATH = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id, CASE WHEN contains({_HOST}, 'arxiv.org') THEN 'arxiv' WHEN contains({_HOST}, 'reddit.com') THEN 'reddit' WHEN regexp_matches({_HOST}, '(^|\\.)blog\\.') OR regexp_matches({_PATH}, '/blog(/|$)') OR contains({_HOST}, 'eng') THEN 'eng-blog' ELSE 'rss' END AS type FROM pages")
def prj_08_source_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", sources.source_type(F.col("url")).alias("type"))


_VIDEO = "vid AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 11) WHEN 1 THEN 'https://youtu.be/' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 11) WHEN 2 THEN 'https://m.youtube.com/shorts/' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 11) WHEN 3 THEN 'https://youtube.com/embed/' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 11) ELSE 'https://e.example/' || o_orderkey END AS url FROM orders)"


def _videos(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    vid = F.substring(F.md5(k.cast("string").cast("binary")), 1, 11)
    url = F.when(k % 5 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), vid)).when(k % 5 == 1, F.concat(F.lit("https://youtu.be/"), vid)).when(k % 5 == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), vid)).when(k % 5 == 3, F.concat(F.lit("https://youtube.com/embed/"), vid)).otherwise(F.concat(F.lit("https://e.example/"), k.cast("string")))
    return table(spark, sf, "orders").select(k.alias("k"), url.alias("url"))


@query(q.with_(_VIDEO) + "SELECT k, coalesce(nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '/(?:embed|live)/([A-Za-z0-9_-]{11})', 1), '')) AS video, regexp_matches(lower(url), '^https?://((www|m)\\.)?youtube\\.com/shorts/') AS short FROM vid")
def url_03_video_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _videos(spark, sf).select("k", sources.video_id(F.col("url")).alias("video"), sources.is_short(F.col("url")).alias("short"))


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey * 1000 AS subs, CAST(floor(o_totalprice) AS BIGINT) AS views, CAST(floor(o_totalprice) AS BIGINT) // (10 + o_orderkey % 40) AS likes, (o_orderkey % 1000)::DOUBLE AS age, o_orderkey % 300 AS secs FROM orders),
    p AS (SELECT k, secs, 0.35::DOUBLE * CASE WHEN subs > 0 THEN least(greatest((log10(subs) - 3) / 4, 0), 1) ELSE 0 END + 0.3::DOUBLE * CASE WHEN likes > 0 AND views > 0 THEN least(likes / views / 0.08::DOUBLE, 1) ELSE 0 END + 0.2::DOUBLE * CASE WHEN views <= 0 THEN 0 WHEN subs <= 0 THEN 0.5::DOUBLE ELSE least(views / subs, 1) END + 0.15::DOUBLE * least(greatest(1 - age / 730, 0), 1) AS t FROM s)
    SELECT k, round(CASE WHEN secs < 60 THEN t * 0.85::DOUBLE ELSE t END, 6) AS score FROM p""")
def mth_07_credibility(spark: SparkSession, sf: str) -> DataFrame:
    k, views = F.col("o_orderkey"), F.floor("o_totalprice")
    c = sources.credibility(F.col("o_custkey") * 1000, views, F.floor(views / (10 + k % 40)), (k % 1000).cast("double"), k % 300)
    return table(spark, sf, "orders").select(k.alias("k"), F.round(c, 6).alias("score"))


@query("SELECT page_id, round(least(least(greatest(CASE WHEN page_id % 4 = 0 THEN 0.5::DOUBLE ELSE (page_id % 13) / 10.0::DOUBLE END, 0), 1) + CASE WHEN starts_with(url, 'https:') THEN 0.05::DOUBLE ELSE 0 END, 1), 6) AS trust FROM pages")
def mth_10_candidate_trust(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, sf, "pages").select(n, F.round(sources.candidate_trust(F.col("url"), F.when(n % 4 != 0, n % 13 / 10)), 6).alias("trust"))


@query("SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 3.0 ELSE round(least(value * 1000 / 30000.0::DOUBLE, 5.0), 6) END AS w FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def mth_11_event_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = engagements(spark, sf)[0]
    raw = F.when(F.col("type") == "open", "view").when(F.col("type") == "read", "click").otherwise("purchase")
    return e.select("event_id", raw.alias("event_type"), F.round(scoring.event_weight(F.col("type"), F.col("dwell_ms")), 6).alias("w"))


_SLATE = {"novelty": 0.30, "depth": 0.20, "craft": 0.20, "timeliness": 0.17, "fit": 0.13}


@query("SELECT l_orderkey, l_linenumber, round(0.3::DOUBLE * l_discount + 0.2::DOUBLE * l_tax + 0.2::DOUBLE * (l_quantity / 50) + 0.17::DOUBLE * (l_linenumber / 7.0::DOUBLE) + 0.13::DOUBLE * (l_suppkey % 10 / 10.0::DOUBLE), 6) AS score FROM lineitem")
def mth_06_blended(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted mean of five scores."""
    parts = {"novelty": F.col("l_discount"), "depth": F.col("l_tax"), "craft": F.col("l_quantity") / 50, "timeliness": F.col("l_linenumber") / 7, "fit": F.col("l_suppkey") % 10 / 10}
    blended = sum((F.lit(w) * parts[k] for k, w in _SLATE.items()), F.lit(0.0)) / sum(_SLATE.values())
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(blended, 6).alias("score"))


@query(q.FULL_SCORE + "SELECT cluster_id, round(sum(total) + log10(1 + count(*)), 5) AS score, max(published_s) AS newest_s, count(*) AS n FROM total GROUP BY cluster_id")
def agg_07_cluster_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).groupBy("cluster_id")
    return s.agg(F.round(F.sum("total") + F.log10(1 + F.count("*")), 5).alias("score"), F.max("published_s").alias("newest_s"), F.count("*").alias("n"))


@query(q.with_(q.ITEMS) + "SELECT channel, count(*) AS n FROM (SELECT unnest(topics) AS channel FROM items) GROUP BY channel")
def agg_11_channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(F.explode("topics").alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))


@query(q.with_(q.ITEMS) + f"SELECT source, floor(avg({q.minutes('body')}) * 10 + 0.5) / 10 AS mean_minutes, max(published_s) AS last_s, count(DISTINCT topics[1]) AS channels FROM items GROUP BY source")
def agg_14_sources(spark: SparkSession, sf: str) -> DataFrame:
    m = items(spark, sf).withColumn("m", text.read_minutes(F.col("body")))
    return m.groupBy("source").agg((text.half_up(F.avg("m") * 10) / 10).alias("mean_minutes"), F.max("published_s").alias("last_s"), F.count_distinct(F.get("topics", 0)).alias("channels"))


@query(q.with_(q.REGISTRY, q.OUTCOMES) + "SELECT http_status, count(*) AS n FROM registry JOIN outcomes USING (id) WHERE NOT ok GROUP BY http_status ORDER BY n DESC, http_status LIMIT 15")
def agg_32_failures(spark: SparkSession, sf: str) -> DataFrame:
    bad = registry(spark, sf).join(outcomes(spark, sf).where("not ok"), "id")
    return bad.groupBy("http_status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "http_status").limit(15)


@query(q.FULL_SCORE + f"SELECT id, count(*) OVER (PARTITION BY cluster_id) AS n FROM total WHERE {q.minutes('body')} >= 3")
def agg_33_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of stories among the items that pass a gate."""
    rows = scored(spark, sf).where(F.col("minutes") >= 3).select("id", "cluster_id")
    size = feed.Workspace(spark).write(rows.groupBy("cluster_id").agg(F.count("*").alias("n")), "sizes")
    return rows.join(size, "cluster_id").select("id", "n")


@query(q.with_(q.ITEMS) + "SELECT list_sort(topics)[1] AS facet, kind, count(*) AS n FROM items GROUP BY ALL")
def agg_34_facets(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy(F.array_min("topics").alias("facet"), "kind").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, round(n / max(n) OVER (), 6) AS level FROM d")
def agg_37_sparkline(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    top = F.broadcast(n.agg(F.max("n").alias("top")))
    return n.crossJoin(top).select("user_id", F.round(F.try_divide("n", "top"), 6).alias("level"))


@query("SELECT s_suppkey, n_name, r_name, CASE WHEN s_acctbal >= 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def prj_16_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups in small fixed dimensions."""
    n, r = F.broadcast(table(spark, sf, "nation")), F.broadcast(table(spark, sf, "region"))
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name", F.when(F.col("s_acctbal") >= 0, 2.0).otherwise(1.0).alias("weight"))


@query("WITH t AS (SELECT event_type, max(CAST(try_cast(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) IS NULL AS INT)) = 1 AS x, max(CAST(try_cast(props AS DOUBLE) IS NULL AS INT)) = 1 AS y FROM events GROUP BY event_type) SELECT event_type, x AS key_is_text, y AS props_is_text FROM t")
def prj_15_axis_types(spark: SparkSession, sf: str) -> DataFrame:
    """A column is a text axis if any value is no number."""
    is_text = lambda c: F.bool_or(c.try_cast("double").isNull())
    return table(spark, sf, "events").groupBy("event_type").agg(is_text(F.regexp_extract("props", r"(\d+)", 1)).alias("key_is_text"), is_text(F.col("props")).alias("props_is_text"))


@query(q.with_(q.ITEMS) + f"SELECT id FROM items WHERE {v.NOW // v.DAY} - published_s // {v.DAY} >= 3")
def flt_11_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Whole UTC days; at least one day stays."""
    return items(spark, sf).where(F.lit(v.NOW // v.DAY) - F.floor(F.col("published_s") / v.DAY) >= max(1, 3)).select("id")


@query(q.with_(q.ITEMS, "f AS (SELECT unnest(['chronicle', 'dispatch']) AS format, unnest([['history', 'geopolitics', 'geography'], ['data-science', 'ds-sports', 'finance', 'science', 'ai', 'quantum']]) AS cs)") + "SELECT DISTINCT id, format FROM items, f WHERE list_has_any(topics, cs)")
def jon_16_formats(spark: SparkSession, sf: str) -> DataFrame:
    served = F.broadcast(spark.createDataFrame([(c, f) for f in ("chronicle", "dispatch") for c in v.FORMATS[f]], "channel string, format string"))
    return items(spark, sf).select("id", F.explode("topics").alias("channel")).join(served, "channel").select("id", "format").distinct()


@query(q.with_(q.REGISTRY) + "SELECT r.id, coalesce(CASE WHEN n % 6 = 0 THEN 'failing' END, status) AS status, coalesce(CASE WHEN n % 6 = 0 THEN 2 END, strikes) AS strikes FROM registry r")
def jon_03_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse overlay whose present fields win."""
    r = registry(spark, sf)
    over = r.where("n % 6 = 0").select("id", F.lit("failing").alias("o_status"), F.lit(2).cast("bigint").alias("o_strikes"))
    return r.join(over, "id", "left").select("id", F.coalesce("o_status", "status").alias("status"), F.coalesce("o_strikes", "strikes").alias("strikes"))


@query(q.with_(q.ITEMS, q.TOKENS) + """, cls AS (SELECT words, min(ord) AS c FROM tok WHERE len(words) > 0 GROUP BY words), e AS (SELECT ord, unnest(entities) AS e FROM items),
    k AS (SELECT a.ord, a.e AS p, b.e AS r FROM e a JOIN e b ON a.ord = b.ord AND a.e < b.e), kf AS (SELECT p, r, min(ord) AS x FROM k GROUP BY p, r)
    SELECT a.c AS x, b.c AS y, 'title' AS kind FROM cls a JOIN cls b ON a.c < b.c WHERE len(list_intersect(a.words, b.words)) >= 0.6::DOUBLE * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) - 1e-9
    UNION ALL SELECT c, ord, 'member' FROM tok JOIN cls USING (words) WHERE ord <> c UNION ALL SELECT DISTINCT x, ord, 'entities' FROM k JOIN kf USING (p, r) WHERE ord <> x""")
def jon_10_story_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Like titles as pairs between classes of equal titles, and who is in a class or shares two entities; no copies are opened into pairs."""
    return feed.story_links(items(spark, sf).select("ord", "title", "entities"))


@query(q.with_(q.ITEMS, "e AS (SELECT DISTINCT ord, unnest(entities) AS e FROM items)", "k AS (SELECT a.ord, a.e AS p, b.e AS r FROM e a JOIN e b ON a.ord = b.ord AND a.e < b.e)") + "SELECT ord, p, r, min(ord) OVER (PARTITION BY p, r) AS first, count(*) OVER (PARTITION BY p, r) AS n FROM k QUALIFY n > 1")
def jon_10_entity_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The classes behind the links by entities: any two items of a class share its pair."""
    return feed.entity_classes(items(spark, sf).select("ord", "entities")).select("ord", "k.p", "k.r", "first", "n")



_OK = f"({q.minutes('body')} >= 7)"


@query(q.FULL_RANK + f"SELECT id, {_OK} AND sum(CAST({_OK} AS INT)) OVER (ORDER BY place) <= 10 AS featured FROM ranked")
def win_08_featured(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten that are eligible; the rest keeps its order."""
    rows = scored_table(spark, sf)
    best = F.broadcast(feed.featured(rows).withColumn("featured", F.lit(True)))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("featured", F.lit(False)).alias("featured"))


# fixed values: sizes of the cells behind the feature, over and over
_CELLS = ["wide", "regular", "tall", "regular", "regular", "wide", "regular", "regular", "tall", "regular", "regular", "wide"]


@query(q.FULL_RANK + f"SELECT id, CASE WHEN place = 0 THEN 'feature' ELSE {q.array(_CELLS)}[(place - 1) % 12 + 1] END AS cell FROM ranked")
def win_12_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("place")
    return rank(spark, sf).select("id", F.when(p == 0, "feature").otherwise(pick(_CELLS, (p - 1) % 12)).alias("cell"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def win_04_last(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each key, as a map-side-combined maximum."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


_LIVE = f"""live AS (SELECT kind, term, s / max(s) OVER (PARTITION BY kind) AS v FROM (SELECT kind, term, sum(({q.WEIGHT}) * exp(-0.6931471805599453 * ({v.NOW} - at_s) / {v.DAY}.0::DOUBLE / 7)) AS s
    FROM (SELECT * FROM ev WHERE at_s >= {v.NOW - 14 * v.DAY}) ev JOIN (SELECT id, 'topic' AS kind, unnest(topics) AS term FROM items UNION ALL SELECT id, 'entity', unnest(entities) FROM items) i ON i.id = ev.item_id
    WHERE (SELECT count(*) >= {v.MIN_EVENTS} AND (max(at_s) - min(at_s)) / {v.DAY}.0 >= {v.MIN_DAYS} FROM ev WHERE at_s >= {v.NOW - 14 * v.DAY}) GROUP BY kind, term)),
    mine AS (SELECT id, sum(v / n) AS m FROM (SELECT id, 'topic' AS kind, unnest(topics) AS term, len(topics) AS n FROM items UNION ALL SELECT id, 'entity', unnest(entities), len(entities) FROM items) JOIN live USING (kind, term) GROUP BY id)"""


@query(q.FULL_RANK + ", " + _LIVE + ", f AS (SELECT id, round(total - affinity + 6.0::DOUBLE * coalesce(m, 0), 9) AS s FROM ranked LEFT JOIN mine USING (id)) SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS place FROM f")
def srt_02_for_you(spark: SparkSession, sf: str) -> DataFrame:
    """The base score without taste, plus the taste of the last two weeks."""
    recent = engagements(spark, sf)[0].where(F.col("at_s") >= v.NOW - 14 * v.DAY)
    live = feed.affinity(items(spark, sf), feed.taste_profile(recent, items(spark, sf), v.NOW))
    s = F.round(F.col("total") - F.col("affinity") + v.WEIGHTS["affinity"] * F.coalesce("liked", F.lit(0.0)), 9)
    rows = scored(spark, sf).join(live, "id", "left").select("id", s.alias("s"))
    return feed.ranked(rows, [F.desc("s"), F.col("id")]).select("id", "place")


@query(q.with_(q.ITEMS) + "SELECT source, count(*) AS n FROM items GROUP BY source ORDER BY n DESC, source LIMIT 12")
def srt_05_top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 2000")
def srt_12_world_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 2000 events (the limit is the feature)."""
    return table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(2000).select("event_id")


@query(q.with_(q.REGISTRY, q.OUTCOMES) + "SELECT id, CASE WHEN ok THEN 0 WHEN ok IS NULL THEN strikes ELSE strikes + 1 END AS failures FROM registry LEFT JOIN outcomes USING (id)")
def stf_05_failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = registry(spark, sf).join(outcomes(spark, sf).select("id", "ok"), "id", "left")
    return r.select("id", F.when(F.col("ok"), 0).when(F.col("ok").isNull(), F.col("strikes")).otherwise(F.col("strikes") + 1).alias("failures"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def stm_02_since(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("""WITH o AS (SELECT o_orderkey, 1 + o_orderkey % 7 AS lo, 1 + o_orderkey % 5 AS hi, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'ref' END AS geometry, CASE o_orderkey % 3 WHEN 0 THEN 'restricted' WHEN 1 THEN 'open' ELSE 'link-out' END AS status FROM orders)
    SELECT o_orderkey, unnest(list_filter([CASE WHEN status = 'open' AND geometry IS NULL THEN 'open without geometry' END, CASE WHEN status = 'link-out' AND geometry IS NOT NULL THEN 'link-out with geometry' END, CASE WHEN lo > hi THEN 'range is reversed' END], lambda x: x IS NOT NULL)) AS rule FROM o""")
def dq_02_layer_rules(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(n, (1 + n % 7).alias("lo"), (1 + n % 5).alias("hi"), F.when(n % 8 != 0, "ref").alias("geometry"), F.when(n % 3 == 0, "restricted").when(n % 3 == 1, "open").otherwise("link-out").alias("status"))
    return ground.violations(rows, "o_orderkey", {"open without geometry": (F.col("status") == "open") & F.col("geometry").isNull(), "link-out with geometry": (F.col("status") == "link-out") & F.col("geometry").isNotNull(), "range is reversed": F.col("lo") > F.col("hi")})


@query("WITH c AS (SELECT 'r' || (c_custkey // 3 * 2) AS id FROM customer), w AS (SELECT 'r' || (n_nationkey * 3) AS id FROM nation) SELECT id, count(*) AS n FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, CAST(0 AS BIGINT) FROM w WHERE id NOT IN (SELECT id FROM c)")
def dq_04_registry_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that repeat, and required ids that are missing."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("r"), (F.floor(F.col("c_custkey") / 3) * 2).cast("string")).alias("id"))
    wanted = table(spark, sf, "nation").select(F.concat(F.lit("r"), (F.col("n_nationkey") * 3).cast("string")).alias("id"))
    twice = c.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return twice.union(wanted.join(c, "id", "left_anti").select("id", F.lit(0).cast("bigint")))


@query(q.with_(q.ITEMS) + f"SELECT DISTINCT published_s // {v.DAY} AS day, (published_s // {v.DAY} + 3) % 7 AS weekday, CASE WHEN (published_s // {v.DAY} + 3) % 7 = 6 THEN 'chronicle' WHEN (published_s // {v.DAY} + 3) % 7 = 2 THEN 'dispatch' END AS due FROM items")
def dat_04_due_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Recurring columns by weekday (Monday is 0)."""
    day = F.floor(F.col("published_s") / v.DAY)
    w = (day + 3) % 7
    return items(spark, sf).select(day.alias("day"), w.alias("weekday"), F.when(w == 6, "chronicle").when(w == 2, "dispatch").alias("due")).distinct()


@query(q.with_(q.ITEMS) + f"SELECT id, round(exp(-0.6931471805599453 * greatest(({v.NOW} - published_s) / {v.DAY}.0::DOUBLE, 0) / 7), 9) AS weight FROM items")
def mth_01_decay_curve(spark: SparkSession, sf: str) -> DataFrame:
    """What an item's age leaves of it; dates to come count as now."""
    age = F.greatest((F.lit(v.NOW) - F.col("published_s")) / float(v.DAY), F.lit(0.0))
    return items(spark, sf).select("id", F.round(scoring.decay(age), 9).alias("weight"))


@query(q.with_(q.REGISTRY) + f"SELECT id, 'active' AS status, 0 AS strikes FROM registry WHERE status = 'disabled' AND n % 2 = 0 UNION ALL SELECT id, status, strikes FROM registry WHERE NOT (status = 'disabled' AND n % 2 = 0)")
def stf_02_rediscovered(spark: SparkSession, sf: str) -> DataFrame:
    """Sources found at a new address are active again, without strikes."""
    found = registry(spark, sf).where("n % 2 = 0").select("id", F.concat(F.lit("https://new.example/"), "id").alias("url"))
    return health.rediscovered(registry(spark, sf), found).select("id", "status", "strikes")


_FRONT = f"""pg AS (SELECT id, CASE WHEN ord % 11 = 0 THEN 'A testing video' ELSE title END AS title, CASE WHEN ord % 7 = 0 THEN 'https://www.youtube.com/shorts/' || ord WHEN ord % 2 = 0 THEN 'https://youtu.be/' || lpad(CAST(ord AS VARCHAR), 11, 'v') ELSE url END AS url, kind, source, topics, total, place, {q.minutes('body')} AS m, {q.plain('body')} = '' AS bare FROM ranked),
    al AS (SELECT * FROM pg WHERE NOT contains(url, '/shorts/') AND NOT (kind = 'video' AND contains(title, 'testing video')) AND (bare OR m >= 5)),
    el AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS p FROM al WHERE m >= 7), f AS (SELECT topics[1] AS fc FROM el WHERE p = 0),
    b AS (SELECT id, p, row_number() OVER (PARTITION BY topics[1] ORDER BY p) + CAST(topics[1] = fc AS INT) AS turn, min(p) OVER (PARTITION BY topics[1]) AS cp FROM el, f WHERE p > 0),
    o AS (SELECT id, row_number() OVER (ORDER BY turn, cp) - 1 AS pick FROM (SELECT id, 0 AS turn, -1 AS cp FROM el WHERE p = 0 UNION ALL SELECT id, turn, cp FROM b)), blk AS (SELECT * FROM o WHERE pick < 30),
    rest AS (SELECT * FROM al WHERE id NOT IN (SELECT id FROM blk)),
    w AS (SELECT *, row_number() OVER (PARTITION BY kind, source ORDER BY place) AS nth FROM rest WHERE (kind = 'video' AND contains(url, 'youtu.be/')) OR kind = 'audio'),
    r AS (SELECT kind, id, place, 0 AS late, CASE kind WHEN 'video' THEN 12 ELSE 10 END AS most FROM w WHERE nth = 1), r1 AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY place) AS k FROM r QUALIFY k <= most),
    gap AS (SELECT kind, any_value(most) - count(*) AS g FROM r1 GROUP BY kind), r2 AS (SELECT w.kind, id, place, 1 AS late, row_number() OVER (PARTITION BY w.kind ORDER BY place) AS k, g FROM w JOIN gap USING (kind) WHERE nth > 1 AND g BETWEEN 1 AND 2 QUALIFY k <= g)"""


@query(q.FULL_RANK + ", " + _FRONT + """ SELECT 'featured' AS section, NULL::VARCHAR AS rail, id, pick AS pos FROM blk UNION ALL SELECT 'category', topics[1], id, row_number() OVER (PARTITION BY topics[1] ORDER BY place) - 1 FROM rest WHERE m >= 5 QUALIFY count(*) OVER (PARTITION BY topics[1]) >= 3
    UNION ALL SELECT CASE kind WHEN 'video' THEN 'watch' ELSE 'listen' END, NULL, id, row_number() OVER (PARTITION BY kind ORDER BY place) - 1 FROM (SELECT kind, id, place FROM r1 UNION ALL SELECT kind, id, place FROM r2) UNION ALL SELECT 'register', NULL, id, row_number() OVER (ORDER BY place) - 1 FROM rest""")
def pip_07_front_page(spark: SparkSession, sf: str) -> DataFrame:
    """The whole front page; some items are shorts, some have a video's address, some are raw clips by their title."""
    n = F.col("ord")
    url = F.when(n % 7 == 0, F.concat(F.lit("https://www.youtube.com/shorts/"), n.cast("string"))).when(n % 2 == 0, F.concat(F.lit("https://youtu.be/"), F.lpad(n.cast("string"), 11, "v"))).otherwise(F.col("url"))
    rows = rank(spark, sf).withColumns({"url": url, "title": F.when(n % 11 == 0, "A testing video").otherwise(F.col("title"))})
    return feed.front_page(rows)


@query(q.FULL_RANK + f", ok AS (SELECT * FROM ranked WHERE {_OK}), top AS (SELECT id FROM ok ORDER BY place LIMIT 10) SELECT id, topics[1] AS rail FROM ranked WHERE id NOT IN (SELECT id FROM top)")
def pip_07_rails(spark: SparkSession, sf: str) -> DataFrame:
    """What is not featured, by primary channel."""
    rows = scored_table(spark, sf)
    return rows.join(F.broadcast(feed.featured(rows)), "id", "left_anti").select("id", F.get("topics", 0).alias("rail"))


_TUNED = {"weights": {"recency": 3.0, "affinity": 1.5, "cluster": 0.0}, "peak": 8.0, "sigma": 4.0, "half_life": 3.0}
_OWN = q.with_(q.ITEMS, q.EVENTS, q.PROFILE, q.CLUSTERS, f"chosen AS (SELECT * FROM clustered WHERE {q.minutes('body')} >= 1 AND {q.group('topics[1]')} IN ('world', 'data', 'science') AND list_contains({q.array(v.CHANNELS[:14])}, topics[1]) AND {q.group('topics[1]')} = 'data')", q.scored(**_TUNED).replace("FROM clustered c", "FROM chosen c"), q.RANKED)


@query(_OWN + "SELECT id, place, round(total, 5) AS total FROM ranked")
def srt_16_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The feed of a reader who wants fresh, shorter reads on data, by their own weights, gates and filters."""
    rows = feed.story_clusters(written(spark, sf))
    profile = feed.taste_profile(engagements(spark, sf)[0], items(spark, sf), v.NOW)
    out = feed.rerank(rows, profile, v.NOW, least_minutes=1, channels=v.CHANNELS[:14], group="data", diverse=False, **_TUNED)
    return out.select("id", "place", F.round("total", 5).alias("total"))


@query("SELECT DISTINCT o_custkey AS c, CAST(floor(epoch(max(o_orderdate) OVER (PARTITION BY o_custkey))) AS BIGINT) - CAST(floor(epoch(min(o_orderdate) OVER (PARTITION BY o_custkey))) AS BIGINT) AS span_s FROM orders")
def win_11_spans(spark: SparkSession, sf: str) -> DataFrame:
    t = seconds(F.col("o_orderdate"))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg((F.max(t) - F.min(t)).alias("span_s"))
