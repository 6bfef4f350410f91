"""Queries on taste, scores, ranking, selection, duplicates and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import scoring, text
from feedloom.operators import feed
from feedloom.plans import sql as q
from feedloom.sources.entities import engagements, features, items


def written(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The items' features (or some of them) as a table, for what reads them more than once: texts are read here only."""
    rows = features(spark, sf)
    return feed.Workspace(spark).write(rows.select(*columns) if columns else rows, "features")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """All items with their stories, terms and total, without bodies."""
    space = feed.Workspace(spark)
    every = written(spark, sf)
    profile = space.write(feed.taste_profile(engagements(spark, sf)[0], every, v.NOW), "profile")
    return feed.score_items(feed.story_clusters(every), profile, v.NOW)


def scored_table(spark: SparkSession, sf: str) -> DataFrame:
    """The scored items as a table, for what reads them more than once."""
    return feed.Workspace(spark).write(scored(spark, sf), "scored")


def rank(spark: SparkSession, sf: str) -> DataFrame:
    return feed.ranked(scored(spark, sf), feed.by_total())


@query(q.with_(q.ITEMS, q.EVENTS, q.PROFILE) + "SELECT kind, term, round(v, 6) AS v FROM profile")
def agg_01_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = feed.taste_profile(engagements(spark, sf)[0], items(spark, sf), v.NOW)
    return p.select("kind", "term", F.round("v", 6).alias("v"))


_FORMATS = ", ".join(f"('{c}', '{f}')" for f, cs in v.FORMATS.items() for c in cs)


@query(q.with_(q.ITEMS, q.EVENTS, f"served(channel, format) AS (VALUES {_FORMATS})", "f AS (SELECT DISTINCT id, format FROM (SELECT id, unnest(topics) AS channel FROM items) JOIN served USING (channel))",
    f"w AS (SELECT item_id, sum(CASE type WHEN 'open' THEN 1.0::DOUBLE WHEN 'read' THEN 3 ELSE 2 END * exp(-0.6931471805599453 * greatest(({v.NOW} - at_s) / {v.DAY}.0::DOUBLE, 0) / 7)) AS w FROM ev GROUP BY item_id)",
    "s AS (SELECT format, sum(w / n) AS s FROM w JOIN (SELECT id, format, count(*) OVER (PARTITION BY id) AS n FROM f) g ON g.id = w.item_id GROUP BY format)") + "SELECT format, round(s / max(s) OVER (), 6) AS v FROM s")
def agg_02_formats(spark: SparkSession, sf: str) -> DataFrame:
    a = feed.format_affinity(engagements(spark, sf)[0], items(spark, sf), v.NOW)
    return a.select("format", F.round("v", 6).alias("v"))


@query(q.with_(q.EVENTS) + f"SELECT count(*) AS n_events, round((max(at_s) - min(at_s)) / {v.DAY}.0, 6) AS span_days, count(*) >= 20 AND (max(at_s) - min(at_s)) / {v.DAY}.0 >= 5 AS ready FROM ev")
def agg_03_gate(spark: SparkSession, sf: str) -> DataFrame:
    return feed.gate(engagements(spark, sf)[0]).select("n_events", F.round("span_days", 6).alias("span_days"), "ready")


@query(q.with_(q.EVENTS) + f"SELECT device, at_s // {v.DAY} AS day, count(*) AS n, round(sum({q.WEIGHT}), 4) AS w, min(at_s) AS first_s, max(at_s) AS last_s FROM ev GROUP BY ALL")
def agg_04_devices(spark: SparkSession, sf: str) -> DataFrame:
    e = engagements(spark, sf)[0]
    w = scoring.event_weight(F.col("type"), F.col("dwell_ms"))
    return e.groupBy("device", F.floor(F.col("at_s") / v.DAY).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(w), 4).alias("w"), F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"))


@query(q.FULL_SCORE + "SELECT id, round(recency, 6) AS recency, round(trust_term, 6) AS trust, round(metrics, 6) AS metrics, round(cluster, 6) AS cluster, round(content, 6) AS content, round(read_time, 6) AS read_time, round(affinity, 6) AS affinity, round(total, 5) AS total FROM total")
def mth_04_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", *(F.round(t, 6).alias(t) for t in scoring.TERMS), F.round("total", 5).alias("total"))


@query(q.FULL_SCORE + """, f AS (SELECT id, total, unnest(['recency', 'trust', 'metrics', 'cluster', 'content', 'read_time', 'affinity']) AS term, unnest([recency, trust_term, metrics, cluster, content, read_time, affinity]) AS x FROM total)
    SELECT id, term, round(x / total, 5) AS share, CASE WHEN x / total >= 0.3 THEN 'strong' WHEN x / total >= 0.12 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN total >= 8 THEN 'top' WHEN total >= 5 THEN 'high' WHEN total >= 3 THEN 'mid' ELSE 'low' END AS tier FROM f WHERE x > 0""")
def mth_05_explain(spark: SparkSession, sf: str) -> DataFrame:
    """Why an item ranks where it does: each term's share and how strong that is."""
    terms = F.array(*(F.struct(F.lit(t).alias("term"), F.col(t).alias("x")) for t in scoring.TERMS))
    rows = scored(spark, sf).select("id", "total", F.explode(terms).alias("t")).select("id", "total", "t.*").where("x > 0")
    s = F.col("x") / F.col("total")
    tier = F.when(F.col("total") >= 8, "top").when(F.col("total") >= 5, "high").when(F.col("total") >= 3, "mid").otherwise("low")
    return rows.select("id", "term", F.round(s, 5).alias("share"), F.when(s >= 0.3, "strong").when(s >= 0.12, "moderate").otherwise("weak").alias("strength"), tier.alias("tier"))


@query(q.FULL_RANK + "SELECT place, id, title, round(total, 5) AS total FROM ranked")
def srt_01_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: events and items to a profile, stories, seven-term scores and all items in their order."""
    return rank(spark, sf).select("place", "id", "title", F.round("total", 5).alias("total"))


@query(q.FULL_RANK + "SELECT source, id, nth FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY total DESC, id) AS nth FROM total) WHERE nth <= 5")
def win_09_top_per_source(spark: SparkSession, sf: str) -> DataFrame:
    from feedloom.operators.analytics import top_per_group

    return top_per_group(scored(spark, sf), "source", [F.desc("total"), F.col("id")], 5).select("source", "id", F.col("nth").cast("bigint").alias("nth"))


_BALANCED = q.FULL_RANK + f""", el AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS p FROM ranked WHERE {q.minutes('body')} >= 7), f AS (SELECT topics[1] AS fc FROM el WHERE p = 0),
    b AS (SELECT id, p, topics[1] AS channel, row_number() OVER (PARTITION BY topics[1] ORDER BY p) + CAST(topics[1] = fc AS INT) AS turn, min(p) OVER (PARTITION BY topics[1]) AS cp FROM el, f WHERE p > 0),
    e AS (SELECT id, topics[1] AS channel, 0 AS turn, -1 AS cp FROM el WHERE p = 0 UNION ALL SELECT id, channel, turn, cp FROM b), o AS (SELECT id, channel, row_number() OVER (ORDER BY turn, cp) - 1 AS pick FROM e)
    SELECT id, channel, pick FROM o WHERE pick < 13"""


@query(_BALANCED)
def win_06_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """A front page of 13 from the items that are long enough."""
    return feed.balanced(scored_table(spark, sf).where(F.col("minutes") >= v.FEATURE_MINUTES), 13).select("id", "channel", F.col("pick").cast("bigint").alias("pick"))


def _floor_sql(kind: str, before: str, after: str) -> str:
    return f"""{after}_n AS (SELECT least(60, count(*)) AS stop, 2 - count(*) FILTER (kind = '{kind}' AND place >= 10 AND place < 60) AS lack FROM {before}),
        {after}_l AS (SELECT id, row_number() OVER (ORDER BY total DESC, place) AS turn FROM {before} WHERE kind = '{kind}' AND place >= 60 QUALIFY turn <= (SELECT lack FROM {after}_n)),
        {after} AS (SELECT r.id, r.kind, r.total, row_number() OVER (ORDER BY CASE WHEN turn IS NULL THEN r.place ELSE stop - (SELECT count(*) FROM {after}_l) - 0.5 + turn / 1000.0 END) - 1 AS place FROM {before} r LEFT JOIN {after}_l l USING (id), {after}_n)"""


@query(q.FULL_RANK + ", r0 AS (SELECT id, kind, total, place FROM ranked), " + _floor_sql("video", "r0", "r1") + ", " + _floor_sql("audio", "r1", "r2") + " SELECT id, kind, place FROM r2")
def win_07_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """All items in order with enough video and audio near the top."""
    return feed.diversity_floor(rank(spark, sf).select("id", "kind", "total", "place")).select("id", "kind", "place")


@query(q.FULL_RANK + "SELECT id, place FROM ranked")
def win_01_rank_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every item's place in the order of totals."""
    return rank(spark, sf).select("id", "place")


@query(q.FULL_RANK + ", n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS nth FROM ranked), f AS (SELECT id, source, place, 0 AS late FROM n WHERE nth = 1 ORDER BY place LIMIT 60), m AS (SELECT id, source, place, 1 AS late FROM n WHERE nth > 1 AND 60 - (SELECT count(*) FROM f) <= 2 ORDER BY place LIMIT 2) SELECT id, source FROM (SELECT * FROM f UNION ALL SELECT * FROM m ORDER BY late, place LIMIT 60)")
def win_05_one_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return feed.one_per_source(scored_table(spark, sf), 60).select("id", "source")


@query(q.with_(q.ITEMS, q.SESSIONS) + "SELECT id, key, CAST(session AS BIGINT) AS session FROM sessions")
def jon_11_title_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return feed.title_sessions(written(spark, sf, "id", "title", "published_s")).select("id", "key", F.col("session").cast("bigint").alias("session"))


@query(q.with_(q.ITEMS, q.CLUSTERS) + "SELECT id, cluster_id FROM clustered")
def grf_02_stories(spark: SparkSession, sf: str) -> DataFrame:
    return feed.story_clusters(written(spark, sf, "ord", "id", "title", "entities")).select("id", "cluster_id")


@query(q.with_(q.ITEMS, q.GROUPS) + "SELECT id, grp FROM grouped")
def grf_01_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return feed.duplicate_groups(written(spark, sf, "ord", "id", "url", "title", "published_s")).select("id", F.col("group").alias("grp"))


@query(q.with_(q.ITEMS, q.GROUPS) + f"""SELECT id, size, score, comments FROM (SELECT id, count(*) OVER w AS size, max(score) OVER w AS score, max(comments) OVER w AS comments,
    row_number() OVER (PARTITION BY grp ORDER BY length({q.plain('body')}) <= 800, length({q.plain('body')}) DESC, coalesce(trust, 0.5) DESC, score + comments DESC, id) AS rn FROM grouped WINDOW w AS (PARTITION BY grp)) WHERE rn = 1""")
def win_02_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return feed.representatives(feed.duplicate_groups(written(spark, sf))).select("id", "size", "score", "comments")


@query(q.with_(q.ITEMS) + f"SELECT id, published_s, trust FROM items WHERE ord % 3 = 0 AND published_s >= {v.NOW - 14 * v.DAY} UNION ALL SELECT id, published_s - 60, trust FROM items WHERE ord % 3 = 1 AND published_s - 60 >= {v.NOW - 14 * v.DAY}")
def set_02_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Old items with ids 0 and 1 modulo 3, fresh ones with 1, a minute earlier: fresh rows replace old ones."""
    every = items(spark, sf)
    fresh = every.where("ord % 3 = 1").withColumn("published_s", F.col("published_s") - 60)
    return feed.archive(every.where("ord % 3 <= 1"), fresh, v.NOW).select("id", "published_s", "trust")


@query(q.FULL_RANK + ", o AS (SELECT id, row_number() OVER (ORDER BY published_s DESC, id) - 1 AS base FROM ranked) SELECT id, base - place AS delta FROM ranked JOIN o USING (id)")
def jon_14_rank_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """How far ranking moves each item against the order by date."""
    now = rank(spark, sf).select("id", "published_s", "place")
    base = feed.ranked(now.select("id", "published_s"), [F.desc("published_s"), F.col("id")], "base").select("id", "base")
    return now.join(base, "id").select("id", (F.col("base") - F.col("place")).alias("delta"))


@query(q.with_(q.ITEMS, q.EVENTS) + "SELECT id FROM items WHERE id IN (SELECT item_id FROM ev)")
def jon_08_engaged(spark: SparkSession, sf: str) -> DataFrame:
    e = engagements(spark, sf)[0]
    return items(spark, sf).join(e.select(F.col("item_id").alias("id")), "id", "left_semi").select("id")


_NEEDLES = ["the", "an", "On ", "xq", " "]


@query(q.with_(q.ITEMS, "n AS (SELECT unnest(" + q.array(_NEEDLES) + ") AS needle)", "k AS (SELECT id, needle, lower(title) AS t, lower(trim(needle)) AS x FROM items, n)") + "SELECT id, needle, round(CASE WHEN x = '' OR starts_with(t, x) THEN 0 WHEN contains(t, x) THEN 1 + (strpos(t, x) - 1) / 100.0::DOUBLE ELSE 2 END, 6) AS score FROM k WHERE x = '' OR contains(t, x) OR regexp_matches(t, array_to_string(string_split(x, ''), '.*'))")
def srt_11_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Titles by how well they match what is typed: at the start, the earlier within, letter by letter; nothing typed matches all."""
    needles = F.explode(F.array(*map(F.lit, _NEEDLES))).alias("needle")
    rows = items(spark, sf).select("id", "title", needles).withColumn("score", text.match_score(F.col("title"), F.col("needle")))
    return rows.where("score is not null").select("id", "needle", F.round("score", 6).alias("score"))


_REPS = f"""un AS (SELECT grp, list_sort(list_distinct(flatten(list(topics)))) AS all_t, list_sort(list_distinct(flatten(list(entities)))) AS all_e, max(score) AS ms, max(comments) AS mc FROM grouped GROUP BY grp),
best AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY length({q.plain('body')}) <= 800, length({q.plain('body')}) DESC, coalesce(trust, 0.5) DESC, score + comments DESC, id) AS rn FROM grouped),
reps AS (SELECT b.* EXCLUDE (rn, topics, entities, score, comments), list_concat(topics, list_filter(all_t, lambda x: NOT list_contains(topics, x))) AS topics, list_concat(entities, list_filter(all_e, lambda x: NOT list_contains(entities, x))) AS entities, ms AS score, mc AS comments FROM best b JOIN un USING (grp) WHERE rn = 1)"""
_KEPT = f"kept AS (SELECT * FROM clustered WHERE length({q.plain('body')}) > 800 AND ({q.minutes('body')} >= 5 OR ({q.minutes('body')} >= 3 AND (list_has_any(topics, {q.array(v.HARD_CHANNELS)}) OR list_contains({q.array(v.MAKER_SOURCES)}, source)))))"
_CURATED = q.with_(q.ITEMS, q.EVENTS, q.GROUPS, _REPS, q.CLUSTERS.replace("items", "reps"), _KEPT, q.PROFILE.replace("items", "kept"), q.SCORED.replace("items", "kept").replace("FROM clustered c", "FROM kept c"), q.RANKED)


@query(_CURATED + ", r0 AS (SELECT id, kind, total, place FROM ranked), " + _floor_sql("video", "r0", "r1") + ", " + _floor_sql("audio", "r1", "r2") + " SELECT r2.place, id, cluster_id, cluster_size, round(r2.total, 5) AS total FROM r2 JOIN ranked USING (id)")
def pip_01_curate(spark: SparkSession, sf: str) -> DataFrame:
    """The curated feed, all of it: one item a group of duplicates, stories, gates, taste, order, diversity."""
    every = written(spark, sf)
    out = feed.curate(every, engagements(spark, sf)[0], v.NOW)
    return out.select("place", "id", "cluster_id", "cluster_size", F.round("total", 5).alias("total"))
