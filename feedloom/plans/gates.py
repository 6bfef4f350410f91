"""Queries on single gates, text functions, terms of scores, dates and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import formula, maker, prose, scoring, sources, text
from feedloom.operators import feed, health, world
from feedloom.plans import sql as q
from feedloom.plans.texts import _HOST
from feedloom.sources.entities import features, items, outcomes, seconds, table

_N, _M = f"length({q.plain('body')})", q.minutes("body")


@query(q.with_(q.ITEMS) + f"SELECT id FROM items WHERE {_N} <= 800 AND kind IN ('video', 'audio')")
def flt_02_bare_media(spark: SparkSession, sf: str) -> DataFrame:
    """Video and audio without a full text."""
    return features(spark, sf).where((F.col("n_plain") <= v.FULL_TEXT_CHARS) & F.col("kind").isin("video", "audio")).select("id")


@query(q.with_(q.ITEMS) + f"SELECT id FROM items WHERE {_M} >= 5 OR ({_M} >= 3 AND (list_has_any(topics, {q.array(v.HARD_CHANNELS)}) OR list_contains({q.array(v.MAKER_SOURCES)}, source)))")
def flt_03_read_time_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Five minutes, or three for makers."""
    return features(spark, sf).where((F.col("minutes") >= v.MIN_READ_MINUTES) | (F.col("minutes") >= v.MAKER_READ_MINUTES) & feed.maker(v.MAKER_SOURCES)).select("id")


@query(q.with_(q.ITEMS) + f"SELECT id FROM items WHERE {q.plain('body')} = '' OR {_M} >= 5")
def flt_04_feed_floor(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).where((F.col("n_plain") == 0) | (F.col("minutes") >= v.MIN_READ_MINUTES)).select("id")


_SHORTS = "vid AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'https://www.youtube.com/shorts/' WHEN 1 THEN 'HTTPS://m.YouTube.com/shorts/' ELSE 'https://www.youtube.com/watch?v=' END || o_orderkey AS url, CASE WHEN o_orderkey % 7 = 0 THEN 'Pool run 1 (No Audio)' WHEN o_orderkey % 11 = 0 THEN 'River Testing Video' ELSE 'Testing videos: a talk' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'video' ELSE 'link' END AS kind FROM orders)"


@query(q.with_(_SHORTS) + "SELECT k FROM vid WHERE NOT regexp_matches(lower(url), '^https?://((www|m)\\.)?youtube\\.com/shorts/') AND NOT (kind = 'video' AND (contains(lower(title), '(no audio)') OR regexp_matches(title, '(?i)\\btesting video\\b')))")
def flt_05_without_shorts(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose address is not that of a short, and videos that are no raw clips."""
    k = F.col("o_orderkey")
    url = F.concat(F.when(k % 3 == 0, "https://www.youtube.com/shorts/").when(k % 3 == 1, "HTTPS://m.YouTube.com/shorts/").otherwise("https://www.youtube.com/watch?v="), k.cast("string"))
    title = F.when(k % 7 == 0, "Pool run 1 (No Audio)").when(k % 11 == 0, "River Testing Video").otherwise("Testing videos: a talk")
    kind = F.when(k % 2 == 0, "video").otherwise("link")
    return table(spark, sf, "orders").where(~sources.is_short(url) & ~sources.is_junk_video(kind, title)).select(k.alias("k"))


@query(q.with_(q.ITEMS) + "SELECT id FROM items WHERE list_has_any(topics, ['ai', 'tech', 'science']) AND kind IN ('video', 'paper') AND source_type IS NOT NULL")
def flt_07_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Values of one facet are alternatives, facets are joined by and, a facet without values lets all through."""
    chosen = {"topics": ["ai", "tech", "science"], "kind": ["video", "paper"], "source_type": []}
    keep = F.lit(True)
    for column, values in chosen.items():
        if values:
            keep &= F.arrays_overlap(column, F.array(*map(F.lit, values))) if column == "topics" else F.col(column).isin(values)
    return items(spark, sf).where(keep).select("id")


@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment)), 'build') OR contains(CAST(c_nationkey AS VARCHAR), 'build')")
def flt_09_any_column(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that have the needle in any column, in any case."""
    c = table(spark, sf, "customer")
    shown = F.array(*(F.lower(F.coalesce(F.col(x).cast("string"), F.lit(""))) for x in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")))
    return c.where(F.exists(shown, lambda x: x.contains("build"))).select("c_custkey")


@query(q.with_(q.OUTCOMES) + f"SELECT id FROM outcomes WHERE {q.PERMANENT}")
def flt_13_permanent(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).where(health.permanent()).select("id")


@query(q.with_(q.ITEMS) + f"SELECT id FROM items WHERE ord % 4 <> 0 AND published_s > {v.NOW - 5 * v.DAY}")
def flt_15_new_since_visit(spark: SparkSession, sf: str) -> DataFrame:
    """Strictly later than the visit; nothing is new to who has never visited (here every fourth)."""
    visit = F.when(F.col("ord") % 4 != 0, F.lit(v.NOW - 5 * v.DAY))
    return items(spark, sf).where(F.coalesce(F.col("published_s") > visit, F.lit(False))).select("id")


_BOX = "e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, (event_id % 181 - 90)::DOUBLE AS lat, (event_id * 7 % 361 - 180)::DOUBLE AS lng, event_type FROM events)"


def _located(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf, "events").select(n, seconds(F.col("ts")).alias("at_s"), (n % 181 - 90).cast("double").alias("lat"), (n * 7 % 361 - 180).cast("double").alias("lng"), "event_type")


@query(q.with_(_BOX) + "SELECT event_id FROM e WHERE lat BETWEEN 10 AND 45 AND lng BETWEEN 25 AND 60 AND at_s >= 1704500000 AND at_s < 1706000000")
def flt_16_bounds_and_window(spark: SparkSession, sf: str) -> DataFrame:
    """The box has its edges, the window its start and not its end."""
    return _located(spark, sf).where(F.col("lat").between(10, 45) & F.col("lng").between(25, 60) & (F.col("at_s") >= 1_704_500_000) & (F.col("at_s") < 1_706_000_000)).select("event_id")


_AREAS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in t) + ")" for t in world.THEATERS)


@query(f"WITH {_BOX}, a(theater, n, s, ea, w, st, en, status) AS (VALUES {_AREAS})" + """, m AS (SELECT e.event_id, any_value(event_type) AS event_type, min(theater) AS theater FROM e LEFT JOIN a ON lat BETWEEN s AND n AND lng BETWEEN w AND ea AND at_s >= st AND (en IS NULL OR at_s < en) AND status <> 'proposed' AND (status <> 'archived' OR en IS NOT NULL) GROUP BY e.event_id)
    SELECT event_id FROM m WHERE event_type = 'error' OR theater IS NOT NULL""")
def flt_17_escalated(spark: SparkSession, sf: str) -> DataFrame:
    """Conflict events (here: errors) and those in a theater."""
    return world.membership(_located(spark, sf), world.theaters(spark)).where((F.col("event_type") == "error") | F.col("theater").isNotNull()).select("event_id")


@query("SELECT page_id, len(regexp_extract_all(substr(coalesce(html, ''), 1, 600), '<a ')) >= 4 OR regexp_matches(trim(coalesce(html, ''), ' \t\n\r'), '^(?i)<a[^>]*>skip to') AS leaky FROM pages")
def flt_18_leaky_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", prose.is_leaky(F.col("html")).alias("leaky"))


_TALK = "t AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' This episode is brought to you by Squarespace, use code POD.' WHEN turn % 3 = 1 THEN ' Start investing with Schwab, a free trial, cancel anytime.' ELSE '' END AS s FROM conversations)"
_DENSITY = " + ".join([f"2 * CAST(regexp_matches(s, '(?i)\\b{b}\\b') AS INT)" for b in prose.BRANDS] + [f"CAST(regexp_matches(s, '(?i){p}') AS INT)" for p in prose.LEXICON])


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    ad = F.when(F.col("turn") % 3 == 0, " This episode is brought to you by Squarespace, use code POD.").when(F.col("turn") % 3 == 1, " Start investing with Schwab, a free trial, cancel anytime.").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", ad).alias("s"))


@query(q.with_(_TALK) + f"SELECT conv_id, turn, {_DENSITY} AS density FROM t")
def str_14_sponsor_density(spark: SparkSession, sf: str) -> DataFrame:
    """Two points a brand, one a turn of phrase, each counted once."""
    return _talks(spark, sf).select("conv_id", "turn", prose.sponsor_density(F.col("s")).alias("density"))


@query(q.with_(_TALK) + f"SELECT conv_id, turn FROM t WHERE {' OR '.join(f"regexp_matches(s, '(?i){p}')" for p in prose.TRIGGERS)} OR {_DENSITY} >= 5")
def flt_19_ads(spark: SparkSession, sf: str) -> DataFrame:
    return _talks(spark, sf).where(prose.is_ad(F.col("s"))).select("conv_id", "turn")


@query(f"SELECT page_id FROM pages WHERE length({q.plain('html')}) >= 1500")
def flt_21_full_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.length(text.plain(F.col("html"))) >= 1500).select("page_id")


@query("SELECT s_suppkey FROM supplier WHERE CASE s_suppkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'derived-only' WHEN 2 THEN 'restricted' WHEN 3 THEN 'open' ELSE 'unknown' END IN ('open', 'derived-only')")
def flt_22_enabled_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Providers whose licence tier permits their geometry."""
    tier = F.when(F.col("s_suppkey") % 5 == 1, "derived-only").when(F.col("s_suppkey") % 5 == 2, "restricted").when(F.col("s_suppkey") % 5 == 4, "unknown").otherwise("open")
    permitted = F.broadcast(spark.createDataFrame([("open",), ("derived-only",)], "tier string"))  # a fixed table
    return table(spark, sf, "supplier").withColumn("tier", tier).join(permitted, "tier", "left_semi").select("s_suppkey")


@query(q.with_(q.ITEMS, q.TOKENS) + "SELECT id, words FROM items JOIN tok USING (ord)")
def str_02_title_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("id", F.array_sort(text.title_tokens(F.col("title"))).alias("words"))


@query(q.with_(q.ITEMS) + f"SELECT id, {_M} AS minutes FROM items")
def str_04_read_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("id", "minutes")


@query(q.with_(q.ITEMS) + f"SELECT id, greatest(1, {_M}) AS from_html, {q.minutes('body', 230)} AS estimate, {q.words('body')} AS words, round(({q.words('body')}) / 200.0, 6) AS build_time FROM items")
def str_05_read_time_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Four definitions of reading time that differ on purpose."""
    w = text.word_count(F.col("body"))
    return items(spark, sf).select("id", F.greatest(F.lit(1), text.half_up(w / 225)).alias("from_html"), text.half_up(w / 230).alias("estimate"), w.alias("words"), F.round(w / 200, 6).alias("build_time"))


_PROSE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?m)^import\\s.+$', '', 'g'), '```[\\s\\S]*?```', '', 'g'), '<[^>]+>', ' ', 'g'), '\\{{[^}}]*\\}}', ' ', 'g'), '\\s+', ' ', 'g'))"
_EXCERPT = """p AS (SELECT id, {p} AS p, substr({p}, 1, 181) AS w FROM items),
    c AS (SELECT id, p, w, greatest(CASE WHEN contains(w, '. ') THEN length(w) - strpos(reverse(w), ' .') ELSE 0 END, CASE WHEN contains(w, '? ') THEN length(w) - strpos(reverse(w), ' ?') ELSE 0 END, CASE WHEN contains(w, '! ') THEN length(w) - strpos(reverse(w), ' !') ELSE 0 END) AS s, substr(w, 1, 180) AS x FROM p),
    d AS (SELECT *, CASE WHEN contains(x, ' ') THEN length(x) - strpos(reverse(x), ' ') ELSE 0 END AS b FROM c)
    SELECT id, CASE WHEN length(p) <= 180 THEN p WHEN s - 1 > 72 THEN trim(substr(w, 1, s)) ELSE trim(substr(x, 1, CASE WHEN b > 0 THEN b ELSE 180 END)) || '…' END AS excerpt FROM d"""


@query(q.with_(q.ITEMS, _EXCERPT.format(p=_PROSE.format(x="coalesce(body, '')"))))
def str_07_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The first 180 characters of prose, up to a sentence's end behind 40 % of them, else to a word's."""
    return items(spark, sf).select("id", prose.excerpt(F.col("body")).alias("excerpt"))


_TRACKS = "tr AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/srt' WHEN 2 THEN 'text/plain' ELSE 'text/vtt' END AS format, CASE WHEN l_partkey % 3 = 0 THEN 'de' ELSE 'en-US' END AS lang, l_suppkey % 2 = 0 AS auto FROM lineitem)"
_RANK = "CASE WHEN contains(format, 'vtt') OR contains(format, 'srt') OR contains(format, 'json') THEN 3 WHEN contains(format, 'html') THEN 1 ELSE 2 END"


@query(q.with_(_TRACKS) + f"SELECT k, n FROM (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY {_RANK} DESC, NOT starts_with(lang, 'en'), n) AS rn FROM tr) WHERE rn = 1")
def str_15_chosen_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """One transcript a work: the better format (those for machines are equal), then the feed's language, then the first, as one minimum."""
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "text/html").when(n % 4 == 1, "application/srt").when(n % 4 == 2, "text/plain").otherwise("text/vtt")
    key = F.struct((-sources.transcript_rank(kind)).alias("format"), (F.col("l_partkey") % 3 == 0).alias("other_language"), n.alias("n"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(key)["n"].alias("n"))


_SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '', 'g')"


@query(q.with_(q.ITEMS) + f"SELECT id, {_SLUG} AS slug, CASE WHEN {_SLUG} = '' THEN 'item' ELSE {_SLUG} END || '-' || substr(sha1(id), 1, 6) AS unique_slug FROM items")
def str_16_slugs(spark: SparkSession, sf: str) -> DataFrame:
    s = text.slug(F.col("title"))
    return items(spark, sf).select("id", s.alias("slug"), F.concat(F.when(s == "", "item").otherwise(s), F.lit("-"), F.substring(F.sha1(F.col("id").cast("binary")), 1, 6)).alias("unique_slug"))


_PHRASES = ["soldering a breadboard", "3D-printed enclosure", "built a kit", "notes on markets", "Raspberry Pi teardown"]


@query("SELECT p_partkey, regexp_matches(t, '(?i)" + maker.HARDWARE + "') AS hardware, regexp_matches(t, '(?i)" + maker.BUILD + f"') AS build FROM (SELECT p_partkey, p_name || ' ' || {q.array(_PHRASES)}[p_partkey % 5 + 1] AS t FROM part)")
def str_20_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Words that tell of hardware, and weaker ones that tell of building."""
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % 5).cast("int"))
    t = F.concat_ws(" ", "p_name", phrase)
    return table(spark, sf, "part").select("p_partkey", t.rlike("(?i)" + maker.HARDWARE).alias("hardware"), t.rlike("(?i)" + maker.BUILD).alias("build"))


@query("""SELECT o_orderkey, CASE WHEN n >= 1000000 THEN round(n / 1000000.0, 1) || 'M' WHEN n >= 1000 THEN round(n / 1000.0, 1) || 'K' ELSE CAST(n AS VARCHAR) END AS short, CASE WHEN d < 1 THEN 'today' WHEN d < 2 THEN 'yesterday' WHEN d < 7 THEN d || 'd ago' WHEN d < 60 THEN d // 7 || 'w ago' ELSE d // 30 || 'mo ago' END AS ago,
    array_to_string(list_transform(string_split(lower(o_orderpriority), '-'), lambda x: trim(x)), ' ') AS label FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderkey % 400 AS d FROM orders)""")
def str_21_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with K and M, days gone by, labels without dashes."""
    n, d = F.floor("o_totalprice"), F.col("o_orderkey") % 400
    ago = F.when(d < 1, "today").when(d < 2, "yesterday").when(d < 7, F.concat(d.cast("string"), F.lit("d ago"))).when(d < 60, F.concat(F.floor(d / 7).cast("string"), F.lit("w ago"))).otherwise(F.concat(F.floor(d / 30).cast("string"), F.lit("mo ago")))
    label = F.array_join(F.transform(F.split(F.lower("o_orderpriority"), "-"), lambda x: F.trim(x)), " ")
    return table(spark, sf, "orders").select("o_orderkey", prose.short_number(n).alias("short"), ago.alias("ago"), label.alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 10 / 10.0::DOUBLE END AS score, CASE WHEN o_orderkey % 3 = 2 THEN [] WHEN o_orderkey % 2 = 0 THEN ['ai', 'tech'] ELSE ['iot'] END AS topics FROM orders""")
def str_22_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of a model: code fences off, parsed, topics cut to the vocabulary; what is no JSON has no score."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"score": '), (k % 10 / 10).cast("string"), F.when(k % 2 == 0, ', "topics": ["ai", "nonsense", "tech"]}').otherwise(', "topics": ["iot", "x"]}'))
    reply = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 3 == 1, body).otherwise("I can't say.")
    return table(spark, sf, "orders").select("o_orderkey", *prose.parse_reply(reply))


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS s FROM h)
    SELECT page_id, CASE WHEN len(s) <= 2 THEN host WHEN length(s[-1]) = 2 AND s[-2] IN ('co', 'com', 'org', 'net', 'gov', 'edu', 'ac') THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS domain FROM p""")
def url_02_registrable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.registrable_domain(text.host(F.col("url"))).alias("domain"))


_LINKED = "p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<head><link rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed' || page_id || '.xml\"><LINK href=\"/a.css\" rel=\"stylesheet\"></head>' WHEN page_id % 3 = 0 THEN '<link type=\"application/atom+xml\" href=\"https://f.example/atom\" rel=\"alternate\">' ELSE '' END || coalesce(html, '') AS html FROM pages)"


@query(q.with_(_LINKED) + ", l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?i)<link\\b[^>]*>'), 1) AS n FROM p), f AS (SELECT page_id, arg_min(regexp_extract(tag, '(?i)href=[\"'']([^\"'']+)', 1), n) AS feed FROM l WHERE regexp_matches(tag, '(?i)type=[\"'']application/(rss|atom)\\+xml') GROUP BY page_id) SELECT page_id, feed FROM p LEFT JOIN f USING (page_id)")
def url_04_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """The first feed that a page's head names."""
    n = F.col("page_id")
    head = F.when(n % 2 == 0, F.concat(F.lit('<head><link rel="alternate" type="application/rss+xml" href="/feed'), n.cast("string"), F.lit('.xml"><LINK href="/a.css" rel="stylesheet"></head>'))).when(n % 3 == 0, '<link type="application/atom+xml" href="https://f.example/atom" rel="alternate">').otherwise("")
    return table(spark, sf, "pages").select(n, sources.feed_link(F.concat(head, F.coalesce("html", F.lit("")))).alias("feed"))


@query("SELECT page_id, nullif(regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*://[^/?#]+)', 1), '') AS origin FROM pages")
def url_05_origins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.origin(F.col("url")).alias("origin"))


@query(q.with_(q.ITEMS) + f"SELECT id, round(exp(-({_M} - 15.0::DOUBLE) * ({_M} - 15.0::DOUBLE) / 200), 9) AS score FROM items")
def mth_02_read_time_score(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("id", F.round(scoring.read_score(F.col("minutes")), 9).alias("score"))


@query(q.with_(q.ITEMS) + "SELECT id, round(log10(1 + greatest(score + comments, 0)) / 5, 9) AS volume FROM items")
def mth_03_volume(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("id", F.round(scoring.volume_term(F.col("score"), F.col("comments")), 9).alias("volume"))


_MAKE = f"""m AS (SELECT ord, id, kind, topics, {_M} AS minutes, title || ' ' || {q.array(_PHRASES)}[ord % 5 + 1] AS title, source || '-' || ord % 7 AS src, list_has_any(topics, {q.array(v.HARD_CHANNELS)}) AS hard_tag FROM items),
    b AS (SELECT *, ord % 7 = 0 AS pure, ord % 7 = 1 AS hard, ord % 7 = 2 AS excl, regexp_matches(title, '(?i){maker.HARDWARE}') OR (regexp_matches(title, '(?i){maker.BUILD}') AND (hard_tag OR list_contains(topics, 'ai-projects') OR ord % 7 <= 1)) AS signal FROM m),
    s AS (SELECT *, 3 * CAST(pure AS INT) + CAST(hard AS INT) + 2 * CAST(signal AS INT) + 3 * CAST(kind = 'idea' AS INT) - 5 * CAST(excl AS INT) - 3 * CAST(len(list_filter(topics, lambda t: list_contains({q.array(v.THINK_CHANNELS)}, t))) > len(topics) / 2.0 AND NOT hard_tag AND NOT signal AS INT) AS points FROM b)"""


def made(spark: SparkSession, sf: str) -> DataFrame:
    """Items with maker sources and a phrase in their titles, and their points."""
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("ord") % 5).cast("int"))
    rows = features(spark, sf).withColumns({"title": F.concat_ws(" ", "title", phrase), "source": F.concat("source", F.lit("-"), (F.col("ord") % 7).cast("string")), "pure": F.col("ord") % 7 == 0, "hard": F.col("ord") % 7 == 1, "excluded": F.col("ord") % 7 == 2, "summary": F.lit(None).cast("string")})
    return rows.withColumns({"signal": maker.build_signal(), "points": maker.points()})


@query(q.with_(q.ITEMS, _MAKE) + "SELECT id, points FROM s")
def mth_08_maker_points(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf).select("id", "points")


@query(q.with_(q.ITEMS, _MAKE) + "SELECT id, points FROM s WHERE points >= 3 AND (minutes >= 5 OR pure OR signal)")
def srt_14_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """What makers may build, by points: short items only from hands-on sources or with a build's signal in the title."""
    m = made(spark, sf).where((F.col("points") >= maker.THRESHOLD) & ((F.col("minutes") >= v.MIN_READ_MINUTES) | F.col("pure") | F.col("signal")))
    return m.orderBy(F.desc("points"), "id").select("id", "points")


@query("""WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'https://a.example' ELSE 'http://a.example' END AS url, c_custkey % 101 / 100.0::DOUBLE AS t, CASE c_custkey % 3 WHEN 0 THEN 'seed' WHEN 1 THEN 'scout' ELSE 'hand' END AS added, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 3 ELSE 0 END AS f, c_custkey % 5 AS n FROM customer)
    SELECT k, CASE WHEN t >= 0.8 THEN 'high-trust' WHEN t >= 0.6 THEN 'trusted' WHEN t >= 0.4 THEN 'mid-trust' ELSE 'provisional' END AS band, array_to_string(list_filter(['provenance:' || CASE added WHEN 'seed' THEN 'positive' ELSE 'neutral' END, 'transport:' || CASE WHEN starts_with(url, 'https:') THEN 'positive' ELSE 'caution' END, 'reliability:' || CASE WHEN f > 0 THEN 'caution' ELSE 'positive' END, 'track record:' || CASE WHEN n > 0 THEN 'positive' ELSE 'neutral' END, CASE WHEN t >= 0.75 AND f > 0 THEN 'needs review:caution' END], lambda x: x IS NOT NULL), ',') AS factors FROM s""")
def mth_09_trust_basis(spark: SparkSession, sf: str) -> DataFrame:
    """What speaks for a source and against it."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("k"), F.when(k % 2 == 0, "https://a.example").otherwise("http://a.example").alias("url"), (k % 101 / 100).alias("trust"), F.when(k % 3 == 0, "seed").when(k % 3 == 1, "scout").otherwise("hand").alias("added_by"), F.when(k % 7 == 0, k % 3).otherwise(0).alias("failures"), (k % 5).alias("n_items"))
    return rows.select("k", sources.trust_band(F.col("trust")).alias("band"), F.array_join(F.transform(sources.trust_factors(), lambda x: F.concat_ws(":", x["label"], x["polarity"])), ",").alias("factors"))


@query("SELECT c_custkey, least(greatest(c_acctbal / 10000, 0), 1) AS share, floor(c_acctbal * 10 + 0.5) / 10 AS rounded, power(10, floor(log10(c_custkey + 1))) AS step FROM customer")
def mth_12_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Clamped shares, halves rounded up, the power of ten below."""
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", sources.clamp01(x / 10000).alias("share"), (text.half_up(x * 10) / 10).alias("rounded"), F.pow(F.lit(10.0), F.floor(F.log10((F.col("c_custkey") + 1).cast("double")))).alias("step"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(p - (1 - p) / b, 0), 9) AS fraction, round(p * ln(1 + b * f) + (1 - p) * ln(1 - f), 9) AS growth, round(power(f, 2 / 0.5::DOUBLE - 1), 9) AS drawdown, round(ln(2) / b, 9) AS half_life
    FROM (SELECT l_orderkey, l_linenumber, 0.5::DOUBLE + l_discount AS p, 1.0::DOUBLE + l_linenumber AS b, 0.1::DOUBLE + l_tax AS f FROM lineitem)""")
def mth_13_bets(spark: SparkSession, sf: str) -> DataFrame:
    """The Kelly fraction, the growth rate at a stake, the chance of a drawdown, the half-life of a rate."""
    p, b, f = 0.5 + F.col("l_discount"), 1.0 + F.col("l_linenumber"), 0.1 + F.col("l_tax")
    r = lambda x: F.round(x, 9)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(scoring.kelly(p, b)).alias("fraction"), r(scoring.growth(p, b, f)).alias("growth"), r(F.pow(f, F.lit(2 / 0.5 - 1))).alias("drawdown"), r(F.lit(0.6931471805599453) / b).alias("half_life"))


@query("""WITH e AS (SELECT event_id, radians(event_id % 181 - 90.0::DOUBLE) AS la, radians(event_id * 7 % 361 - 180.0::DOUBLE) AS lo FROM events) SELECT event_id, round(6371 * 2 * asin(least(1, sqrt(power(sin((la - radians(48.0::DOUBLE)) / 2), 2) + cos(la) * cos(radians(48.0::DOUBLE)) * power(sin((lo - radians(2.0::DOUBLE)) / 2), 2)))), 3) AS km FROM e""")
def mth_15_great_circle(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf).select("event_id", F.round(world.great_circle_km(F.col("lat"), F.col("lng"), F.lit(48.0), F.lit(2.0)), 3).alias("km"))


@query("WITH s AS (SELECT n_name, sum(c_acctbal) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT n_name, round(CASE WHEN max(x) OVER () = min(x) OVER () THEN 50 ELSE 12 + 76 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) END, 4) AS weight FROM s")
def mth_16_choropleth(spark: SparkSession, sf: str) -> DataFrame:
    """Values by country as weights between 12 and 88 per cent."""
    from feedloom.operators.analytics import spread

    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    return spread(c.groupBy("n_name").agg(F.sum("c_acctbal").alias("x")), "x", 12.0, 88.0).select("n_name", F.round("weight", 4).alias("weight"))


@query("SELECT l_orderkey, l_linenumber, round(p * b - (1 - p), 9) AS edge, round((1 - power(1 - f, 3)), 9) AS eased FROM (SELECT l_orderkey, l_linenumber, 0.5::DOUBLE + l_discount AS p, 1.0::DOUBLE + l_linenumber AS b, l_tax * 10 AS f FROM lineitem)")
def mth_19_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge of a bet, and a frame's cubic easing."""
    p, b, f = 0.5 + F.col("l_discount"), 1.0 + F.col("l_linenumber"), F.col("l_tax") * 10
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(p * b - (1 - p), 9).alias("edge"), F.round(1 - F.pow(1 - f, F.lit(3.0)), 9).alias("eased"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {v.NOW} WHEN o_orderkey % 3 = 1 THEN 1705276800 + o_orderkey % 28 * 0 ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS at_s FROM orders")
def dat_01_parsed_times(spark: SparkSession, sf: str) -> DataFrame:
    """ISO times, the fallback where there is none."""
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "not a date").when(k % 3 == 1, "2024-01-15T00:00:00Z").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(text.iso_seconds(raw), F.lit(v.NOW)).alias("at_s"))


@query("SELECT event_id, CAST(floor(epoch(date_trunc('week', ts))) AS BIGINT) // 86400 AS week, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day FROM events")
def dat_02_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """The Monday of a time's week and its day, as day numbers."""
    day = F.floor(seconds(F.col("ts")) / v.DAY)
    return table(spark, sf, "events").select("event_id", text.week_of(day).alias("week"), day.alias("day"))


@query("SELECT event_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events")
def dat_03_day_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"))


_PERIODS = "p AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2024-Q' || (o_orderkey % 5) WHEN 2 THEN '2024-0' || (1 + o_orderkey % 9) ELSE '2024-05-1' || (o_orderkey % 10) END AS a, CASE o_orderkey % 3 WHEN 0 THEN '2023' WHEN 1 THEN '2024-Q2' ELSE '2024-05' END AS b FROM orders)"
_GRAIN = "CASE WHEN regexp_full_match({x}, '\\d{{4}}') THEN 'year' WHEN regexp_full_match({x}, '\\d{{4}}-Q[1-4]') THEN 'quarter' WHEN regexp_full_match({x}, '\\d{{4}}-\\d{{2}}') THEN 'month' WHEN regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'day' END"


@query(q.with_(_PERIODS) + f"SELECT k, {_GRAIN.format(x='a')} AS grain, coalesce({_GRAIN.format(x='a')} = {_GRAIN.format(x='b')} AND b < a, false) AS reversed FROM p")
def dat_05_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Periods are compared as text, and only where their grain is the same."""
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, "2024").when(k % 4 == 1, F.concat(F.lit("2024-Q"), (k % 5).cast("string"))).when(k % 4 == 2, F.concat(F.lit("2024-0"), (1 + k % 9).cast("string"))).otherwise(F.concat(F.lit("2024-05-1"), (k % 10).cast("string")))
    b = F.when(k % 3 == 0, "2023").when(k % 3 == 1, "2024-Q2").otherwise("2024-05")
    return table(spark, sf, "orders").select(k.alias("k"), world.period_grain(a).alias("grain"), F.coalesce((world.period_grain(a) == world.period_grain(b)) & (b < a), F.lit(False)).alias("reversed"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%b %Y') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS label FROM orders")
def dat_06_node_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates by their precision: a year, a month, a day."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, F.date_format(d, "yyyy")).when(k % 3 == 1, F.date_format(d, "MMM yyyy")).otherwise(F.date_format(d, "MMM d, yyyy")).alias("label"))


_FORMULA = "min(quantity, 30) * (1 - discount) ^ 2 / sqrt(1 + tax) - ln(price) + round(price / 7) / (line - 4)"


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, l_linenumber AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN n <> 4 THEN round(least(q, 30) * power(1 - d, 2) / sqrt(1 + t) - ln(p) + floor(p / 7 + 0.5) / (n - 4), 4) END AS value FROM l""")
def mth_14_formula(spark: SparkSession, sf: str) -> DataFrame:
    """A user's formula over line items; where it divides by zero it has no value."""
    columns = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "line": F.col("l_linenumber")}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(formula.evaluated(_FORMULA, columns), 4).alias("value"))
