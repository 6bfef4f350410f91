"""Queries on transcripts, drafts' markup, conflicts, positions of outlets, and what dashboards and writers are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import markup, text, transcripts
from feedloom.operators import analytics, divergence, ground, scaling
from feedloom.operators.graph import Workspace
from feedloom.plans import sql as q
from feedloom.plans.feeds import scored
from feedloom.sources.entities import features, items, registry, table


def raw_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations (conv_id, text) as machine-made transcripts: a line a turn; some turns begin with an advertisement or end in a loop."""
    n = F.col("turn") + F.col("conv_id")
    ad = F.when(n % 3 == 0, "This episode is sponsored by Acme. Online help for everyone. ").when(n % 7 == 1, "Use code SAVE today. Terms apply. Short. ").otherwise("")
    line = F.concat(ad, F.coalesce("text", F.lit("")), F.when(n % 4 == 1, F.repeat(F.lit(" And so on"), 7)).otherwise(""))
    talks = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return talks.select("conv_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("text"))


@query()
def str_13_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts without loops and advertisements (tested against a loop; SQL has no back references)."""
    return transcripts.cleaned(raw_transcripts(spark, sf))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k, 5 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS line FROM documents)
    SELECT doc_id AS id, CAST(line AS INTEGER) AS line, CAST(CASE k WHEN 1 THEN 21 WHEN 2 THEN 20 WHEN 3 THEN 15 ELSE 9 END AS INTEGER) AS "column", 'Figure' AS tag, CASE k WHEN 1 THEN 'quote in value' WHEN 2 THEN 'escaped quote' WHEN 3 THEN 'unterminated value' ELSE 'unexpected character' END AS rule FROM d WHERE k BETWEEN 1 AND 4""")
def str_17_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts out of documents, each with a head and a component that may be faulty (or is code), and what is wrong with it and where."""
    tags = ['<Figure title="fine" wide data={{a: "b"}} />', '<Figure title="say "" aloud" />', '<Figure title="say \\"aloud\\"" />', '<Figure title="open\n/>', "<Figure =bare />", '`<Figure title="say "" so" />`']
    tag = F.get(F.array(*map(F.lit, tags)), (F.col("doc_id") % 6).cast("int"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[`~<]", "'")
    drafts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("---\ntitle: <Draft =\n---\n"), body, F.lit(" "), F.lit("\n"), tag).alias("mdx"))
    return drafts.select("id", F.explode(markup.lint("mdx")).alias("f")).select("id", "f.*")


_WAR = """r AS (SELECT o_custkey AS event, o_orderkey AS id, o_orderkey % 11 AS outlet, CASE WHEN o_orderkey % 11 % 3 = 0 THEN 'east' WHEN o_orderkey % 11 % 3 = 1 THEN 'west' END AS side FROM orders),
    e AS (SELECT event, a, b FROM (SELECT o_custkey AS event, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_orderpriority AS p FROM orders) WHERE b IS NOT NULL AND p IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
    u AS (SELECT event, a AS id, b AS other FROM e UNION SELECT event, b, a FROM e),
    s AS (SELECT r.event, r.id, count(DISTINCT o.outlet) AS confirmed, count(DISTINCT o.side) AS sides, count(DISTINCT o.side) FILTER (o.side <> r.side) AS across FROM r JOIN u USING (event, id) JOIN r o ON o.event = u.event AND o.id = u.other WHERE o.outlet <> r.outlet GROUP BY ALL)"""


@query(q.with_(_WAR) + "SELECT r.id, coalesce(confirmed, 0) AS confirmed, coalesce(confirmed, 0) = 0 AS single_source, coalesce(sides > 1 OR across > 0, false) AS opposed, CASE WHEN coalesce(sides > 1 OR across > 0, false) THEN 1.0::DOUBLE WHEN confirmed > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS weight FROM r LEFT JOIN s USING (event, id)")
def spc_03_wartime(spark: SparkSession, sf: str) -> DataFrame:
    """Reportings of a conflict (orders of a customer): which are confirmed by nobody, within one side, or across sides."""
    from pyspark.sql import Window

    k, side = F.col("o_orderkey"), F.col("o_orderkey") % 11 % 3
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), k.alias("id"), (k % 11).alias("outlet"), F.when(side == 0, "east").when(side == 1, "west").alias("side"), "o_orderpriority")
    after = F.lead("id").over(Window.partitionBy("event").orderBy("id"))
    edges = o.select("event", F.col("id").alias("a"), after.alias("b"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "entails").otherwise("neutral").alias("relation")).where("b is not null")
    return divergence.wartime(o.drop("o_orderpriority"), edges).select("id", "confirmed", "single_source", "opposed", "weight")


@query()
def spc_07_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as outlets on one line by their words (the sources' texts are drawn alike and have no line); tested with planted positions."""
    words = table(spark, sf, "documents").select(F.col("lang").alias("source"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = Workspace(spark).write(words.groupBy("source", "word").agg(F.count("*").alias("n")), "counts")
    ends = counts.agg(F.min("source"), F.max("source")).first()  # one row
    if ends[0] == ends[1]:  # nothing to scale by
        return spark.createDataFrame([], "source string, n bigint, omega double, se double")
    sources, _ = scaling.wordfish(counts, *ends)
    return sources.select("source", "n", F.round("omega", 2).alias("omega"), F.round("se", 4).alias("se"))


_AUTHOR = "CASE WHEN ord % 13 > 0 THEN 'writer ' || (ord % 37) ELSE ' ' END"
_SHOWN = f", m AS (SELECT *, {q.group('topics[1]')} AS grp, topics[1] AS channel, {_AUTHOR} AS author, greatest(1, {q.minutes('body')}) AS read, coalesce(affinity, 0) AS taste FROM total)"


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("ord")
    author = F.when(n % 13 > 0, F.concat(F.lit("writer "), (n % 37).cast("string"))).otherwise(" ")
    rows = scored(spark, sf).drop("trust").join(items(spark, sf).select("id", "trust"), "id")  # the score's term has the same name
    return Workspace(spark).write(rows.withColumn("author", author), "shown")


def _unpivoted(block: str, rows: str, key: str, columns: list[str], to: str) -> str:
    return " UNION ALL ".join(f"SELECT '{block}', CAST({key} AS VARCHAR), '{c}', {'CAST(' + c + ' AS BIGINT), NULL' if to == 'n' else 'NULL, CAST(' + c + ' AS DOUBLE)'} FROM {rows}" for c in columns)


_BOARD = f""", c AS (SELECT cluster_id, grp, channel, count(*) AS n FROM m GROUP BY ALL), g AS (SELECT cluster_id, grp, sum(n) AS g FROM c GROUP BY ALL),
    cl AS (SELECT cluster_id, arg_min(grp, (-g, grp)) AS grp, sum(g) AS size FROM g GROUP BY 1), cc AS (SELECT cluster_id, any_value(size) AS size, arg_min(channel, (-n, channel)) AS channel FROM cl JOIN c USING (cluster_id, grp) GROUP BY 1), cb AS (SELECT cluster_id, max(total) AS best FROM m GROUP BY 1),
    h AS (SELECT count(*) AS items, sum(read) / 60.0::DOUBLE AS hours, median(read) AS median, count(DISTINCT channel) AS channels, count(DISTINCT source) AS sources, count(*) FILTER (read >= 5) AS long_reads, max(published_s) AS newest_s FROM m),
    t AS (SELECT ord, taste, unnest(topics) AS c FROM m), w AS (SELECT published_s // {v.DAY} - (published_s // {v.DAY} + 3) % 7 AS week, {", ".join(f"count(*) FILTER (grp = {g!r}) AS {g}" for g in v.GROUPS)} FROM m GROUP BY week ORDER BY week DESC LIMIT 26),
    b AS (SELECT source_type, min(read) AS lo, quantile_cont(read, 0.25) AS q1, quantile_cont(read, 0.5) AS median, quantile_cont(read, 0.75) AS q3, max(read) AS hi FROM m GROUP BY 1), x(block, k1, k2, n, x) AS (
    {_unpivoted("hero", "h", "NULL", ["items", "hours", "median", "channels", "sources", "long_reads", "newest_s"], "x")}
    UNION ALL {_unpivoted("week", "w", "week", list(v.GROUPS), "n")} UNION ALL {_unpivoted("box", "b", "source_type", ["lo", "q1", "median", "q3", "hi"], "x")}
    UNION ALL SELECT 'cooccurrence', a.c, b.c, count(*), NULL FROM t a JOIN t b ON a.ord = b.ord AND a.c <> b.c GROUP BY a.c, b.c UNION ALL SELECT 'cluster', cluster_id, channel, CAST(size AS BIGINT), best FROM cc JOIN cb USING (cluster_id) UNION ALL SELECT 'scatter', id, channel, read, taste FROM m
    UNION ALL SELECT 'read_bin', CAST(r.range AS VARCHAR), NULL, count(m.id), NULL FROM range(30) r LEFT JOIN m ON least(read // 2, 29) = r.range GROUP BY r.range UNION ALL SELECT 'trust_bin', CAST(r.range AS VARCHAR), NULL, count(m.id), NULL FROM range(10) r LEFT JOIN m ON trust IS NOT NULL AND least(CAST(floor(trust / 0.1::DOUBLE) AS BIGINT), 9) = r.range GROUP BY r.range
    UNION ALL SELECT 'channel', c, {q.group("c")}, count(*), avg(taste) FROM t GROUP BY c UNION ALL SELECT 'source_type', source_type, NULL, count(*), NULL FROM m GROUP BY source_type
    UNION ALL (SELECT 'top_source', source, NULL, count(*), NULL FROM m GROUP BY source ORDER BY count(*) DESC, source LIMIT 12) UNION ALL (SELECT 'top_author', author, NULL, count(*), NULL FROM m WHERE author <> ' ' GROUP BY author ORDER BY count(*) DESC, author LIMIT 10)
    UNION ALL (SELECT 'top_item', id, channel, read, taste FROM m ORDER BY taste DESC, id LIMIT 10))
    SELECT block, CASE WHEN block = 'hero' THEN k2 ELSE k1 END AS k1, CASE WHEN block <> 'hero' THEN k2 END AS k2, CAST(n AS BIGINT) AS n, round(CAST(x AS DOUBLE), 5) AS x FROM x"""


@query(q.FULL_SCORE + _SHOWN + _BOARD)
def pip_08_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """The whole dashboard, all its blocks as rows."""
    return analytics.dashboard(_shown(spark, sf)).withColumn("x", F.round("x", 5))


_BUNDLED = """, s AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'x' WHEN n % 4 = 1 THEN 'rss' ELSE 'news' END AS type, n % 101 / 100.0::DOUBLE AS trust FROM registry), cl AS (SELECT cluster_id, count(*) AS n, sum(total) + log10(1 + count(*)) AS score FROM total GROUP BY 1),
    ch AS (SELECT c, count(*) AS n FROM (SELECT unnest(topics) AS c FROM total) GROUP BY c), l AS (SELECT id, substr(body, 1, 240) AS snippet, coalesce(affinity, 0) AS taste FROM total ORDER BY taste DESC, id LIMIT 150), x(block, k1, k2, n, x) AS (
    SELECT 'meta', 'items', NULL, count(*), NULL FROM total UNION ALL SELECT 'meta', 'included', NULL, count(*), NULL FROM l UNION ALL SELECT 'meta', 'clusters', NULL, count(*), NULL FROM cl UNION ALL SELECT 'meta', 'channels', NULL, count(*), NULL FROM ch UNION ALL SELECT 'meta', 'sources', NULL, count(*), NULL FROM s UNION ALL SELECT 'meta', 'reads', NULL, count(*), NULL FROM pages
    UNION ALL SELECT 'channel', c, NULL, n, NULL FROM ch UNION ALL SELECT 'type', type, NULL, count(*), NULL FROM s GROUP BY type UNION ALL SELECT DISTINCT 'covered', channel, NULL, NULL, NULL FROM s UNION ALL SELECT 'source', id, type, CAST(enabled AS BIGINT), trust FROM s
    UNION ALL SELECT 'cluster', cluster_id, NULL, n, score FROM cl UNION ALL SELECT 'digest', id, snippet, NULL, taste FROM l UNION ALL SELECT 'read', CAST(page_id AS VARCHAR), url, NULL, NULL FROM pages)
    SELECT block, k1, k2, CAST(n AS BIGINT) AS n, round(CAST(x AS DOUBLE), 5) AS x FROM x"""


@query(q.with_(q.ITEMS, q.EVENTS, q.PROFILE, q.CLUSTERS, q.SCORED, q.REGISTRY) + _BUNDLED)
def pip_09_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """All that a writer is given: numbers, channels, sources, stories, the best liked items, earlier reads (here: pages)."""
    n = F.col("n")
    snippets = items(spark, sf).select("id", F.substring("body", 1, 240).alias("snippet"))
    rows = Workspace(spark).write(scored(spark, sf).join(snippets, "id"), "rows")
    sources = registry(spark, sf).withColumns({"type": F.when(n % 4 == 0, "x").when(n % 4 == 1, "rss").otherwise("news"), "trust": n % 101 / 100})
    reads = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"))
    return analytics.bundle(rows, sources, reads).withColumn("x", F.round("x", 5))


@query(q.with_(q.ITEMS) + f"""SELECT source, count(*) AS n, floor(avg({q.minutes('body')}) * 10 + 0.5) / 10 AS mean_minutes, max(published_s) AS last_s, any_value(channels) AS channels, any_value(newest) AS newest FROM items JOIN (SELECT source, string_agg(DISTINCT c, ',' ORDER BY c) AS channels FROM (SELECT source, unnest(topics) AS c FROM items) GROUP BY source) USING (source)
    JOIN (SELECT source, string_agg(id, ',' ORDER BY published_s DESC, id) AS newest FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY source ORDER BY published_s DESC, id) <= 5) GROUP BY source) USING (source) GROUP BY source""")
def agg_14_produced(spark: SparkSession, sf: str) -> DataFrame:
    """What each source has produced: its channels and its five newest items."""
    return analytics.produced(features(spark, sf))


@query("""SELECT url AS name, 'search' AS origin, page_id AS seen FROM pages UNION ALL SELECT s_name, 'registry', NULL FROM supplier UNION ALL SELECT DISTINCT source, 'feed', NULL FROM documents""")
def set_01_union(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates of three generators as one table."""
    pages = table(spark, sf, "pages").select(F.col("url").alias("name"), F.col("page_id").alias("seen"))
    known = table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    feeds = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return ground.generated({"search": pages, "registry": known, "feed": feeds}).select("name", "origin", "seen")


@query(q.with_(q.ITEMS) + f"SELECT author, count(*) AS n FROM (SELECT {_AUTHOR} AS author FROM items) WHERE author <> ' ' GROUP BY author ORDER BY n DESC, author LIMIT 10")
def srt_05_top_authors(spark: SparkSession, sf: str) -> DataFrame:
    """The ten authors with most items, blank names left out (the limit is the feature)."""
    n = F.col("ord")
    author = F.when(n % 13 > 0, F.concat(F.lit("writer "), (n % 37).cast("string"))).otherwise(" ")
    rows = items(spark, sf).select(author.alias("author")).where(F.trim("author") != "")
    return rows.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(10)
