"""Queries on text, URLs, filters and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.catalog import query
from feedloom.functions import sources, text
from feedloom.operators import ground
from feedloom.plans import sql as q
from feedloom.sources.entities import engagements, items, table


@query(q.with_(q.ITEMS, q.TOKENS) + f"SELECT id, {q.title('title')} AS key, CAST(len(words) AS BIGINT) AS n_tokens, regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '', 'g') AS slug FROM items JOIN tok USING (ord)")
def str_01_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    return items(spark, sf).select("id", text.normalise_title(t).alias("key"), F.size(text.title_tokens(t)).cast("bigint").alias("n_tokens"), text.slug(t).alias("slug"))


@query(q.with_(q.ITEMS) + f"SELECT id, CAST(length({q.plain('body')}) AS BIGINT) AS n, {q.minutes('body')} AS minutes, greatest(1, {q.minutes('body')}) AS minutes_shown, {q.minutes('body', 230)} AS minutes_230, round(({q.words('body')}) / 200.0, 6) AS minutes_200 FROM items")
def str_03_read_times(spark: SparkSession, sf: str) -> DataFrame:
    """Four definitions of reading time that differ on purpose."""
    b = F.col("body")
    return items(spark, sf).select("id", F.length(text.plain(b)).cast("bigint").alias("n"), text.read_minutes(b).alias("minutes"), F.greatest(F.lit(1), text.read_minutes(b)).cast("bigint").alias("minutes_shown"), text.read_minutes(b, 230).alias("minutes_230"), F.round(text.word_count(b) / 200, 6).alias("minutes_200"))


_SUM = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


def _summary_sql(table_name: str, key: str, x: str) -> str:
    return f"""WITH t AS (SELECT {key}, {_SUM.format(x=x)} AS t FROM {table_name}), c AS (SELECT *, substr(t, 1, 280) AS cut FROM t),
    s AS (SELECT *, CASE WHEN contains(cut, ' ') THEN 280 - strpos(reverse(cut), ' ') ELSE 0 END AS sp FROM c)
    SELECT {key}, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(CASE WHEN sp > 168 THEN substr(cut, 1, sp) ELSE cut END) || '…' END AS summary FROM s"""


@query(_summary_sql("documents", "doc_id", "text"))
def str_06_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.clean_summary(F.col("text")).alias("summary"))


@query(_summary_sql("pages", "page_id", "html"))
def str_06_page_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.clean_summary(F.col("html")).alias("summary"))


_HOST = "nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\\.', ''), '')"


@query(f"""WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS s FROM h)
    SELECT page_id, host, CASE WHEN len(s) <= 2 THEN host WHEN length(s[-1]) = 2 AND s[-2] IN ('co', 'com', 'org', 'net', 'gov', 'edu', 'ac') THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS domain,
           nullif(regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*://[^/?#]+)', 1), '') AS origin FROM p""")
def url_01_hosts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("host", text.host(F.col("url")))
    return p.select("page_id", "host", text.registrable_domain(F.col("host")).alias("domain"), text.origin(F.col("url")).alias("origin"))


@query(q.with_(q.ITEMS) + "SELECT id, substr(sha1(source_type || '::' || url), 1, 16) AS item_key, substr(sha1(concat_ws('|', source, title)), 1, 12) AS story_key FROM items")
def prj_05_ids(spark: SparkSession, sf: str) -> DataFrame:
    short = lambda c, n: F.substring(F.sha1(c.cast("binary")), 1, n)
    return items(spark, sf).select("id", short(F.concat_ws("::", "source_type", "url"), 16).alias("item_key"), short(F.concat_ws("|", "source", "title"), 12).alias("story_key"))


@query(q.with_(q.ITEMS) + f"SELECT id, topics[1] AS channel, {q.group('topics[1]')} AS grp, substr(body, 1, 240) AS digest FROM items")
def prj_03_digests(spark: SparkSession, sf: str) -> DataFrame:
    c = F.get("topics", 0)
    return items(spark, sf).select("id", c.alias("channel"), text.group_of(c).alias("grp"), F.substring("body", 1, 240).alias("digest"))


_MAKER = ", ".join(f"'{c}'" for c in v.MAKER_CHANNELS)


@query(q.with_(q.ITEMS) + f"""SELECT id, length({q.plain('body')}) > 800 AS full_text, length({q.plain('body')}) <= 800 AND kind IN ('video', 'audio') AS bare_media,
    {q.minutes('body')} >= 5 OR ({q.minutes('body')} >= 3 AND (topics[1] IN ({_MAKER}) OR topics[2] IN ({_MAKER}))) AS long_enough, {q.plain('body')} = '' OR {q.minutes('body')} >= 5 AS above_floor FROM items""")
def flt_01_gates(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("body")
    full, m = text.has_full_text(b), text.read_minutes(b)
    maker = F.arrays_overlap("topics", F.array(*map(F.lit, v.MAKER_CHANNELS)))
    return items(spark, sf).select("id", full.alias("full_text"), (~full & F.col("kind").isin("video", "audio")).alias("bare_media"), ((m >= v.MIN_READ_MINUTES) | (m >= v.MAKER_READ_MINUTES) & maker).alias("long_enough"), ((text.plain(b) == "") | (m >= v.MIN_READ_MINUTES)).alias("above_floor"))


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '(?i)<script\\b') THEN 'script' END, CASE WHEN regexp_matches(html, '(?i)<iframe\\b') THEN 'iframe' END, CASE WHEN regexp_matches(html, '(?i)<(object|embed)\\b') THEN 'object' END,
    CASE WHEN regexp_matches(html, '(?i)<style\\b') THEN 'style' END, CASE WHEN regexp_matches(html, '(?i)<form\\b') THEN 'form' END, CASE WHEN regexp_matches(html, '(?i)\\son[a-z]+\\s*=') THEN 'handler' END,
    CASE WHEN regexp_matches(html, '(?i)javascript:') THEN 'javascript-url' END, CASE WHEN regexp_matches(html, '(?i)data:text/html') THEN 'data-url' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pages""")
def flt_06_unsafe_markup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.array_join(text.unsafe_reasons(F.col("html")), ",").alias("reasons"))


@query(q.with_(q.ITEMS) + "SELECT id FROM items WHERE contains(lower(title || ' ' || source || ' ' || body), 'idiot') AND contains(lower(title || ' ' || source || ' ' || body), 'the') AND (list_has_any(topics, ['ai', 'tech', 'science', 'finance', 'iot']))")
def flt_08_search(spark: SparkSession, sf: str) -> DataFrame:
    """All terms in title, source or body; a facet matches where arrays overlap."""
    hay = F.lower(F.concat_ws(" ", "title", "source", "body"))
    return items(spark, sf).where(hay.contains("idiot") & hay.contains("the") & F.arrays_overlap("topics", F.array(*map(F.lit, ["ai", "tech", "science", "finance", "iot"])))).select("id")


@query(q.with_(q.ITEMS) + f"SELECT id FROM items WHERE published_s >= {v.NOW - 14 * v.DAY}")
def flt_10_recent(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).where(F.col("published_s") >= v.NOW - v.ARCHIVE_DAYS * v.DAY).select("id")


_CITED_URL = "CASE page_id % 6 WHEN 0 THEN 'https://gist.github.com/' || page_id WHEN 1 THEN 'https://www.EN.wikipedia.org/x' WHEN 2 THEN 'https://notgithub.com/y' ELSE url END"
_IGNORED = "len(list_filter(" + q.array(v.IGNORED_DOMAINS) + ", lambda d: {x} = d OR ends_with({x}, '.' || d))) > 0"


def cited_url() -> Column:
    """Addresses of pages, some of them on platforms, one that only looks like it."""
    n = F.col("page_id")
    return F.when(n % 6 == 0, F.concat(F.lit("https://gist.github.com/"), n.cast("string"))).when(n % 6 == 1, "https://www.EN.wikipedia.org/x").when(n % 6 == 2, "https://notgithub.com/y").otherwise(F.col("url"))


@query(f"WITH p AS (SELECT page_id, {_CITED_URL} AS url FROM pages), h AS (SELECT page_id, {_HOST} AS host FROM p) SELECT page_id, host FROM h WHERE host IS NOT NULL AND NOT {_IGNORED.format(x='host')}")
def flt_12_ignored_domains(spark: SparkSession, sf: str) -> DataFrame:
    h = text.host(cited_url())
    return table(spark, sf, "pages").select("page_id", h.alias("host")).where(F.col("host").isNotNull() & ~sources.is_ignored(F.col("host")))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN repeat(text || ' ', 3) ELSE text END AS x FROM conversations), w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(x), '\\s+'), lambda y: y <> '') AS w, list_filter(string_split(regexp_replace(x, '\\s', '', 'g'), ''), lambda y: y <> '') AS c FROM t)
    SELECT conv_id, turn, len(w) = 0 OR len(list_distinct(w)) / len(w) < 0.3::DOUBLE OR len(c) / len(list_distinct(c)) > 7.2::DOUBLE AS degenerate FROM w""")
def flt_20_degenerate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of speech that say nothing: empty ones, those of few different words, and those of few different letters."""
    x = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, F.repeat(F.concat("text", F.lit(" ")), 3)).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.is_degenerate(x).alias("degenerate"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'ok' WHEN o_orderkey % 7 = 0 THEN 'dns' WHEN o_orderkey % 7 = 1 THEN 'timeout' WHEN o_orderkey % 7 = 2 THEN 'not-a-feed' WHEN o_orderkey % 7 IN (3, 4) THEN 'http-4xx' WHEN o_orderkey % 7 = 5 THEN 'http-5xx' ELSE 'network' END AS kind FROM orders")
def flt_23_error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered ladder over messages: status, name lookup, time-out, no feed, else the network."""
    n = F.col("o_orderkey") % 7
    message = F.when(F.col("o_orderstatus") == "O", "").when(n == 0, "getaddrinfo ENOTFOUND host").when(n == 1, "request timed out").when(n == 2, "Feed not recognized").when(n == 3, "HTTP 404").when(n == 4, "Status code 410").when(n == 5, "HTTP 503").otherwise("socket hang up")
    status = F.regexp_extract(message, r"(?i)(?:http|status code) (\d{3})", 1)
    kind = F.when(message == "", "ok").when(status.startswith("4"), "http-4xx").when(status.startswith("5"), "http-5xx").when(message.rlike("(?i)enotfound|eai_again"), "dns").when(message.rlike("(?i)timed? ?out|abort"), "timeout").when(message.rlike("(?i)not recognized|non-whitespace|invalid"), "not-a-feed").otherwise("network")
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


@query("SELECT event_id, event_type AS raw_type, 'unknown type' AS reason FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') OR event_type IS NULL")
def src_02_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return engagements(spark, sf)[1]


@query("SELECT page_id, n FROM (SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS BIGINT) AS n FROM pages)")
def str_18_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1))).cast("bigint").alias("n"))


@query("WITH t AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS tag FROM pages) SELECT tag, count(*) AS n FROM t GROUP BY tag")
def agg_30_tag_usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_LINKED = f"""p AS (SELECT page_id, {_CITED_URL} AS url, regexp_replace(regexp_replace(html, 'href="/([^/"]*)', 'href="https://\\1.example/', 'g'), 'href="https://The', 'href="https://gist.github.com/The', 'g') AS html FROM pages),
    s AS (SELECT page_id, {_HOST} AS own FROM p), known AS (SELECT DISTINCT own FROM s WHERE page_id % 9 = 0 AND own IS NOT NULL UNION SELECT 'and.example'),
    u AS (SELECT page_id, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS url FROM p WHERE page_id % 5 > 0)"""


@query(q.with_(_LINKED) + f"SELECT domain, count(*) AS seen FROM (SELECT DISTINCT page_id, {_HOST} AS domain FROM u WHERE regexp_matches(url, '(?i)^https?://')) d JOIN s USING (page_id) WHERE domain IS NOT NULL AND domain IS DISTINCT FROM own AND domain NOT IN (SELECT own FROM known) AND NOT {_IGNORED.format(x='domain')} GROUP BY domain")
def agg_23_links(spark: SparkSession, sf: str) -> DataFrame:
    """Domains that liked items cite, each counted once an item. The pages' links are relative; here they are put on hosts of their own."""
    html = F.regexp_replace(F.regexp_replace("html", 'href="/([^/"]*)', 'href="https://$1.example/'), 'href="https://The', 'href="https://gist.github.com/The')
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), cited_url().alias("url"), html.alias("body"), (F.col("page_id") % 5).alias("total"))
    known = p.where("id % 9 = 0").select(text.host(F.col("url")).alias("domain")).union(spark.createDataFrame([("and.example",)], "domain string"))
    return ground.mined_domains(p, known, 1)
