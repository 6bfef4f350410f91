"""DuckDB SQL of the entities that the queries' SQL starts from."""

from __future__ import annotations

from feedloom import vocab as v


def array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"CASE WHEN {plain(x)} = '' THEN 0 ELSE len(string_split({plain(x)}, ' ')) END"


def minutes(x: str, wpm: int = v.WORDS_PER_MINUTE) -> str:
    return f"CAST(floor(({words(x)}) / {wpm}.0 + 0.5) AS BIGINT)"


def title(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def group(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(repr(c) for c in cs)}) THEN '{g}'" for g, cs in v.GROUPS.items()) + " ELSE 'science' END"


ITEMS = f"""items AS (
    SELECT 'd' || d.doc_id AS id, d.doc_id AS ord, d.source, trim(regexp_extract(d.text, '^[^\\n.]{{1,80}}', 0)) AS title, d.text AS body,
           {v.NOW - v.DAY} - d.doc_id * 37 % 43200 * 60 AS published_s, [{array(v.CHANNELS)}[d.doc_id % 18 + 1], {array(v.CHANNELS)}[(d.doc_id * 7 + 3) % 18 + 1]] AS topics,
           CAST(l.quality AS DOUBLE) AS trust, {array(v.ITEM_KINDS)}[d.doc_id % 6 + 1] AS kind, {array(v.SOURCE_TYPES)}[d.doc_id % 9 + 1] AS source_type,
           d.n_chars % 500 AS score, d.doc_id % 50 AS comments, 'https://e.example/' || (d.doc_id % 700) AS url,
           ['p' || (d.doc_id % 41), 'q' || (d.doc_id * 7 % 43), 'r' || (d.doc_id // 2 % 37)] AS entities
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
EVENTS = """ev AS (
    SELECT event_id, 'd' || regexp_extract(props, '(\\d+)', 1) AS item_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'dwell' END AS type,
           CAST(floor(epoch(ts)) AS BIGINT) AS at_s, CASE WHEN event_type = 'purchase' THEN value * 1000 END AS dwell_ms, user_id AS device
    FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
WEIGHT = "CASE type WHEN 'open' THEN 1.0::DOUBLE WHEN 'read' THEN 3.0::DOUBLE ELSE least(coalesce(dwell_ms, 0) / 30000.0::DOUBLE, 5.0::DOUBLE) END"
PROFILE = f"""sums AS (
    SELECT kind, term, sum(({WEIGHT}) * exp(-0.6931471805599453 * ({v.NOW} - at_s) / {v.DAY}.0::DOUBLE / 7)) AS s
    FROM ev JOIN (SELECT id, 'topic' AS kind, unnest(topics) AS term FROM items UNION ALL SELECT id, 'entity', unnest(entities) FROM items) i ON i.id = ev.item_id
    WHERE (SELECT count(*) >= {v.MIN_EVENTS} AND (max(at_s) - min(at_s)) / {v.DAY}.0 >= {v.MIN_DAYS} FROM ev) GROUP BY kind, term),
profile AS (SELECT kind, term, s / max(s) OVER (PARTITION BY kind) AS v FROM sums)"""
REGISTRY = f"""registry AS (
    SELECT 's' || c_custkey AS id, c_custkey AS n, CASE WHEN c_custkey % 11 = 0 THEN 'disabled' WHEN c_custkey % 7 = 0 THEN 'failing' WHEN c_custkey % 5 = 0 THEN 'dormant' ELSE 'active' END AS status,
           c_custkey % 11 <> 0 AS enabled, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 3 ELSE 0 END AS strikes, CASE WHEN c_custkey % 11 = 0 THEN {v.NOW} - (c_custkey % 20) * {v.DAY} END AS disabled_s,
           {v.NOW} - (c_custkey % 60) * {v.DAY} AS last_ok_s, {array(v.CHANNELS)}[c_custkey % 18 + 1] AS channel FROM customer)"""
OUTCOMES = """last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(epoch(o_orderdate)) DESC, o_orderkey DESC) AS rn FROM orders),
outcomes AS (SELECT 's' || o_custkey AS id, o_orderstatus = 'O' AS ok, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 4 THEN 403 END WHEN o_orderstatus = 'P' AND o_orderkey % 5 < 3 THEN 503 END AS http_status,
                    CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 5 WHEN 2 THEN 'dns' WHEN 3 THEN 'not-a-feed' ELSE 'http-4xx' END WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 5 < 3 THEN 'http-5xx' ELSE 'timeout' END END AS error_kind,
                    CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 4 ELSE 0 END AS item_count FROM last WHERE rn = 1)"""
PERMANENT = "coalesce(NOT ok AND (error_kind IN ('dns', 'not-a-feed') OR error_kind = 'http-4xx' AND http_status IN (404, 410)), false)"
REGISTRABLE = "CASE WHEN len(string_split({x}, '.')) <= 2 THEN {x} WHEN length(string_split({x}, '.')[-1]) = 2 AND string_split({x}, '.')[-2] IN ('co', 'com', 'org', 'net', 'gov', 'edu', 'ac') THEN array_to_string(string_split({x}, '.')[-3:], '.') ELSE array_to_string(string_split({x}, '.')[-2:], '.') END"
# title sessions: gaps over 36 hours split the items of one title
SESSIONS = f"""keyed AS (SELECT *, {title('title')} AS key FROM items),
gaps AS (SELECT *, coalesce(CAST(published_s - lag(published_s) OVER (PARTITION BY key ORDER BY published_s, id) > {v.SAME_TITLE_HOURS * 3600} AS INT), 0) AS far FROM keyed),
sessions AS (SELECT *, CASE WHEN key <> '' THEN sum(far) OVER (PARTITION BY key ORDER BY published_s, id) END AS session FROM gaps)"""
GROUPS = f"""{SESSIONS},
one AS (SELECT ord, min(ord) OVER (PARTITION BY key, session) AS b FROM sessions WHERE session IS NOT NULL
        UNION SELECT ord, min(ord) OVER (PARTITION BY url) FROM sessions WHERE url IS NOT NULL),
edges AS (SELECT ord AS a, b FROM one UNION SELECT b, ord FROM one),
reach AS (SELECT ord AS a, ord AS b FROM items UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
grouped AS (SELECT i.*, g.grp FROM items i JOIN (SELECT a, min(b) AS grp FROM reach GROUP BY a) g ON g.a = i.ord)"""
TOKENS = f"""tok AS (SELECT ord, list_sort(list_distinct(list_filter(string_split({title('title')}, ' '), lambda w: w <> '' AND NOT list_contains({array(v.STOPWORDS)}, w)))) AS words FROM items),
story AS (SELECT a.ord AS x, b.ord AS y FROM tok a JOIN tok b ON a.ord < b.ord AND len(a.words) > 0 AND len(b.words) > 0
          WHERE len(list_intersect(a.words, b.words)) >= 0.6::DOUBLE * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) - 1e-9)"""
CLUSTERS = f"""{TOKENS},
shared AS (SELECT a.ord AS x, b.ord AS y FROM (SELECT ord, unnest(entities) AS e FROM items) a JOIN (SELECT ord, unnest(entities) AS e FROM items) b ON a.e = b.e AND a.ord < b.ord GROUP BY ALL HAVING count(*) >= 2),
told AS (SELECT x, y FROM story UNION SELECT x, y FROM shared),
sedge AS (SELECT x AS a, y AS b FROM told UNION ALL SELECT y, x FROM told),
sreach AS (SELECT ord AS a, ord AS b FROM items UNION SELECT r.a, e.b FROM sreach r JOIN sedge e ON r.b = e.a),
comp AS (SELECT a AS ord, min(b) AS c FROM sreach GROUP BY a),
cid AS (SELECT c, substr(sha1(string_agg(i.id, '|' ORDER BY i.id)), 1, 12) AS cluster_id FROM comp JOIN items i USING (ord) GROUP BY c),
clustered AS (SELECT i.*, cid.cluster_id FROM items i JOIN comp USING (ord) JOIN cid USING (c))"""


def scored(weights: dict[str, float] | None = None, peak: float = v.PEAK_MINUTES, sigma: float = v.SIGMA_MINUTES, half_life: float = v.HALF_LIFE_DAYS) -> str:
    """Items with their terms and total."""
    w = v.WEIGHTS | (weights or {})
    return f"""liked AS (SELECT id, sum(v / n) AS liked FROM (SELECT id, 'topic' AS kind, unnest(topics) AS term, len(topics) AS n FROM items UNION ALL SELECT id, 'entity', unnest(entities), len(entities) FROM items) JOIN profile USING (kind, term) GROUP BY id),
scored AS (SELECT c.*, count(*) OVER (PARTITION BY cluster_id) AS cluster_size,
    {w['recency']}::DOUBLE * exp(-0.6931471805599453 * greatest(({v.NOW} - published_s) / {v.DAY}.0::DOUBLE, 0) / {half_life}) AS recency,
    {w['trust']}::DOUBLE * coalesce(trust, 0.5::DOUBLE) AS trust_term, {w['metrics']}::DOUBLE * log10(1 + greatest(score + comments, 0)) / 5 AS metrics,
    {w['cluster']}::DOUBLE * log10(CAST(count(*) OVER (PARTITION BY cluster_id) AS DOUBLE)) AS cluster,
    CASE WHEN length({plain('body')}) > 800 THEN {w['full_text']}::DOUBLE WHEN kind IN ('video', 'audio') THEN {w['media']}::DOUBLE ELSE 0 END AS content,
    {w['read_time']}::DOUBLE * exp(-({minutes('body')} - {peak}::DOUBLE) * ({minutes('body')} - {peak}::DOUBLE) / {2 * sigma * sigma}) AS read_time,
    {w['affinity']}::DOUBLE * coalesce(liked, 0) AS affinity
    FROM clustered c LEFT JOIN liked USING (id)),
total AS (SELECT *, recency + trust_term + metrics + cluster + content + read_time + affinity AS total FROM scored)"""


SCORED = scored()
RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY total DESC, id) - 1 AS place FROM total)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


FULL_SCORE = with_(ITEMS, EVENTS, PROFILE, CLUSTERS, SCORED)
FULL_RANK = with_(ITEMS, EVENTS, PROFILE, CLUSTERS, SCORED, RANKED)
