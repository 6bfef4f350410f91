"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.centroids import cluster
from feedloom.llm.common import Workspace
from feedloom.llm.decontaminate import contaminated
from feedloom.llm.exact_dedup import exact_dedup
from feedloom.llm.licences import CUES, GAP, RULES, licence_hits, sentence_table, sequence
from feedloom.llm.line_dedup import keep_lines, line_bitmaps
from feedloom.llm.ngram_jaccard import jaccard_components
from feedloom.llm.ngram_lm import score_texts
from feedloom.llm.packing import pack
from feedloom.llm.phrases import collocations
from feedloom.llm.preference import conversations, format_pairs, swapped_answers
from feedloom.llm.suffix_dedup import remove_repeats
from feedloom.llm.toxicity import labelled_texts, toxicity_scores, train
from feedloom.llm.warc import read_records, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a model of those whose id's crc32 is not 1 modulo 5. Null ids are hashed as an empty text."""
    return score_texts(table(spark, sf_dir, "documents"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds; documents without any have no row."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("fp")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages' archives, reads every record back through the index, and resolves revisits."""
    pages, space = table(spark, sf_dir, "pages"), Workspace(spark)
    index = write_archives(pages, space)
    back = read_records(index, space.folder("warc"))
    key = pages.schema["page_id"].dataType
    back = back.select(F.col("page_id").cast(key).alias("page_id"), F.octet_length("payload").cast("bigint").alias("n"), F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest")).alias("sha1"), "record_type", F.col("refers_to").cast(key).alias("refers_to"))
    back = space.write(back, "records")
    stored = back.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "sha1").agg(F.max("n").alias("stored"))
    return back.join(stored, ["refers_to", "sha1"], "left").select("page_id", F.when(F.col("record_type") == "revisit", F.col("stored")).otherwise(F.col("n")).alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preferences: the last answers of neighbouring conversations are swapped to get rejected ones."""
    pairs = format_pairs(swapped_answers(conversations(table(spark, sf_dir, "conversations"))))
    masked = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["stop"] - s["start"]).cast("bigint")
    return pairs.select("conv_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"), *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen_text", "rejected_text")), masked("chosen_mask").alias("chosen_masked"), masked("rejected_mask").alias("rejected_masked"), "usable")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles; documents without words are alone."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays (the largest id); null texts are empty ones."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labelled ones whose id's crc32 is not 2 modulo 4; empty texts are scored too."""
    docs = table(spark, sf_dir, "documents")
    model = train(labelled_texts(docs, table(spark, sf_dir, "labels")))
    return toxicity_scores(docs, model)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; an empty or null text is one piece, its end."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence rules that documents match; documents without any have no row."""
    return licence_hits(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a repeated 400-byte string goes, the first one too."""
    out = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors of 64 components around 8 centroids after 10 rounds."""
    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)[0]


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language, from all texts."""
    return collocations(table(spark, sf_dir, "documents"), top=2000, least=30, longest=4, cover=80)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five or more share, but for the largest id's; bitmaps decide, then texts are read."""
    docs = table(spark, sf_dir, "documents")
    out = keep_lines(docs, line_bitmaps(docs, least=40, documents=5))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_lm": op1_ngram_lm,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_preference": op4_preference,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_licences": op9_licences,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_centroids": op11_centroids,
    "op12_phrases": op12_phrases,
    "op13_line_dedup": op13_line_dedup,
}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _rounds(n: int) -> str:
    """Assignments and centroids of n rounds, a pair of tables a round."""
    near = "n{0} AS MATERIALIZED (SELECT v, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v, c, sum((q - m) * (q - m)) AS d FROM x JOIN c{0} USING (i) GROUP BY v, c) GROUP BY v)"
    step = "c{1} AS MATERIALIZED (SELECT c, i, coalesce(f, m) AS m FROM c{0} LEFT JOIN (SELECT c, i, CAST(floor(sum(q) / count(*)) AS BIGINT) AS f FROM x JOIN n{0} USING (v) GROUP BY c, i) USING (c, i))"
    return ", ".join(y for k in range(n) for y in (near.format(k), step.format(k, k + 1))) + ", " + near.format(n)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    # whole-number sums stay far below 2^53, so the division in double is exact to the floor
    "op11_centroids": f"""
        WITH kept AS (SELECT row_number() OVER () AS v, vec_id, embedding AS e FROM embeddings
                      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
        x AS MATERIALIZED (SELECT v, unnest(range(1, 65)) AS i, CAST(floor(1024 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS q FROM kept),
        seeds AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c FROM kept QUALIFY c < 8),
        c0 AS MATERIALIZED (SELECT c, i, q AS m FROM seeds JOIN x USING (v)), {_rounds(10)},
        sha AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS s FROM c10 GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
        FROM n10 JOIN kept USING (v) JOIN sha USING (c)
    """,
    "op12_phrases": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda y: y <> '') AS w FROM p),
        g AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM w, (VALUES (1), (2), (3), (4)) t(m)),
        f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        cuts AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        s AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score FROM cuts c
              JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') AND l.m = c.k JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ') AND r.m = c.m - c.k),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * f.a >= 80 * b.a)),
        z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op13_line_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
        l AS (SELECT rn, doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
        k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS first FROM (SELECT DISTINCT doc_id, t, key FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
        m AS (SELECT k.*, c.key IS NOT NULL AND doc_id IS DISTINCT FROM first AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rn, doc_id
    """,
    "op4_preference": """
        WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations GROUP BY conv_id),
        l AS (SELECT *, list_max([i FOR i IN range(1, len(turns) + 1) IF turns[i].role = 'assistant']) AS last FROM t),
        p AS (SELECT a.conv_id, a.turns[1:a.last] AS c, a.last,
                     CASE WHEN b.last IS NULL THEN a.turns[1:a.last - 1] ELSE list_append(a.turns[1:a.last - 1], b.turns[b.last]) END AS r
              FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1) AND b.last IS NOT NULL WHERE a.last IS NOT NULL),
        n AS (SELECT *, CASE WHEN c = r THEN last ELSE last - 1 END AS k FROM p),
        s AS (SELECT conv_id, k, [CASE WHEN i <= k THEN c[i] END FOR i IN range(1, k + 1)] AS pr, c[k + 1:] AS cc, r[k + 1:] AS rr FROM n),
        x AS (SELECT conv_id, k, cc, rr,
                     coalesce(array_to_string(['<|' || e.role || '|>' || chr(10) || e.text || '<|end|>' || chr(10) FOR e IN pr], ''), '') AS a,
                     coalesce(array_to_string(['<|' || e.role || '|>' || chr(10) || e.text || '<|end|>' || chr(10) FOR e IN cc], ''), '') AS b,
                     coalesce(array_to_string(['<|' || e.role || '|>' || chr(10) || e.text || '<|end|>' || chr(10) FOR e IN rr], ''), '') AS d FROM s)
        SELECT conv_id, k AS prompt_turns, sha256(a) AS prompt_sha256, sha256(b) AS chosen_text_sha256, sha256(d) AS rejected_text_sha256,
               CAST(coalesce(list_sum([length(e.text) + 8 FOR e IN cc IF e.role = 'assistant']), 0) AS BIGINT) AS chosen_masked,
               CAST(coalesce(list_sum([length(e.text) + 8 FOR e IN rr IF e.role = 'assistant']), 0) AS BIGINT) AS rejected_masked,
               len([1 FOR e IN cc IF e.role = 'assistant']) > 0 AND len([1 FOR e IN rr IF e.role = 'assistant']) > 0 AND b <> d AS usable
        FROM x
    """,
    "op9_licences": f"""
        WITH known(sentence, sid) AS (VALUES {_values(sentence_table())}),
        rules(licence, rule, pattern, sequence, n_sentences) AS (VALUES {_values([(a, b, ">" + ">".join(c) + ">", sequence(c), len(c)) for a, b, c in RULES])}),
        docs AS (SELECT doc_id, text, row_number() OVER () AS rn FROM documents WHERE regexp_matches(lower(text), '{CUES}')),
        cuts AS (SELECT rn, doc_id, 0 AS way, string_split_regex(regexp_replace(text, '\\s+', ' ', 'g'), '[.!?;]+(?: |$)') AS p FROM docs
                 UNION ALL SELECT rn, doc_id, 1, string_split_regex(text, '[\\r\\n]+') FROM docs),
        parts AS (SELECT rn, doc_id, way, unnest(p) AS part, generate_subscripts(p, 1) AS place FROM cuts),
        hits AS (SELECT DISTINCT rn, doc_id, way, place, sid FROM parts JOIN known ON known.sentence = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
        marked AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY rn, way ORDER BY place, sid) > {GAP + 1} THEN '|>' ELSE '' END || sid AS m FROM hits),
        lines AS (SELECT rn, doc_id, '>' || string_agg(m, '>' ORDER BY place, sid) || '>' AS line FROM marked GROUP BY rn, doc_id, way),
        found AS (SELECT DISTINCT rn, doc_id, licence, rule, pattern, sequence, n_sentences FROM lines JOIN rules ON regexp_matches(line, sequence))
        SELECT DISTINCT doc_id, licence, rule, n_sentences FROM found a
        WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.rn = a.rn AND b.n_sentences > a.n_sentences AND regexp_matches(b.pattern, a.sequence))
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM g
    """,
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
}
