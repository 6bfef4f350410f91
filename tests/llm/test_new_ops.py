import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import centroids, phrases
from feedloom.llm.line_dedup import keep_lines, line_bitmaps
from feedloom.llm.phrases import collocations
from tests.llm.conftest import edge_rows, frame

# centroids ------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale, seed):
    """Python's integers throughout."""
    kept = [(i, [math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x], x) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centres = [q for _, q, _ in order[:k]]

    def near(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, q, _ in kept:
            own[near(q)[0]].append(q)
        centres = [[sum(v) // len(own[j]) for v in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centres)]
    found = [(i, *near(q)) for i, q, _ in kept]
    by = collections.Counter()
    for _, c, d in found:
        by[c] += d
    cap = (1 << 63) - 1
    return sorted((repr(i), c, min(d, cap), min(by[c], cap), min(sum(by.values()), cap), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found)


def got_clusters(df):
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 1, "c", 0.5) for i, x in rows], f"vec_id bigint, embedding array<{kind}>, id int, x string, distance double")


@pytest.mark.parametrize("size", [1.0, 1e13, 1e300])
def test_clusters_are_exact_at_every_magnitude(spark, size):
    """Small ones by matrix products, those whose sums may pass 2^53 by integers; ties, copies, nulls and odd vectors."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * size for _ in range(4)]) for i in range(60)]
    rows += [(i, [0.0, -0.0, 0.25, -0.25]) for i in range(60, 75)] + [(7, rows[7][1])] * 5 + [(None, [0.1, 0.2, 0.3, 0.4])] * 2
    rows += [(80, None), (81, []), (82, [1.0] * 3), (83, [1.0] * 5), (84, [1.0, None, 1.0, 1.0]), (85, [1.0, float("nan"), 1.0, 1.0]), (86, [float("inf"), 1.0, 1.0, 1.0])]
    rows.append((87, [1.7e308, -1.7e308, 5e-324, 1.0]))
    got = got_clusters(centroids.cluster(vectors(spark, rows), k=5, rounds=4, dims=4)[0])
    assert got == brute_clusters(rows, 5, 4, 4, 1024, 3)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5])]
    out, centres = centroids.cluster(vectors(spark, rows, "float"), k=8, rounds=3, dims=2)
    assert len(centres) == 2 and got_clusters(out) == brute_clusters(rows, 8, 3, 2, 1024, 3)
    out, centres = centroids.cluster(vectors(spark, [(1, None)]), dims=2)
    assert centres == [] and out.collect() == []


def test_products_and_integers_agree():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 1e6, (50, 64)))
    c = [[int(v) for v in row] for row in np.floor(rng.normal(0, 1e6, (8, 64)))]
    assert 64 * (int(np.abs(x).max()) + max(abs(v) for r in c for v in r)) ** 2 < centroids.EXACT
    fast, slow = centroids.nearest(x, c), centroids.nearest(x.astype(np.int64).astype(object), c)
    assert fast[0].tolist() == slow[0].tolist() and fast[1].tolist() == slow[1].tolist()
    near = fast[0]
    assert centroids.cluster_sums(x, near, 8).tolist() == centroids.cluster_sums(x.astype(np.int64).astype(object), near, 8).tolist()


# phrases --------------------------------------------------------------------------------------------------------------


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_phrases(rows, top, least, longest, cover):
    f, n = collections.Counter(), collections.Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(t or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = collections.defaultdict(list)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in often.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in often.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def phrase_rows():
    rng = random.Random(9)
    names = ["a", "B", "c", "Dé", "éd", "x y", "日本", "the", "of", "-"]
    rows = [(rng.choice(["en", "de", None, "und", "x\ny"]), " ".join(rng.choice(names[: rng.randint(2, 10)]) + rng.choice(["", "", "", ".", ",", "\n", "\t", "\r\n", "; "]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "new york city hall " * 40), ("en", "a a a a a a a a " * 200), ("en", None), (None, ""), ("de", " .,;\n\n"), ("zz", "alone")] + [("en", rows[0][1])] * 5
    rows.append(("fr", " ".join(rng.choice(names) for _ in range(60_000))))
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, 2, "p") for i, (x, t) in enumerate(rows)], "doc_id bigint, text string, lang string, n bigint, rank int, phrase string")


@pytest.mark.parametrize(("top", "least", "longest"), [(40, 5, 4), (None, 25, 5), (10, 5, 2)])
def test_collocations(spark, top, least, longest):
    rows = phrase_rows()
    got = sorted(tuple(r) for r in collocations(documents(spark, rows), top, least, longest).collect())
    assert got and got == brute_phrases(rows, top or 10**9, least, longest, 80)


def test_a_task_that_gathers_much_sends_words_on_early(monkeypatch):
    rows = phrase_rows()[:40]
    batches = [pa.RecordBatch.from_pydict({"lang": pa.array([x or "und" for x, _ in rows]), "body": pa.array([t for _, t in rows])})]
    monkeypatch.setattr(phrases, "_CHUNK", 200)
    whole, parts = (collections.Counter(), collections.Counter())
    for most, found in ((300_000, whole), (3, parts)):
        monkeypatch.setattr(phrases, "_HELD_WORDS", most)
        sent = list(phrases._count_words(iter(batches)))
        assert (len(sent) > 3) == (most == 3)
        for r in pa.Table.from_batches(sent).to_pylist():
            found[r["lang"], r["word"], r["h"]] += r["n"]
    assert whole == parts


def test_collocations_with_split_prefixes(spark):
    """A prefix that holds most occurrences is dealt by its extensions."""
    rows = phrase_rows()[:60] + [("en", "to be or not to be " * 300)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = sorted(tuple(r) for r in collocations(documents(spark, rows), 50, 4).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_phrases(rows, 50, 4, 4, 80)


def test_collocations_without_any(spark, empty):
    assert collocations(empty).collect() == []
    assert collocations(documents(spark, [("en", "so it is"), (None, None)])).collect() == []


# lines ----------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least, documents):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add((i, t or ""))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        last = {k: max((x for x, _ in held[k] if x is not None), default=None) for k in map(key, lines) if len(held.get(k, ())) >= documents}
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def line_rows():
    rng = random.Random(4)
    shared = ["the terms of use apply to every reader " + "x" * 5, "É" * 40, "é" * 40, "short one", "y" * 39, " \tUpper Case Lines Are The Same As LOWER ones " + "z" * 9 + "\r", "日本語" * 14]
    rows = []
    for i in range(60):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"line {i} of its own with some more words {rng.random()}" for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(x.upper() if x.isascii() and rng.random() < 0.3 else x for x in lines)))
    rows += [(59, rows[3][1]), (59, rows[3][1]), (7, rows[7][1]), (None, rows[4][1]), (None, None), (80, None), (81, ""), (82, "\n"), (83, "\n\n" + shared[0] + "\n"), (84, shared[0])]
    rows += [(None, "only null ids have this line, that is " + "n" * 9 + f"\n{k}") for k in range(6)]
    rows.append((85, "\n".join([shared[0]] * 3000 + [f"{j} more and more lines of a long text, all of their own" for j in range(3000)] + [shared[6]] * 10)))
    rows += [(90 + k, shared[6]) for k in range(5)]
    return rows


def test_lines(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 1, "k", b"x", 5, 0) for i, t in rows], "doc_id bigint, text string, n_lines int, key string, keep binary, pos int, h1 bigint")
    got = [tuple(r) for r in keep_lines(docs, line_bitmaps(docs)).collect()]
    assert any(r[2] for r in got) and sorted(map(repr, got)) == brute_lines(rows, 40, 5)


def test_lines_of_edge_rows(edges, empty):
    got = [tuple(r) for r in keep_lines(edges, line_bitmaps(edges, least=3, documents=2)).collect()]
    assert sorted(map(repr, got)) == brute_lines(edge_rows(), 3, 2)
    assert line_bitmaps(empty).collect() == [] and keep_lines(empty, line_bitmaps(empty)).collect() == []


def test_bitmaps_are_joined_by_a_shuffle_beyond_the_bound(spark, monkeypatch):
    rows = line_rows()
    monkeypatch.setattr("feedloom.llm.line_dedup.BROADCAST_BYTES", -1)
    monkeypatch.setattr("feedloom.llm.line_dedup.BROADCAST_LINES", -1)
    docs = frame(spark, rows)
    got = [tuple(r) for r in keep_lines(docs, line_bitmaps(docs)).collect()]
    assert sorted(map(repr, got)) == brute_lines(rows, 40, 5)
