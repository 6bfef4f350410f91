import collections
import hashlib

import numpy as np
import pytest

import feedloom.llm.suffix_dedup as suffix
from feedloom.llm.exact_dedup import CountingQuotientFilter, exact_dedup
from feedloom.llm.ngram_jaccard import jaccard_components
from tests.llm.conftest import edge_rows, frame


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts, every = [], collections.Counter()
    for _ in range(4):
        k, c = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64) % np.uint64(997) * np.uint64(2**54), return_counts=True)
        parts.append(CountingQuotientFilter.build(k, c))
        every.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    merged = CountingQuotientFilter.merge(parts)
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == dict(every)
    assert CountingQuotientFilter.merge([]).fingerprints().tolist() == []


def test_exact_dedup(edges, empty):
    rows = edge_rows()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(edges).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert exact_dedup(empty).collect() == []


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and den * i >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None) if sets[a] else i))
    return out


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(edges, empty, k, num):
    got = [tuple(r) for r in jaccard_components(edges, k, num, 100).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(edge_rows(), k, num, 100)))
    assert jaccard_components(empty, k, num, 100).collect() == []


def test_links_beyond_the_first_star(spark):
    """A chain whose ends are unlike: the bucket's pivot links only some, the rest comes from pairs between components."""
    w = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w[2 * i : 2 * i + 60])) for i in range(40)]
    got = {tuple(r) for r in jaccard_components(frame(spark, rows), 4, 85, 100).collect()}
    assert got == set(brute_components(rows, 4, 85, 100))
    assert len({c for _, _, c in got}) == 1


def brute_repeats(rows, length, keep_first):
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    count, first = collections.Counter(), {}
    for i in order:
        for s in range(len(texts[i]) - length + 1):
            g = texts[i][s : s + length]
            count[g] += 1
            first.setdefault(g, (i, s))
    out = []
    for i, t in enumerate(texts):
        m = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - length + 1):
            g = t[s : s + length]
            if count[g] > 1 and not (keep_first and first[g] == (i, s)):
                m[s + 1 : s + 1 + length] = True
        edge = np.flatnonzero(np.diff(m.astype(int)))
        out.append((rows[i][0], len(t), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), t if not len(edge) else np.frombuffer(t, np.uint8)[~m[1:-1]].tobytes()))
    return out


def rows_of(df):
    return [(r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in df.collect()]


def test_longest_factors_of_small_strings():
    """Factor lengths in suffix order against a comparison of all pairs of suffixes."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, gram = 30, 2
        contexts = [bytes(rng.integers(97, 99, rng.integers(6, 14)).astype(np.uint8)) for _ in range(n)]
        reach = np.array([rng.integers(0, len(c) - gram) for c in contexts])
        contexts = [c[:r] + b"ab" + c[r + 2 :] for c, r in zip(contexts, reach, strict=True)]
        group = np.sort(rng.integers(0, 3, n))
        at = np.cumsum([0, *map(len, contexts)])
        data = np.frombuffer(b"".join(contexts), np.uint8)
        position = rng.permutation(n)
        for d, order, lcp in suffix.suffix_orders(data, at[:-1] + reach, reach, np.diff(at) - reach, group):
            tails = {i: contexts[i][reach[i] - d :] for i in range(n) if reach[i] >= d}
            assert sorted(order.tolist()) == sorted(tails)
            shown = [(group[i], tails[i]) for i in order]
            assert shown == sorted(shown)

            def common(i, j):
                k = 0
                while group[i] == group[j] and k < min(len(tails[i]), len(tails[j])) and tails[i][k] == tails[j][k]:
                    k += 1
                return k

            for least in (1, 4):
                got = suffix.longest_factors(position[order], lcp, least)
                want = [max((common(i, j) for j in tails if position[j] < position[i]), default=0) for i in order]
                assert got.tolist() == [x if x >= least else 0 for x in want]


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_remove_every_copy(spark, empty, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = edge_rows()
    got = rows_of(suffix.remove_repeats(frame(spark, rows), 60, 20, keep_first=False))
    assert sorted(map(repr, got)) == sorted(map(repr, brute_repeats(rows, 60, False)))
    assert suffix.remove_repeats(empty, 60, 20).collect() == []


@pytest.mark.parametrize("group", [1, 1000])
def test_keep_the_first_copy(spark, monkeypatch, group):
    """Also with null and repeated ids: null ids come first, equal rows of one id keep alike."""
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = edge_rows()
    got = rows_of(suffix.remove_repeats(frame(spark, rows), 60, 20, keep_first=True))
    assert sorted(map(repr, got)) == sorted(map(repr, brute_repeats(rows, 60, True)))
