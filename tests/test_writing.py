"""Transcripts, markup, positions of outlets and conflicts against loops and planted values."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import markup, prose, transcripts
from feedloom.operators import analytics, divergence, ground, scaling


def loop_collapsed(words):
    for n in range(3, 8):
        out, i = [], 0
        while i < len(words):
            group, j = [w.lower() for w in words[i : i + n]], i + n
            while len(group) == n and [w.lower() for w in words[j : j + n]] == group:
                j += n
            if len(group) == n and j - i >= 5 * n:
                out += words[i : i + n]
                i = j
            else:
                out.append(words[i])
                i += 1
        words = out
    return words


def is_ad(s):
    brands = sum(2 for b in prose.BRANDS if re.search(rf"(?i)\b{b}\b", s))
    return any(re.search("(?i)" + p, s) for p in prose.TRIGGERS) or brands + sum(1 for p in prose.LEXICON if re.search("(?i)" + p, s)) >= 5


def loop_cleaned(text):
    parts = [re.sub(r"\s+", " ", s).strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*", text or "")]
    parts = [s for s in parts if s]
    start = 0
    for i, s in enumerate(parts):
        if not is_ad(s) and (len(s) >= 40 or re.search(transcripts.SIGNALS, s) or i + 1 == len(parts) or not is_ad(parts[i + 1])):
            start = i
            break
    kept, skip = [], False
    for s in parts[start:]:
        rest, skip = skip, False
        if rest and len(s) <= 50 and not re.search(transcripts.OPENINGS, s):
            continue
        if is_ad(s):
            skip = True
            continue
        kept.append(s)
    out = " ".join(kept)
    return "" if re.search(r"^\d+$|-->", out) else out


def test_loops_of_words(spark):
    rng = random.Random(8)
    texts = [[rng.choice("a b c A".split()) for _ in range(rng.randint(0, 60))] for _ in range(150)]
    texts += [("x y z " * k).split() + ["x", "y", "zoo"] for k in (1, 4, 5, 6, 5000)] + [("one two three four five six seven " * 9).split(), ["a"] * 40, []]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", transcripts.collapse_loops(F.col("t")).alias("t")).collect():
        assert r["t"].split() == loop_collapsed(texts[r["k"]]), texts[r["k"]][:80]


def test_transcripts(spark):
    rng = random.Random(4)
    pool = ["This episode is sponsored by Acme.", "Short.", "Now we go on.", "It was late.", "Okay.", "Terms apply here and everywhere, as long as this offer stands for you all.", "A long sentence about rivers and the towns that lie on them.", "Brought to you by Schwab and all those who like it, and by many others too.", "So it goes!", "12"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(250)] + [None, "", " \n ", "77", "00:01 --> 00:02", "Short. " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in transcripts.cleaned(df, "t").collect():
        t = texts[r["k"]]
        want = loop_cleaned(t) if (t or "").count("Short.") < 100 else "Short. Short. Short."
        assert r["t"] == want, t


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<Card title="a" wide n={f({a: "}"})} />', [(1, 35, "Card", "unexpected character")]),  # braces are counted, strings in them are not read
        ('<Card title="a" wide n={f({a: "x"})} />', []),
        ('\n <Card t="say "it"" />', [(2, 18, "Card", "quote in value")]),
        ('<A t="x""/><B t=\'\\"\'/>', [(1, 9, "A", "quote in value"), (1, 18, "B", "escaped quote")]),
        ('<A t="x\n y"/>', [(1, 6, "A", "unterminated value")]),
        ("<A x=y z = 'q' / b>", []),
        ("```js\n<A =\n```\n`<B =` <c = <D", []),
        ("---\nx: <A =\n---\n<B =", [(4, 4, "B", "unexpected character")]),
        ('<A t="\\n" u="\\', [(1, 13, "A", "unterminated value")]),
        ("<A b={ {", []),
        (None, []),
        ("", []),
    ],
)
def test_lint(text, want):
    assert [(f["line"], f["column"], f["tag"], f["rule"]) for f in markup.faults(text)] == want


def test_lint_in_spark(spark):
    rows = spark.createDataFrame([(1, "<A ="), (2, None)], "k int, t string").select("k", markup.lint("t").alias("f")).collect()
    assert {r["k"]: [tuple(x) for x in r["f"]] for r in rows} == {1: [(1, 4, "A", "unexpected character")], 2: []}


def planted(many, words):
    rng = np.random.default_rng(3)
    omega = np.sort(rng.normal(size=many))
    omega = (omega - omega.mean()) / omega.std()
    mu = np.exp(rng.normal(size=(many, 1)) / 2 + 1 + rng.normal(size=words) + omega[:, None] * rng.normal(size=words) / 2)
    return omega, rng.poisson(mu)


def test_positions_are_recovered(spark):
    omega, y = planted(10, 200)
    rows = [(f"s{i}", f"w{j}", int(y[i, j])) for i in range(10) for j in range(200)] + [(None, "w1", 5), ("s1", None, 5), ("s1", "w1", None), ("zz", "w1", 0)]
    sources, words = scaling.wordfish(spark.createDataFrame(rows, "source string, word string, n bigint").repartition(3), "s0", "s9")
    got = {r["source"]: r for r in sources.collect()}
    assert sorted(got) == [f"s{i}" for i in range(10)]
    x = np.array([got[f"s{i}"]["omega"] for i in range(10)])
    assert abs(x.mean()) < 1e-6 and abs(x.std() - 1) < 1e-6 and np.corrcoef(x, omega)[0, 1] > 0.99
    assert all(0 < r["se"] < 0.2 and r["n"] == y[int(s[1:])].sum() for s, r in got.items())
    assert words.count() == (y.sum(0) > 0).sum()
    # every word's slopes vanish at its fit
    alpha = np.array([got[f"s{i}"]["alpha"] for i in range(10)])
    for w in words.limit(20).collect():
        counts = y[:, int(w["word"][1:])]
        rest = counts - np.exp(alpha + w["psi"] + w["beta"] * x)
        assert abs(rest.sum()) < 1e-3 and abs(rest @ x - w["beta"] / 9) < 1e-3


def test_words_used_alike_are_fitted_once_and_count_each(spark):
    """Two rows of counts, however many words have them."""
    counts = [("a", f"w{j}", 1 + j % 2) for j in range(50)] + [("b", f"w{j}", 3) for j in range(50) if j % 2]
    words = spark.createDataFrame([(f"w{j}", [(k, n) for k, (s, w, n) in enumerate((("a", f"w{j}", 1 + j % 2), ("b", f"w{j}", 3 * (j % 2)))) if n]) for j in range(50)], "word string, uses array<struct<k: int, n: bigint>>")
    assert sorted(map(tuple, scaling.alike_words(words).collect())) == [([0], [1], 25), ([0, 1], [2, 3], 25)]
    sources, fits = scaling.wordfish(spark.createDataFrame(counts, "source string, word string, n bigint"), "a", "b")
    assert {r["source"]: r["n"] for r in sources.collect()} == {"a": 75, "b": 75} and fits.count() == 50
    assert fits.select(F.round("psi", 9), F.round("beta", 9)).distinct().count() == 2


def test_positions_of_little(spark):
    none = spark.createDataFrame([], "source string, word string, n bigint")
    assert [t.count() for t in scaling.wordfish(none, "a", "b")] == [0, 0]
    with pytest.raises(ValueError, match="direction"):
        scaling.wordfish(spark.createDataFrame([("a", "x", 1)], none.schema), "a", "b")


def test_wartime(spark):
    r = spark.createDataFrame([("e", 1, "x", "east"), ("e", 2, "y", "west"), ("e", 3, "x", "east"), ("e", 4, "z", None), ("e", 5, "v", "east"), ("f", 1, "y", "west"), ("e", 6, "u", None)], "event string, id int, outlet string, side string")
    edges = spark.createDataFrame([("e", 1, 2, "entails"), ("e", 2, 1, "entails"), ("e", 1, 3, "entails"), ("e", 3, 5, "entails"), ("e", 4, 5, "contradicts"), ("f", 1, 9, "entails"), ("e", 6, 5, "entails"), ("e", None, 4, "entails")], "event string, a int, b int, relation string")
    got = {(x["event"], x["id"]): (x["confirmed"], x["single_source"], x["opposed"], x["weight"]) for x in divergence.wartime(r, edges).collect()}
    assert got == {("e", 1): (1, False, True, 1.0), ("e", 2): (1, False, True, 1.0), ("e", 3): (1, False, False, 0.5), ("e", 4): (0, True, False, 0.0), ("e", 5): (2, False, False, 0.5), ("e", 6): (1, False, False, 0.5), ("f", 1): (0, True, False, 0.0)}


def test_dashboard_of_nothing_and_of_nulls(spark):
    kinds = "id string, title string, topics array<string>, source string, source_type string, author string, published_s bigint, trust double, affinity double, total double, minutes bigint, cluster_id string, snippet string"
    empty = analytics.dashboard(spark.createDataFrame([], kinds)).collect()
    assert {r["block"] for r in empty} == {"hero", "read_bin", "trust_bin"} and sum(r["n"] or 0 for r in empty) == 0
    one = spark.createDataFrame([("a", None, [], None, None, None, 0, None, None, 1.0, 0, "c", None)], kinds)
    rows = analytics.dashboard(one).collect()
    assert [(r["k1"], r["k2"], r["n"], r["x"]) for r in rows if r["block"] == "scatter"] == [("a", "tech", 1, 0.0)]
    assert not [r for r in rows if r["block"] == "top_author"]


def test_produced(spark):
    kinds = "id string, source string, topics array<string>, published_s bigint, minutes bigint"
    rows = [(f"i{k}", "a", ["x", "y"][: k % 3], 10 - k // 2, k) for k in range(8)] + [("n", None, ["x"], 1, 1), ("b1", "b", None, None, None)]
    got = {r["source"]: tuple(r)[1:] for r in analytics.produced(spark.createDataFrame(rows, kinds), 3).collect()}
    assert got == {"a": (8, 3.5, 10, "x,y", "i0,i1,i2"), "b": (1, None, None, "", "b1")}
    assert analytics.produced(spark.createDataFrame([], kinds)).count() == 0


def test_generated(spark):
    one, two = spark.createDataFrame([("u", 1), ("u", 1)], "name string, seen int"), spark.createDataFrame([(None,)], "name string")
    assert sorted(map(repr, map(tuple, ground.generated({"p": one, "q": two}).select("name", "origin", "seen").collect()))) == sorted(map(repr, [("u", "p", 1), ("u", "p", 1), (None, "q", None)]))
