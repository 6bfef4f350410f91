"""Transcripts, timelines and shards against loops and failures."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import timeline
from feedloom.sources import files


def loop_paragraphs(cues, most):
    out, speaker, held = [], cues[0][0] if cues else None, ""

    def close():
        nonlocal held
        if held.strip():
            out.append((speaker, held.strip()))
        held = ""

    for who, t in cues:
        if who is not None and who != speaker:
            close()
            speaker = who
        held = f"{held} {t or ''}" if held else t or ""
        if len(held) >= most:
            close()
            speaker = who
    close()
    return out


def test_paragraphs(spark):
    rng = random.Random(5)
    talks = [[(rng.choice([None, None, "a", "b"]), rng.choice(["", "x", "some words", "a longer cue " * 3, None, "é" * 11, " "])) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[("a", "word " * 300)] * 50, [], [(None, None)]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(talks)], "k int, cues array<struct<speaker: string, text: string>>")
    for r in df.select("k", text.paragraphs(F.col("cues"), 60).alias("p")).collect():
        assert [tuple(p) for p in r["p"]] == loop_paragraphs(talks[r["k"]], 60), talks[r["k"]]


def loop_rows(labels, gutter):
    ends, out = [], {}
    for ord_, start, stop in sorted(labels, key=lambda x: (x[1], x[0])):
        row = next((k for k, e in enumerate(ends) if e <= start), len(ends))
        ends[row:row + 1] = [stop + gutter]
        out[ord_] = row
    return out


@pytest.mark.parametrize(("n", "span", "gutter"), [(400, 3000, 0), (400, 300, 5), (300, 40, 0), (200, 100_000, 1)])
def test_label_rows(spark, n, span, gutter):
    """Sparse and crowded timelines, many parts, ties, empty labels; two timelines and one without a name."""
    rng = random.Random(n + span)
    rows = [(rng.choice(["x", "x", "y", None]), k, float(s := rng.randrange(span)), float(s + rng.choice([0, 1, 7, 30])), "own") for k in range(n)] + [("x", n, None, 3.0, "own"), ("x", n + 1, 3.0, None, "own")]
    df = spark.createDataFrame(rows, "timeline string, ord bigint, start double, stop double, row string").drop("row").repartition(5)
    got = {(r["timeline"], r["ord"]): r["row"] for r in timeline.packed_rows(df, gutter).collect()}
    want = {}
    for t in ("x", "y", None):
        want |= {(t, k): row for k, row in loop_rows([r[1:4] for r in rows if r[0] == t and None not in r[2:4]], gutter).items()}
    assert got == want
    assert timeline.packed_rows(df.limit(0)).collect() == []


def test_shards(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, country string, year int, x string")
    keys = ["country", "year"]
    held = lambda df: {(r["country"], r["year"], r["id"]): r["x"] for r in df.collect()}
    names = lambda: {p.name for p in pathlib.Path(path, "data").rglob("*.parquet")}
    assert held(files.write_shards(rows((1, "A", 2024, "a"), (2, "A", 2025, "b"), (1, "B", 2024, "c"), (1, "B", 2024, "c")), path, keys)) == {("A", 2024, 1): "a", ("A", 2025, 2): "b", ("B", 2024, 1): "c"}
    first = names()
    got = held(files.write_shards(rows((2, "A", 2025, "B"), (3, "A", 2025, "d"), (1, "C", 2024, None)), path, keys))
    want = {("A", 2024, 1): "a", ("A", 2025, 2): "B", ("A", 2025, 3): "d", ("B", 2024, 1): "c", ("C", 2024, 1): None}
    assert got == want and first <= names()
    assert {r["version"] for r in spark.read.parquet(f"{path}/data").where("country = 'B'").select("version").collect()} == {1}  # not written again
    # a writer that fails in the middle of its data, and one that fails before its manifest is whole
    bad = rows((9, "A", 2024, "bad"), (9, "B", 2024, "bad")).withColumn("x", F.when(F.col("country") == "B", F.raise_error("lost")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        files.write_shards(bad, path, keys)
    rows((9, "A", 2024, "bad")).write.partitionBy(*keys).parquet(f"{path}/data/version=7")
    pathlib.Path(path, "manifest", "7").mkdir()
    assert held(files.read_shards(spark, path, keys)) == want
    got = held(files.write_shards(rows((1, "A", 2024, "new")), path, keys, retained=F.col("country") != "B"))
    assert got == {k: v for k, v in want.items() if k[0] != "B"} | {("A", 2024, 1): "new"}
