import collections
import shutil

import corpus_pipeline
import pandas as pd
from feedloom.llm.packing import binary_pieces
from tests.llm.conftest import edge_rows
from tests.llm.test_dedup import brute_components


def write(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_edge_rows(spark, tmp_path):
    """Without toxic labels nothing is toxic; copies, near copies and a leak go; the rest is packed."""
    rows = [(i, t) for i, t in edge_rows() if i is not None]
    leak = rows[-12][1]
    write(spark, tmp_path, rows, [(i, 1, 0) for i, _ in rows], [(1, leak), (2, None)])
    keep = {}
    for i, t in rows:
        keep[t or ""] = max(i, keep.get(t or "", i))
    once = sorted({(i, t) for t, i in keep.items()})
    near = {(i, t) for (i, t), (_, _, c) in zip(once, brute_components(once, 5, 80, 100), strict=True) if c == i}
    gone = {i for i, t in near if leak.lower() in t.lower()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert gone and {r["doc_id"] for r in got} == {i for i, _ in near} - gone
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for pieces in by.values():
        assert sorted((r["length"] for r in pieces), reverse=True) == binary_pieces(pieces[0]["doc_tokens"])


def test_pipeline_on_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, t) for i, t in edge_rows() if i is not None and i < 40]
    write(spark, tmp_path, rows, [(i, 1, int(i % 7 == 0)) for i, _ in rows], [(1, "some item of a benchmark that nobody has")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.schema.fieldNames() == docs.schema.fieldNames(), name
        before = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in after.collect()} <= before
        docs = after
    assert isinstance(docs.toPandas(), pd.DataFrame)
    shutil.rmtree(tmp_path)


def test_stages_with_clashing_columns_and_null_ids(spark, tmp_path, edges, empty):
    """Extra columns named like the operators' own, repeated ids with other texts, null ids, repeated rows, no rows."""
    rows = edge_rows()
    labels = [(i, 1, 0) for i, _ in rows if i is not None]
    write(spark, tmp_path, [], labels, [(1, rows[-12][1]), (2, None)])
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact dedup"](spark, edges, str(tmp_path))
    assert exact.columns == edges.columns
    best = {}
    for i, t in rows:
        best[t or ""] = max((x for x in (i, best.get(t or "")) if x is not None), default=None)
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in exact.collect()) == collections.Counter((i, t) for t, i in best.items())
    near = stages["n-gram Jaccard join"](spark, edges, str(tmp_path))
    assert near.columns == edges.columns
    got = collections.Counter((r["doc_id"], r["text"] or "") for r in near.collect())
    groups = collections.defaultdict(list)
    for k, ((i, t), (_, n, c)) in enumerate(zip(rows, brute_components(rows, 5, 80, 100), strict=True)):
        groups[(c, t if c is None else None) if n else ("alone", k)].append((i, t or ""))
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        least = min((i for i, _ in members if i is not None), default=None)
        assert sum(got[m] > 0 and m[0] == least for m in set(members)) == 1
    leaks = stages["benchmark decontamination"](spark, edges, str(tmp_path))
    assert leaks.columns == edges.columns
    gone = {(i, t) for i, t in rows if t and rows[-12][1].lower() in t.lower()}
    assert gone and collections.Counter((r["doc_id"], r["text"]) for r in leaks.collect()) == collections.Counter(x for x in rows if x not in gone)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
