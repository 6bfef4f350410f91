"""Similarity join on word n-grams by prefix filtering under several global token orders.

1. Document frequencies: tasks send their shingle hashes, cut into hash ranges, to the range's owner and get back a
   class (the logarithm of the frequency) per shingle; no frequency table is ever held or sent whole.
2. A document whose shared shingles (frequency over one) are too few to reach the threshold has no link and leaves.
3. The others are ordered three times, by class and then by three unlike hashes: rare shingles come first in each
   order, so common passages rarely enter a prefix. Documents that share a token of the first order's prefix are
   candidates, subject to the length and position filters, if their prefixes in the other two orders meet too.
4. Candidates are verified on their whole sets.

Pairs are not listed for whole buckets: each bucket first links its rows to the one with the least position (the
least edited one). Then only pairs from different components are checked, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, chunks, components, mix, shards, shingles, string_buffers, text_of, word_hashes

_OWNED = "chunk bigint, shard int, rows binary, body binary"
_CLASSED = "fp binary, n int, n_shared int, classes binary"
#: Bytes of text whose shingles a task sends at a time: so many a piece, within bounds.
_LEAST_CHUNK, _MOST_CHUNK, _EACH = 1 << 20, 64 << 20, 8 << 10


def _shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def _send(k: int, n_shards: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "body", min(_MOST_CHUNK, max(_LEAST_CHUNK, n_shards * _EACH))):
            hashes, at = shingles(*word_hashes(*string_buffers(batch.column(1))), k)
            n = np.diff(at)
            shard, row = _shard_of(hashes, n_shards), np.repeat(np.arange(len(n)), n)
            each = np.bincount(shard * len(n) + row, minlength=n_shards * len(n)).astype("<u4").reshape(n_shards, len(n))
            order = np.argsort(shard, kind="stable")
            low = hashes[order].astype("<u4")  # the low 32 bits: a class only has to be the same function everywhere
            cuts = np.concatenate([[0], np.cumsum(each.sum(1, dtype=np.int64))])
            chunk = task << 32 | number
            number += 1
            own = [s for s in range(n_shards) if cuts[s + 1] > cuts[s]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * (len(own) + 1)), pa.array([-1, *own], pa.int32()), pa.array([n.astype("<u4").tobytes(), *(each[s].tobytes() for s in own)]), pa.array([b"".join(batch.column(0).to_pylist()), *(low[cuts[s] : cuts[s + 1]].tobytes() for s in own)])],
                ["chunk", "shard", "rows", "body"],
            )

    return send


def _classify(table: pa.Table) -> pa.Table:
    """For the owner of a hash range: each shingle's class, 0 for frequency 1, 1 for 2, 2 for 3 and 4, and so on."""
    if table["shard"][0].as_py() < 0:
        return table
    data, at = string_buffers(table["body"])
    values = np.frombuffer(data.tobytes(), "<u4")
    ordered = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(ordered)))
    kind = np.ceil(np.log2(count)).astype(np.uint8)
    found = kind[np.searchsorted(ordered[first], values)]
    body = pa.Array.from_buffers(pa.binary(), table.num_rows, [None, pa.py_buffer((at // 4).astype(np.int32)), pa.py_buffer(found)])
    return table.set_column(3, "body", body)


def _per_row(table: pa.Table) -> pa.Table:
    """Puts a chunk's classes together again: for each of its rows one byte per shingle in ascending order of hashes."""
    parts = sorted(zip(table["shard"].to_pylist(), table["rows"].to_pylist(), table["body"].to_pylist(), strict=True))
    n = np.frombuffer(parts[0][1], "<u4").astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    out, filled = np.zeros(at[-1], np.uint8), at[:-1].copy()
    for _, rows, body in parts[1:]:
        each = np.frombuffer(rows, "<u4").astype(np.int64)
        before = np.cumsum(each) - each
        out[np.repeat(filled - before, each) + np.arange(each.sum())] = np.frombuffer(body, np.uint8)
        filled += each
    shared = np.concatenate([[0], np.cumsum(out > 0)])
    prints = [parts[0][2][i : i + 16] for i in range(0, 16 * len(n), 16)]
    return pa.table({"fp": prints, "n": pa.array(n, pa.int32()), "n_shared": pa.array(shared[at[1:]] - shared[at[:-1]], pa.int32()), "classes": [out[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})


def _prefixes(k: int, num: int, den: int) -> Callable:
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            hashes, at = shingles(*word_hashes(*string_buffers(batch.column(1))), k)
            kinds, _ = string_buffers(batch.column(2))
            second, third = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix(hashes ^ np.uint64(0x14057B7EF767814F))
            out: list[list] = [[], [], [], [], [], []]
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                h, kind, n = hashes[low:high], kinds[low:high], high - low
                length = n - -(-num * n // den) + 1
                alone = int(np.count_nonzero(kind == 0))
                order = np.lexsort((h, kind))[alone:length]
                out[0].append(n)
                out[1].append(h[order].view(np.int64))
                out[2].append(np.arange(alone, length, dtype=np.int32))
                for j, other in ((3, second), (4, third)):
                    o = other[low:high]
                    out[j].append(o[np.lexsort((o, kind))[alone:length]].astype(np.uint32).view(np.int32))
                out[5].append(h[kind > 0].view(np.int64))
            kind64, kind32 = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int32()), pa.array(out[1], kind64), pa.array(out[2], kind32), pa.array(out[3], kind32), pa.array(out[4], kind32), pa.array(out[5], kind64)], ["id", "n", "tokens", "places", "second", "third", "shared"])

    return prefix


def _near(num: int, den: int) -> Column:
    """Length and position filter on rows a and b that share a token: with it as their first, can they overlap enough?"""
    least = F.ceil((num * (F.col("a.n") + F.col("b.n"))) / F.lit(num + den))
    return (den * F.least("a.n", "b.n") >= num * F.greatest("a.n", "b.n")) & (F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= least)


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, text_md5, kept.

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`. The set of a text has its distinct k-word shingles; with
    fewer words, all of them as one; without words, nothing, and it is linked with nothing. Texts link when
    den * intersection >= num * union; component_id is the smallest id reachable by links, itself included. Rows with
    equal texts are linked (if there are words), so rows that repeat an id share its component; rows with null ids
    take part without lending a name, and have a null component if no row with an id is in it. kept: of a component's
    texts the one with the smallest id, then the smallest hash, on its rows with that id; texts without words are all
    kept. Shingles are compared by 64-bit hashes, texts by MD5.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), text_of(text_column).alias("body")).withColumn("fp", F.unhex(F.md5("body")))
    owned = rows.select("fp", "body").mapInArrow(_send(k, shards(rows)), _OWNED)
    classed = owned.groupBy("shard").applyInArrow(_classify, _OWNED)
    classed = space.write(classed.groupBy("chunk").applyInArrow(_per_row, _CLASSED), "classes")
    # one node for each text: the place of its smallest id, or of any row if it has none
    texts = space.write(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.coalesce("id", F.xxhash64("fp"))).alias("node")), "texts")
    reach = F.col("n_shared") * den >= F.col("n") * num
    suspects = classed.where(reach & (F.col("n") > 0)).groupBy("fp").agg(F.first("classes").alias("classes"))
    suspects = suspects.join(texts, "fp")
    picked = rows.join(suspects, (rows["fp"] == suspects["fp"]) & rows["id"].eqNullSafe(suspects["least"]))
    picked = picked.select(F.col("node").alias("id"), "body", "classes")
    sets = space.write(picked.mapInArrow(_prefixes(k, num, den), "id bigint, n int, tokens array<bigint>, places array<int>, second array<int>, third array<int>, shared array<bigint>").dropDuplicates(["id"]), "sets")
    posted = sets.select("id", "n", F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("place"))).alias("e")).select("id", "n", "e.token", "e.place")

    def verified(pairs: DataFrame) -> DataFrame:
        # the other orders' filters first, then the whole sets of what is left
        side = [sets.select(F.col("id").alias(x), F.col("second").alias(f"s{x}"), F.col("third").alias(f"t{x}")) for x in "ab"]
        met = pairs.join(side[0], "a").join(side[1], "b").where(F.arrays_overlap("sa", "sb") & F.arrays_overlap("ta", "tb")).select("a", "b")
        side = [sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"h{x}")) for x in "ab"]
        both = met.join(side[0], "a").join(side[1], "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return both.where(common * (den + num) >= num * (F.col("na") + F.col("nb"))).select("a", "b")

    first = space.write(posted.groupBy("token").agg(F.min(F.struct("place", "id", "n")).alias("p"), F.count("*").alias("rows")).where("rows > 1").select("token", "p.*"), "first")
    stars = posted.alias("a").join(first.alias("b"), "token").where(_near(num, den) & (F.col("a.id") != F.col("b.id")))
    stars = stars.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    links = space.write(verified(stars), "links")
    named = space.write(components(spark, space, links, "stars"), "named")
    labelled = posted.join(named.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = space.write(labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token"), "mixed")
    open_rows = space.write(labelled.join(mixed, "token", "left_semi"), "open")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    pairs = a.join(b, F.col("a.token").eqNullSafe(F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & _near(num, den))
    more = space.write(verified(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()), "more")
    named = space.write(components(spark, space, links.union(more), "all"), "components")
    # nodes without an id of their own lend no name
    nodes = texts.join(named, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("group"))
    # written first: a join against a table can split a large group, one against an aggregation cannot
    first_text = F.min_by("fp", F.struct(F.col("least").isNull(), "least", "fp"))
    names = space.write(nodes.groupBy("group").agg(F.min("least").alias("component_id"), first_text.alias("kept_fp")), "names")
    counts = classed.groupBy("fp").agg(F.first("n").alias("n_shingles"))
    final = space.write(nodes.join(names, "group").join(counts, "fp").select("fp", "n_shingles", "component_id", (F.col("fp") == F.col("kept_fp")).alias("first")), "final")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = (F.col("n_shingles") == 0) | (F.col("first") & F.col("id").eqNullSafe(F.col("component_id")))
    return rows.select("id", "fp").join(final, "fp").select(F.col("id").alias(id_column), F.col("n_shingles").cast("bigint").alias("n_shingles"), own.alias("component_id"), F.lower(F.hex("fp")).alias("text_md5"), kept.alias("kept"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first three columns of jaccard_groups: id, n_shingles, component_id."""
    return jaccard_groups(docs, k, num, den, id_column, text_column).select(id_column, "n_shingles", "component_id")
