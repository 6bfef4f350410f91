"""Exact deduplication with counting quotient filters.

Each task folds the 64-bit fingerprints of its rows into a counting quotient filter. Filters are cut into quotient
ranges, dealt by range, and merged without loss by merging their sorted remainders. Only rows whose fingerprint is
counted more than once go on to byte verification, which groups them by the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, merge_sorted, small, text_of

#: Bits of a fingerprint that name its home slot; the other bits are the remainder.
QUOTIENT_BITS = 20
#: Repeated fingerprints (24 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows whose fingerprints one range of quotients may hold (16 bytes each).
RANGE_ROWS = 4_000_000
_FILTER = "shard int, low bigint, occupied binary, run_ends binary, remainders binary, counts binary"


class CountingQuotientFilter:
    """Counts of 64-bit fingerprints over a range of quotients that begins at `low`.

    occupied has a bit for each quotient of the range, run_ends a bit for each slot (set where a quotient's run ends).
    Slots hold remainders in ascending order within a run, with a counter each.
    """

    def __init__(self, low: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.low, self.occupied, self.run_ends, self.remainders, self.counts = low, occupied, run_ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, low: int = 0, bits: int = QUOTIENT_BITS) -> CountingQuotientFilter:
        """fingerprints: sorted and distinct."""
        shift = np.uint64(64 - bits)
        quotients = (fingerprints >> shift).astype(np.int64)
        last = np.ones(len(quotients), bool)
        last[:-1] = quotients[1:] != quotients[:-1]
        occupied = np.zeros(int(quotients[-1]) - low + 1 if len(quotients) else 0, bool)
        occupied[quotients[last] - low] = True
        return cls(low, occupied, last, fingerprints & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    def fingerprints(self, bits: int = QUOTIENT_BITS) -> np.ndarray:
        run = np.zeros(len(self.run_ends), np.int64)
        run[1:] = np.cumsum(self.run_ends)[:-1]
        home = (np.flatnonzero(self.occupied) + self.low).astype(np.uint64)
        return (home[run] << np.uint64(64 - bits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], low: int = 0, bits: int = QUOTIENT_BITS) -> CountingQuotientFilter:
        """Runs come in the order of quotients and remainders ascend within them, so the filters are merged as they stand."""
        return cls.build(*merge_sorted([(f.fingerprints(bits), f.counts) for f in filters]), low, bits)


def _filters(n_shards: int, bits: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # sorted parts, each over twice as large as the next

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = merge_sorted(held)
            shard = ((keys >> np.uint64(64 - bits)) * np.uint64(n_shards) >> np.uint64(bits)).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange(n_shards + 1))
            for s in np.unique(shard).tolist():
                part = slice(cuts[s], cuts[s + 1])
                low = -(-(s << bits) // n_shards)
                f = CountingQuotientFilter.build(keys[part], counts[part], low, bits)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "low": [low], "occupied": [np.packbits(f.occupied).tobytes()], "run_ends": [np.packbits(f.run_ends).tobytes()], "remainders": [f.remainders.tobytes()], "counts": [f.counts.tobytes()]})

        for batch in batches:
            held.append(np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True))
            while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
                held[-2:] = [merge_sorted(held[-2:])]
            if sum(len(k) for k, _ in held) > 4_000_000:  # 64 MB: a task's memory stays bounded
                yield from out()
                held.clear()
        yield from out()

    return build


def _merge(bits: int) -> Callable:
    def merged(table: pa.Table) -> pa.Table:
        parts = []
        for r in table.to_pylist():
            remainders = np.frombuffer(r["remainders"], np.uint64)
            parts.append(CountingQuotientFilter(r["low"], np.unpackbits(np.frombuffer(r["occupied"], np.uint8)).astype(bool), np.unpackbits(np.frombuffer(r["run_ends"], np.uint8))[: len(remainders)].astype(bool), remainders, np.frombuffer(r["counts"], np.int64)))
        f = CountingQuotientFilter.merge(parts, parts[0].low, bits)
        keep = f.counts > 1
        return pa.table({"fp": f.fingerprints(bits)[keep].view(np.int64), "n": f.counts[keep]})

    return merged


def repeated_fingerprints(fingerprints: DataFrame, bits: int = QUOTIENT_BITS) -> DataFrame:
    """fingerprints: one bigint column. Returns (fp, n) of those that occur more than once."""
    n = min(max(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fingerprints.count() // RANGE_ROWS)), 1 << bits)
    return fingerprints.mapInArrow(_filters(n, bits), _FILTER).groupBy("shard").applyInArrow(_merge(bits), "fp bigint, n bigint")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of rows with equal normalised texts that with the largest id stays. Null texts count as empty. Rows that repeat an
    id and its text are all kept rows of that id; a null id yields to any other id. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), normalise(text_of(text_column)).alias("body")).withColumn("fp", F.xxhash64("body"))
    repeated = space.write(repeated_fingerprints(rows.select("fp")), "repeated").select("fp")
    suspects = rows.join(small(repeated, BROADCAST_ROWS), "fp")
    # byte verification: the grouping key is the text itself
    groups = suspects.groupBy("fp", "body").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select(F.sha2("body", 256).alias("sha"), "keep", "n")
    groups = space.write(groups, "groups")
    out = rows.select("id", F.sha2("body", 256).alias("sha")).join(small(groups, BROADCAST_ROWS), "sha", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_column), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
