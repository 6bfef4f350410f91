"""Labels on a timeline put into rows so that none overlap."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.graph import Workspace, small

#: Parts of timelines (a row each) that may be broadcast.
PARTS = 100_000


def islands(labels: DataFrame, gutter: float = 0.0) -> DataFrame:
    """Labels (timeline, ord, start, stop) with island: a number that grows where no earlier label of the timeline reaches.

    Rows are sorted by ranges; each range hands the furthest end and the number of islands so far on to the next, a row
    a timeline and range, so a timeline of all labels is no single task. Labels without a start or stop are left out.
    """
    space = Workspace(labels.sparkSession)
    rows = labels.where("start is not null and stop is not null").withColumn("reach", F.col("stop") + gutter)
    order = ["timeline", "start", "ord"]
    dealt = space.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("timeline").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = small(space.write(dealt.groupBy("timeline", "__part").agg(F.max("reach").alias("most")).withColumn("__far", F.max("most").over(before)).drop("most"), "reaches"), PARTS)
    same = lambda a, b: a["timeline"].eqNullSafe(b["timeline"]) & (a["__part"] == b["__part"])
    joined = dealt.join(handed, same(dealt, handed)).select(*(dealt[c] for c in dealt.columns), "__far")
    own = Window.partitionBy("timeline", "__part").orderBy("start", "ord")
    far = F.greatest(F.max("reach").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    opens = F.coalesce((far <= F.col("start")).cast("long"), F.lit(1))
    numbered = space.write(joined.withColumn("__opens", opens).withColumn("__local", F.sum("__opens").over(own)), "numbered")
    counts = small(space.write(numbered.groupBy("timeline", "__part").agg(F.sum("__opens").alias("n")).withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "counts"), PARTS)
    return numbered.join(counts, same(numbered, counts)).select(*(numbered[c] for c in labels.columns), (F.col("__base") + F.col("__local")).alias("island"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest free row for each label, island by island; only the rows in use are held."""
    key, busy, free, opened = None, [], [], 0
    for batch in batches:
        out = []
        *parts, starts, reaches = (batch.column(k).to_pylist() for k in range(batch.num_columns - 4, batch.num_columns))
        for timeline, island, start, reach in zip(*parts, starts, reaches, strict=True):
            if (timeline, island) != key:
                key, busy, free, opened = (timeline, island), [], [], 0
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                row = heapq.heappop(free)
            else:
                row, opened = opened, opened + 1
            heapq.heappush(busy, (reach, row))
            out.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(out, pa.int32())], [*batch.schema.names[:-4], "row"])


def packed_rows(labels: DataFrame, gutter: float = 0.0) -> DataFrame:
    """Labels (timeline, ord, start, stop) with row: the lowest one whose last label ends, gutter included, at or before the start.

    Labels take their rows in the order of start, then ord. Where no earlier label reaches, all rows are free and the
    order starts anew: such islands are independent, and each streams through one task that holds its open rows.
    """
    found = islands(labels, gutter)
    keyed = found.select(*labels.columns, F.col("timeline").cast("string").alias("__timeline"), F.col("island").alias("__island"), F.col("start").cast("double").alias("__start"), (F.col("stop") + gutter).cast("double").alias("__reach"))
    dealt = keyed.repartition("__timeline", "__island").sortWithinPartitions("__timeline", "__island", "__start", "ord")
    return dealt.mapInArrow(_rows, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in labels.schema.fields), "row int"]))
