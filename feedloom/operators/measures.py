"""Comparable scores: percentiles among peers and rescaled bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.feed import ranked
from feedloom.operators.graph import Workspace, small

#: Groups whose few numbers may be broadcast; more are joined by a shuffle.
GROUPS = 200_000


def percentiles(rows: DataFrame, keys: list[str], value: str, key: str) -> DataFrame:
    """Adds n (peers with a value) and percentile: 100 * (those below + half of those equal, itself included) / n.

    Peers are the rows with the same keys; rows without a value have no percentile and are nobody's peers. key tells
    rows apart. All rows are placed once by ranges of (keys, value, key), so a group of all rows is no single task; what
    is below a value is a difference of places.
    """
    space = Workspace(rows.sparkSession)
    peers = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    placed = space.write(ranked(peers.select(key, *keys, value), [*map(F.col, keys), F.col(value), F.col(key)]), "placed")
    equal = space.write(placed.groupBy(*keys, value).agg(F.min("place").alias("first"), F.count("*").alias("equal")), "equal")
    groups = space.write(placed.groupBy(*keys).agg(F.min("place").alias("start"), F.count("*").alias("n")), "groups")
    same = lambda a, b, names: [a[k].eqNullSafe(b[k]) for k in names]
    scores = equal.join(small(groups, GROUPS), same(equal, groups, keys)).select(*(equal[k] for k in keys), value, "n", (100 * (F.col("first") - F.col("start") + F.col("equal") / 2) / F.col("n")).alias("percentile"))
    scores = space.write(scores, "scores")
    return rows.join(scores, same(rows, scores, [*keys, value]), "left").select(*(rows[c] for c in rows.columns), "n", "percentile")


def rescaled(value: Column, low: float, high: float) -> Column:
    """A value on a published scale as 0 to 100; beyond the bounds it is at the bound."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (value - low) / (high - low)))
