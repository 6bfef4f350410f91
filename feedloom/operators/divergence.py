"""How far the reportings of one event lie apart, how many agree with its core, and which sides cover it.

All pairs of an event's unit vectors are summed up through the vectors' sum, |sum u|^2 - n, so no pair is ever made:
everything here is linear in the reportings, and sums are combined before they are shuffled, however large an event is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.graph import Workspace, small

#: Events (a vector each) that may be broadcast to their reportings; more are joined by a shuffle.
EVENTS = 10_000
#: Weights of a resampled row by its 32-bit draw: as many as there are bounds at or below it (the Poisson law of mean 1).
DRAWS = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def unit(vector: Column) -> Column:
    """The vector at length 1; null for vectors without length or with missing or infinite parts."""
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(x, lambda v: v / norm))


def weights(key: Column, replicates: int) -> Column:
    """Resampling weights of a row, one a replicate, from its key alone, so every run draws the same."""
    bounds = F.array(*(F.lit(b) for b in DRAWS))

    def weight(b: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), b.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
        return F.size(F.filter(bounds, lambda t: t <= draw))

    return F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), weight)


def divergence(reportings: DataFrame, replicates: int = 32, agree: float = 0.5) -> DataFrame:
    """One row an event, from reportings (event, id, outlet, lean, vector).

    n; divergence: 0 (all alike) to 100 (opposed), 50 * (1 - mean cosine over all pairs), null for a single reporting;
    low, high: the middle 95 percent of `replicates` resamplings with Poisson weights; corroboration: the percentage of
    reportings whose cosine with the event's mean direction is at least `agree`; outlets, confirming: outlets in all and
    those with such a reporting; both_sides: are there confirming ones with negative and with positive lean; quoted: the
    id next to the mean direction. Reportings without an event or with an unusable vector are left out; repeated rows
    count each.
    """
    space = Workspace(reportings.sparkSession)
    rows = reportings.where("event is not null").select("event", "id", "outlet", "lean", unit(F.col("vector")).alias("u")).where("u is not null").withColumn("w", weights(F.col("id"), replicates))
    rows = space.write(rows, "reportings")
    parts = rows.select("event", "w", F.posexplode("u").alias("dim", "x"))
    resampled = [F.sum(F.col("w")[b] * F.col("x")).alias(f"s{b}") for b in range(replicates)]
    sums = space.write(parts.groupBy("event", "dim").agg(F.sum("x").alias("s"), *resampled), "sums")
    lengths = sums.groupBy("event").agg(F.sum(F.col("s") * F.col("s")).alias("length"), F.array(*(F.sum(F.col(f"s{b}") * F.col(f"s{b}")) for b in range(replicates))).alias("lengths"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda d: d["s"]).alias("core"))
    mass = rows.groupBy("event").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("w")[b]) for b in range(replicates))).alias("mass"), F.array(*(F.sum(F.col("w")[b] * F.col("w")[b]) for b in range(replicates))).alias("squares"))
    spread = lambda total, n, own: F.when(n * n - own > 0, 50 * (1 - (total - own) / (n * n - own)))
    each = F.array_sort(F.filter(F.transform(F.arrays_zip("lengths", "mass", "squares"), lambda z: spread(z["lengths"], z["mass"], z["squares"])), lambda x: x.isNotNull()))
    at = lambda share: F.get("each", F.greatest(F.lit(0), F.ceil(share * F.size("each")) - 1).cast("int"))
    index = lengths.join(mass, "event").withColumns({"divergence": spread(F.col("length"), F.col("n"), F.col("n")), "each": each})
    index = index.select("event", "n", "divergence", F.when(F.col("n") > 1, at(0.025)).alias("low"), F.when(F.col("n") > 1, at(0.975)).alias("high"), "core", "length")
    index = space.write(index, "index")
    near = F.try_divide(F.aggregate(F.zip_with("u", "core", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), F.sqrt("length"))
    judged = rows.join(small(index.select("event", "core", "length"), EVENTS), "event").select("event", "id", "outlet", "lean", F.coalesce(near, F.lit(0.0)).alias("near"))
    judged = judged.withColumn("agrees", F.col("near") >= agree)
    # outlets first one by one, so that no group gathers them
    by_outlet = judged.groupBy("event", "outlet").agg(F.count("*").alias("k"), F.count_if("agrees").alias("a"), F.max(F.col("agrees") & (F.col("lean") < 0)).alias("left"), F.max(F.col("agrees") & (F.col("lean") > 0)).alias("right"), F.min(F.struct((-F.col("near")).alias("far"), "id")).alias("best"))
    found = by_outlet.groupBy("event").agg((100 * F.sum("a") / F.sum("k")).alias("corroboration"), F.count("outlet").alias("outlets"), F.count_if((F.col("a") > 0) & F.col("outlet").isNotNull()).alias("confirming"), (F.coalesce(F.max("left"), F.lit(False)) & F.coalesce(F.max("right"), F.lit(False))).alias("both_sides"), F.min("best")["id"].alias("quoted"))
    return index.drop("core", "length").join(found, "event")


def widened(scores: DataFrame, floor: int, factor: float = 2.0) -> DataFrame:
    """Scores (n, divergence, low, high) with provisional: below `floor` rows the shown range is `factor` times as wide, within 0 to 100."""
    few = F.col("n") < floor
    low = F.greatest(F.lit(0.0), F.col("divergence") - factor * (F.col("divergence") - F.col("low")))
    high = F.least(F.lit(100.0), F.col("divergence") + factor * (F.col("high") - F.col("divergence")))
    return scores.withColumns({"provisional": few, "low": F.when(few, low).otherwise(F.col("low")), "high": F.when(few, high).otherwise(F.col("high"))})


def blindspots(reportings: DataFrame, thin: float = 0.1, dense: int = 3) -> DataFrame:
    """(event, left, center, right, blind): outlets by the sign of their lean; blind: the side with at most `thin` of the other's, which has `dense` at least.

    An outlet counts once an event; rows without a lean are of no side.
    """
    once = reportings.where("event is not null and outlet is not null").groupBy("event", "outlet").agg(F.max("lean").alias("lean"))
    n = once.groupBy("event").agg(F.count_if(F.col("lean") < 0).alias("left"), F.count_if(F.col("lean") == 0).alias("center"), F.count_if(F.col("lean") > 0).alias("right"))
    lacks = lambda a, b: (F.col(b) >= dense) & (F.col(a) <= thin * F.col(b))
    return n.withColumn("blind", F.when(lacks("left", "right"), "left").when(lacks("right", "left"), "right"))


def wartime(reportings: DataFrame, edges: DataFrame) -> DataFrame:
    """Reportings (event, id, outlet, side) of a conflict, with what others confirm, from edges (event, a, b, relation).

    confirmed: outlets other than its own whose reporting it entails or is entailed by; single_source: there is none;
    opposed: do its outlet and theirs span more than one side (null is on none); weight: 1 if so, 0.5 if it is confirmed
    within one side only, 0 if by nobody. Edges to unknown reportings, between
    reportings of one outlet, and of other relations confirm nothing; repeated edges count once.
    """
    who = reportings.select("event", "id", "outlet", "side")
    both = edges.where("relation = 'entails'").select("event", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("by")), F.struct(F.col("b").alias("id"), F.col("a").alias("by")))).alias("e")).select("event", "e.*").distinct()
    by = both.join(who.select("event", F.col("id").alias("by"), F.col("outlet").alias("by_outlet"), F.col("side").alias("by_side")), ["event", "by"])
    # the sides of those that confirm a reporting, itself included
    seen = who.join(by, ["event", "id"]).where("by_outlet <> outlet").groupBy("event", "id").agg(
        F.count_distinct("by_outlet").alias("confirmed"), F.coalesce((F.least(F.min("side"), F.min("by_side")) != F.greatest(F.max("side"), F.max("by_side"))), F.lit(False)).alias("opposed"))
    rows = who.join(seen, ["event", "id"], "left")
    n, opposed = F.coalesce("confirmed", F.lit(0)), F.coalesce("opposed", F.lit(False))
    return rows.withColumns({"confirmed": n, "opposed": opposed, "single_source": n == 0, "weight": F.when(opposed, 1.0).when(n > 0, 0.5).otherwise(0.0)})
