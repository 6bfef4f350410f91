"""Events in conflict theaters, uncertainty readouts, provenance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.graph import Workspace

# a small fixed dimension: id, north, south, east, west, start and end (seconds), status
THEATERS = [("alpha", 50.0, 40.0, 30.0, 20.0, 1_704_067_200, None, "active"), ("beta", 45.0, 10.0, 60.0, 25.0, 1_704_500_000, 1_706_000_000, "active"), ("gamma", 0.0, -40.0, 20.0, -60.0, 1_704_067_200, None, "dormant"), ("delta", 80.0, 41.0, 80.0, -20.0, 1_704_067_200, 1_705_000_000, "archived"), ("epsilon", 90.0, -90.0, 180.0, -180.0, 1_704_067_200, None, "proposed")]


def theaters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THEATERS, "theater string, north double, south double, east double, west double, start_s bigint, end_s bigint, status string")


#: Areas that may be held in one array beside each event; more are met by a join.
HELD_AREAS = 1000


def membership(events: DataFrame, areas: DataFrame) -> DataFrame:
    """Events with the smallest theater whose box (edges included) and time (end excluded) hold them, or null.

    Proposed theaters hold nothing; archived ones need an end. Equal events stay as many as they are.
    """
    live = areas.where((F.col("status") != "proposed") & ((F.col("status") != "archived") | F.col("end_s").isNotNull()))
    e = {c: F.col(c) for c in ("lat", "lng", "at_s")}

    def holds(a: Column | DataFrame) -> Column:
        return e["lat"].between(a["south"], a["north"]) & e["lng"].between(a["west"], a["east"]) & (e["at_s"] >= a["start_s"]) & (a["end_s"].isNull() | (e["at_s"] < a["end_s"]))

    if live.limit(HELD_AREAS + 1).count() <= HELD_AREAS:
        held = F.broadcast(live.agg(F.collect_list(F.struct("theater", "north", "south", "east", "west", "start_s", "end_s")).alias("__areas")))
        return events.crossJoin(held).withColumn("theater", F.array_min(F.transform(F.filter("__areas", holds), lambda a: a["theater"]))).drop("__areas")
    numbered = Workspace(events.sparkSession).write(events.withColumn("__row", F.monotonically_increasing_id()), "events")
    found = numbered.join(live, holds(live)).groupBy("__row").agg(F.min("theater").alias("theater"))
    return numbered.join(found, "__row", "left").drop("__row")


def great_circle_km(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat, lng, lat2, lng2))
    h = F.pow(F.sin((a - c) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((b - d) / 2), F.lit(2.0))
    return 6371 * 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def readout(kind: Column, value: Column, low: Column, high: Column, se: Column, z: float) -> tuple[Column, Column]:
    """Low and high ends by kind of uncertainty: an interval as it is, a standard error times z, else the value."""
    lo = F.when(kind == "ci", low).when(kind == "se", value - z * se).otherwise(value)
    hi = F.when(kind == "ci", high).when(kind == "se", value + z * se).otherwise(value)
    return lo, hi


def period_grain(p: Column) -> Column:
    return F.when(p.rlike(r"^\d{4}$"), "year").when(p.rlike(r"^\d{4}-Q[1-4]$"), "quarter").when(p.rlike(r"^\d{4}-\d{2}$"), "month").when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day")
