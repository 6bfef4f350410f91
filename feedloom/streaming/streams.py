"""Structured Streaming counterparts: validated intake, daily weights, session windows, latest rollup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions.scoring import decay, event_weight
from feedloom.operators.feed import profile_of
from feedloom.operators.graph import Workspace


def event_stream(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The event table as a stream of files, with types and weights as in the batch scan."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path) if pattern == "events" else spark.readStream.schema(schema).parquet(path)
    return weighted(raw)


def weighted(raw: DataFrame) -> DataFrame:
    """Rows of the event table, from a table or a stream, with the engagement's type and weight."""
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "read").when(F.col("event_type") == "purchase", "dwell")
    rows = raw.select("event_id", F.concat(F.lit("d"), F.regexp_extract("props", r"(\d+)", 1)).alias("item_id"), F.col("ts").cast("timestamp").alias("at_ts"), F.col("user_id").alias("device"), kind.alias("type"), F.col("event_type").alias("raw_type"), F.when(kind == "dwell", F.col("value") * 1000).alias("dwell_ms"))
    return rows.withColumn("w", event_weight(F.col("type"), F.col("dwell_ms")))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its sink as a table of the shared folder."""
    spark = stream.sparkSession
    space = Workspace(spark)
    query = stream.writeStream.format("parquet").option("path", space.folder(name)).option("checkpointLocation", space.folder(f"{name}-state")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(space.folder(name))


def daily_weights(events: DataFrame, late: str = "40 days") -> DataFrame:
    """Event count and weight per UTC day of valid events; days close when the watermark has passed them."""
    day = F.window("at_ts", "1 day")
    return events.where("type is not null").withWatermark("at_ts", late).groupBy(day.alias("d")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "40 days") -> DataFrame:
    """Engagement sessions by device."""
    return events.where("type is not null").withWatermark("at_ts", late).groupBy("device", F.session_window("at_ts", gap).alias("s")).agg(F.count("*").alias("n"))


def _newest(space: Workspace, name: str, before: int) -> DataFrame | None:
    """The newest complete table name-N of the folder with N below `before`."""
    spark = space.spark
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(space.folder(name))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))] if fs.exists(at) else []
    done = [n for n in done if n < before]
    return spark.read.parquet(f"{space.folder(name)}/{max(done)}") if done else None


def merged_batches(stream: DataFrame, name: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], space: Workspace | None = None) -> DataFrame:
    """A table kept up to date batch by batch: merge(batch, table so far) is written as a new table.

    What a batch goes on from is read from the folder, the newest table with a smaller batch number; so a batch that is
    run again, also by a restarted stream with the same space, reads the same table and writes the same one.
    """
    spark = stream.sparkSession
    space = space or Workspace(spark)

    def step(batch: DataFrame, number: int) -> None:
        space.write(merge(batch, _newest(space, name, number)), f"{name}/{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", space.folder(f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = _newest(space, name, 1 << 62)
    return found if found is not None else merge(spark.createDataFrame([], stream.schema), None)


def rollup_batches(stream: DataFrame, keys: list[str], value: str, name: str, space: Workspace | None = None) -> DataFrame:
    """Sums by key kept up to date batch by batch: each batch adds its partial sums to the table of the last one."""

    def merge(batch: DataFrame, table: DataFrame | None) -> DataFrame:
        part = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("w"))
        return part if table is None else part.unionByName(table).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))

    return merged_batches(stream, name, merge, space)


def complete(stream: DataFrame, name: str) -> DataFrame:
    """An aggregation's whole result, written anew by each batch; the last one's table."""
    space = Workspace(stream.sparkSession)
    query = stream.writeStream.foreachBatch(lambda batch, number: space.write(batch, f"{name}/{number}")).outputMode("complete").option("checkpointLocation", space.folder(f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return _newest(space, name, 1 << 62)


def live_profile(events: DataFrame, items: DataFrame, now: int, space: Workspace | None = None) -> DataFrame:
    """The taste profile of a stream of events: decayed weights by item, kept batch by batch, and the gate's figures."""
    age = (F.lit(now) - F.unix_timestamp("at_ts")) / float(v.DAY)
    rows = events.select(F.col("item_id"), (F.col("w") * decay(age)).alias("w"), F.unix_timestamp("at_ts").alias("at_s"))

    def merge(batch: DataFrame, table: DataFrame | None) -> DataFrame:
        part = batch.groupBy("item_id").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"))
        return part if table is None else part.unionByName(table).groupBy("item_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"))

    sums = merged_batches(rows, "profile", merge, space)
    ready = (F.sum("n") >= v.MIN_EVENTS) & (F.max("last_s") - F.min("first_s") >= v.MIN_DAYS * v.DAY)
    gate = sums.agg(ready.alias("ready")).where("ready")
    return profile_of(sums.join(F.broadcast(gate)).select("item_id", "w"), items)


def rolling_archive(stream: DataFrame, now: int, days: int, space: Workspace | None = None) -> DataFrame:
    """(id, published_s) of a stream: the newest row an id, those of the last days."""

    def merge(batch: DataFrame, table: DataFrame | None) -> DataFrame:
        every = batch.select("id", "published_s") if table is None else batch.select("id", "published_s").unionByName(table)
        return every.groupBy("id").agg(F.max("published_s").alias("published_s")).where(F.col("published_s") >= now - days * v.DAY)

    return merged_batches(stream, "archive", merge, space)


def latest(stream: DataFrame, n: int, space: Workspace | None = None) -> DataFrame:
    """The latest n events (event_id, at_ts) of a stream; each batch replaces the table."""

    def merge(batch: DataFrame, table: DataFrame | None) -> DataFrame:
        every = batch if table is None else batch.unionByName(table)
        return every.orderBy(F.desc("at_ts"), "event_id").limit(n)

    return merged_batches(stream, "latest", merge, space)
