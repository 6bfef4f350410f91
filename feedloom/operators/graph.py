"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset and the master is local (tests), under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"feedloom-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/feedloom-{uuid.uuid4().hex}"


class Workspace:
    """Tables that one query writes to the shared folder, so that lost executors never recompute what is finished."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_folder(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most `rows` rows; beyond that Spark's own choice of join stands."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Edges beyond which minima are written before they are joined.
SPLIT_EDGES = 1_000_000


def components(spark: SparkSession, space: Workspace, links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a, b): (node, component), component being the smallest node.

    Alternates the large-star and small-star steps until the edges stay the same; each round is two map-side-combined
    minima and two joins. In large graphs what joins meet is written first, so that Spark
    can split a hub's rows. Nodes without links are not in the result.
    """
    written: list[str] = []

    def put(df: DataFrame, what: str) -> tuple[DataFrame, tuple]:
        """Writes df; its rows and checksums are taken on the way."""
        seen = Observation()
        found = space.write(df.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1000003).alias("s")), what)
        written.append(what)
        return found, tuple(seen.get[k] for k in ("n", "x", "s"))

    def met(df: DataFrame, what: str) -> DataFrame:
        return space.write(df, what) if now[0] > SPLIT_EDGES else df

    edges, now = put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, k = None, 0
    while now != seen and now[0]:
        k, seen = k + 1, now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = met(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least-{k}")
        large = met(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-large-{k}")
        low = met(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low-{k}")
        new = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges, now = put(new.distinct(), f"{name}-{k}")
        space.drop(*written[:-1], *(f"{name}-{x}-{k}" for x in ("least", "large", "low")))
        del written[:-1]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes (node) on a directed cycle of edges (a, b), however long: those that reach themselves.

    Nodes without edges in or out are peeled off until nothing changes. Then the greatest node that reaches a node is
    its colour, and a colour's node with all that reach it within the colour is a strong component; the edges left
    within colours are taken again. All rounds go on to the fixed point and hold nodes and edges, never pairs.
    """
    space = Workspace(edges.sparkSession)
    written = 0

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        nonlocal written
        written += 1
        return space.write(df, f"cycles-{written}"), f"cycles-{written}"

    every, _ = put(edges.select("a", "b").where("a is not null and b is not null").distinct())
    found = every.where("a = b").select(F.col("a").alias("node"))
    left, name = put(every.where("a <> b"))
    size = left.count()
    while size:
        while True:
            peeled, next_name = put(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            space.drop(name)
            left, name, before, size = peeled, next_name, size, peeled.count()
            if size == before:
                break
        if not size:
            break
        colours, last = put(left.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        moved = True
        while moved:
            reached = left.join(colours.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("reached"))
            now, next_name = put(colours.select("node", F.col("colour").alias("was")).join(reached, "node", "left").select("node", F.greatest("was", "reached").alias("colour"), "was"))
            space.drop(last)
            colours, last = now.drop("was"), next_name
            moved = now.where("colour > was").limit(1).count() > 0
        side = lambda c, x: c.select(F.col("node").alias(x), "colour")
        inside, inside_name = put(left.join(side(colours, "a"), "a").join(side(colours, "b"), ["b", "colour"]).select("a", "b", "colour"))
        back, back_name = put(colours.where("node = colour"))
        reach, grown = back.count(), True
        while grown:
            now, next_name = put(back.union(inside.join(back.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), "colour")).distinct())
            space.drop(back_name)
            back, back_name = now, next_name
            reach, grown = now.count(), now.count() > reach
        strong = back.join(back.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1"), "colour", "left_semi")
        found = found.union(strong.select("node"))
        space.drop(name)
        rest = inside.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti")
        left, name = put(rest.select("a", "b"))
        space.drop(inside_name, last)
        size = left.count()
    return found.distinct()
