"""The content entities, derived from the tables, and validated scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i)


def seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content items: documents with the labels' quality as trust."""
    d, quality = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("doc_id")
    return d.join(quality, "doc_id", "left").select(
        F.concat(F.lit("d"), n.cast("string")).alias("id"), n.alias("ord"), "source", F.trim(F.regexp_extract("text", r"^[^\n.]{1,80}", 0)).alias("title"), F.col("text").alias("body"),
        (F.lit(v.NOW - v.DAY) - n * 37 % 43200 * 60).alias("published_s"), F.array(pick(v.CHANNELS, n % 18), pick(v.CHANNELS, (n * 7 + 3) % 18)).alias("topics"), F.col("quality").cast("double").alias("trust"),
        pick(v.ITEM_KINDS, n % 6).alias("kind"), pick(v.SOURCE_TYPES, n % 9).alias("source_type"), (F.col("n_chars") % 500).alias("score"), (n % 50).alias("comments"), F.concat(F.lit("https://e.example/"), (n % 700).cast("string")).alias("url"),
        F.array(F.concat(F.lit("p"), (n % 41).cast("string")), F.concat(F.lit("q"), (n * 7 % 43).cast("string")), F.concat(F.lit("r"), (F.floor(n / 2) % 37).cast("string"))).alias("entities"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without their bodies: what scores and gates need of a body are its plain length, words and minutes."""
    p = F.col("plain")
    rows = items(spark, sf_dir).withColumn("plain", text.plain(F.col("body")))
    rows = rows.withColumns({"n_plain": F.length(p), "minutes": text.half_up(text.plain_words(p) / v.WORDS_PER_MINUTE)})
    return rows.drop("body", "plain")


def engagements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Engagement events, valid ones and rejects with the reason."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "read").when(F.col("event_type") == "purchase", "dwell")
    rows = e.select("event_id", F.concat(F.lit("d"), F.regexp_extract("props", r"(\d+)", 1)).alias("item_id"), kind.alias("type"), F.col("event_type").alias("raw_type"), seconds(F.col("ts")).alias("at_s"), F.when(kind == "dwell", F.col("value") * 1000).alias("dwell_ms"), F.col("user_id").alias("device"))
    return rows.where("type is not null").drop("raw_type"), rows.where("type is null").select("event_id", "raw_type", F.lit("unknown type").alias("reason"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their stored health, from customers."""
    n = F.col("c_custkey")
    status = F.when(n % 11 == 0, "disabled").when(n % 7 == 0, "failing").when(n % 5 == 0, "dormant").otherwise("active")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), n.cast("string")).alias("id"), n.alias("n"), status.alias("status"), (n % 11 != 0).alias("enabled"), F.when(n % 7 == 0, n % 3).otherwise(0).alias("strikes"), F.when(n % 11 == 0, v.NOW - (n % 20) * v.DAY).alias("disabled_s"), (F.lit(v.NOW) - (n % 60) * v.DAY).alias("last_ok_s"), pick(v.CHANNELS, n % 18).alias("channel"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fetch outcome of each source, from orders."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey").agg(F.max(F.struct(seconds(F.col("o_orderdate")).alias("t"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))).alias("m"))
    s, k = F.col("m.s"), F.col("m.k") % 5
    return last.select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("id"), (s == "O").alias("ok"), F.when(s == "F", F.when(k == 0, 404).when(k == 1, 410).when(k == 4, 403)).when((s == "P") & (k < 3), 503).alias("http_status"), F.when(s == "F", F.when(k == 2, "dns").when(k == 3, "not-a-feed").otherwise("http-4xx")).when(s == "P", F.when(k < 3, "http-5xx").otherwise("timeout")).alias("error_kind"), F.when(s == "O", F.col("m.k") % 4).otherwise(0).alias("item_count"))
