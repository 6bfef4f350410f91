"""Scans of loosely written files, with rejects, and sinks that check what they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions import text
from feedloom.operators.graph import small

#: Days that may be broadcast when a ledger is written again.
DAYS = 100_000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_arrays(spark: SparkSession, path: str, schema: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Elements of the JSON arrays in files of one array each: the valid ones, and (file, element) of the others.

    A missing path and what is no array give nothing; an element that doesn't fit the schema is not valid.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, element string")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json("value", "array<string>")).alias("element"))
    rows = raw.withColumn("row", F.from_json("element", schema))
    names = [f.name for f in rows.schema["row"].dataType.fields]
    flat = rows.select("file", "element", *(F.col(f"row.{n}").alias(n) for n in names)).withColumn("__ok", F.coalesce(valid, F.lit(False)))
    return flat.where("__ok").select(*names), flat.where("not __ok").select("file", "element")


def first_filled(spark: SparkSession, paths: dict[str, str], schema: str | StructType) -> DataFrame:
    """The first of the tables (by name) that is there and has rows, with its name as origin; no rows if there is none."""
    for name, path in paths.items():
        if exists(spark, path):
            df = spark.read.schema(schema).parquet(path)
            if not df.isEmpty():
                return df.withColumn("origin", F.lit(name))
    return spark.createDataFrame([], schema).withColumn("origin", F.lit(None).cast("string"))


def shards(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """All JSON lines of the folder's shards, with the file each is from."""
    return spark.read.schema(schema).json(f"{folder}/{pattern}").withColumn("file", F.col("_metadata.file_path"))


def listed(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of files that hold a JSON array, or an object with an array in `field`."""
    rows = spark.read.text(path)
    of = lambda s: F.from_json(F.col("value"), s)
    both = F.when(F.ltrim("value").startswith("["), of(f"array<struct<{schema.replace(' ', ': ')}>>")).otherwise(of(f"struct<{field}: array<struct<{schema.replace(' ', ': ')}>>>")[field])
    return rows.select(F.explode(both).alias("r")).select("r.*")


def numbers(payload: Column, field: str) -> Column:
    """A field's map with only the values that are numbers."""
    raw = F.from_json(payload, f"struct<{field}: map<string, string>>")[field]
    return F.map_filter(F.transform_values(raw, lambda _, x: x.try_cast("double")), lambda _, x: x.isNotNull())


def outline(lines: DataFrame, order: str, line: str) -> DataFrame:
    """Feeds of outline lines, one a domain (of the page, else of the feed), the first one; only http addresses."""
    tag = F.explode(F.regexp_extract_all(line, F.lit(r"(?i)(<outline\b[^>]*>)"), 1)).alias("tag")
    at = lambda name: F.nullif(F.regexp_extract("tag", rf'(?i)\b{name}="([^"]*)"', 1), F.lit(""))
    rows = lines.select(order, tag).select(order, at("xmlUrl").alias("feed"), at("htmlUrl").alias("page")).where(F.col("feed").rlike("(?i)^https?://"))
    rows = rows.withColumn("domain", text.host(F.coalesce("page", "feed"))).where("domain is not null")
    return rows.groupBy("domain").agg(F.min(F.struct(order, "feed", "page")).alias("f")).select("domain", "f.*")


def split_safe(rows: DataFrame, html: str) -> tuple[DataFrame, DataFrame]:
    """Rows with safe markup, and the others with their reasons."""
    found = text.unsafe_reasons(F.coalesce(F.col(html), F.lit("")))
    return rows.where(F.size(found) == 0), rows.withColumn("reasons", found).where(F.size("reasons") > 0)


def write_safe(rows: DataFrame, html: str, path: str, quarantine: str) -> None:
    """Safe rows to the table, the others with their reasons to quarantine."""
    safe, dropped = split_safe(rows, html)
    dropped.write.mode("append").parquet(quarantine)
    safe.write.mode("overwrite").parquet(path)


def write_checked(rows: DataFrame, path: str, valid: Column) -> None:
    """Replaces a table by the rows that are valid."""
    rows.where(valid).write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends records, a JSON line each; what is there stays."""
    rows.write.mode("append").json(path)


def upsert_days(rows: DataFrame, path: str, key: str = "day") -> DataFrame:
    """Rows into a ledger with one row a day, the new one replacing that of the same day; returns the ledger.

    Each writing makes a new version beside the old ones; the newest complete one counts.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))] if fs.exists(at) else []
    newest = rows.withColumn("__turn", F.lit(0))
    if versions:
        old = spark.read.parquet(f"{path}/{max(versions)}")
        newest = newest.unionByName(old.join(small(rows.select(key).distinct(), DAYS), key, "left_anti").withColumn("__turn", F.lit(1)))
    one = newest.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy("__turn"))).where("__nth = 1").drop("__turn", "__nth")
    target = f"{path}/{max(versions, default=0) + 1}"
    one.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _versions(spark: SparkSession, path: str, done: bool) -> list[int]:
    """Numbers of the folders under path named n or version=n; with done only those whose writer finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName().rpartition("=")[2]) for p in found if not done or fs.exists(hadoop.Path(p, "_SUCCESS")))


def write_shards(fresh: DataFrame, path: str, keys: list[str], key: str = "id", retained: Column | None = None) -> DataFrame:
    """Merges fresh rows into a table of shards (one for each value of keys): of rows with the same key in a shard the fresh one stays.

    Only shards with fresh rows are written, into a new version; the others keep their files. A manifest names each
    shard's version, and writing it whole is what commits: a writer that fails before leaves the table as it was. Shards
    that don't meet `retained` (a condition on keys) leave the manifest. Keys are not null; among fresh rows with one key any stays.
    Returns the table.
    """
    spark = fresh.sparkSession
    version = max([0, *_versions(spark, f"{path}/data", False), *_versions(spark, f"{path}/manifest", False)]) + 1
    fresh = fresh.dropDuplicates([*keys, key])
    touched = fresh.select(*keys).distinct()
    merged, manifest = fresh, touched.withColumn("version", F.lit(version))
    if _versions(spark, f"{path}/manifest", True):
        old = read_shards(spark, path, keys).select(*fresh.columns)
        merged = fresh.unionByName(old.join(small(touched, DAYS), keys, "left_semi").join(fresh.select(*keys, key), [*keys, key], "left_anti"))
        manifest = manifest.unionByName(_manifest(spark, path).join(touched, keys, "left_anti"))
    merged.write.partitionBy(*keys).parquet(f"{path}/data/version={version}")
    kept = manifest if retained is None else manifest.where(retained)
    kept.write.parquet(f"{path}/manifest/{version}")  # a row a shard
    return read_shards(spark, path, keys)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest/{_versions(spark, f'{path}/manifest', True)[-1]}")


def read_shards(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The shards that the newest whole manifest names; files of older versions and of failed writers are not read."""
    manifest = _manifest(spark, path)
    data = spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/version={n}" for n in sorted({r["version"] for r in manifest.select("version").distinct().collect()})))
    same = [data[k].cast("string") == manifest[k].cast("string") for k in keys]
    return data.join(small(manifest, DAYS), [*same, data["version"] == manifest["version"]], "left_semi").drop("version")
