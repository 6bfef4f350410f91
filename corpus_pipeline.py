"""The corpus pipeline: toxic texts go, then exact copies, near copies and benchmark leaks; what stays is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import toxicity
from feedloom.llm.common import Workspace, small, text_of
from feedloom.llm.decontaminate import contaminated
from feedloom.llm.exact_dedup import exact_dedup
from feedloom.llm.ngram_jaccard import jaccard_groups
from feedloom.llm.queries import packed, table

#: Rows of (id, hash) that may be broadcast to leave documents out; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _join(docs: DataFrame, listed: DataFrame, keys: list[str], how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the rows whose keys (null-safe) are listed."""
    same = [docs[k].eqNullSafe(listed[k]) for k in keys]
    return docs.join(small(listed, BROADCAST_ROWS), same, how)


def _keep(docs: DataFrame, marked: DataFrame, keys: list[str], gone: DataFrame, stays: DataFrame) -> DataFrame:
    """docs (with keys in marked) without the rows in gone; of rows in stays that repeat their keys one is kept."""
    repeated = stays.groupBy(*keys).count().where("count > 1").drop("count")
    kept = _join(marked, gone, keys, "left_anti")
    once = _join(kept, repeated, keys, "left_semi").dropDuplicates(keys)
    return _join(kept, repeated, keys, "left_anti").unionByName(once).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic, whatever their id; all their columns stay."""
    model = toxicity.train(toxicity.labelled_texts(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id; a null id yields to any other, null texts are empty."""
    decided = Workspace(spark).write(exact_dedup(docs), "decided")
    keys = ["doc_id", "__sha"]
    of = lambda rows: decided.where(rows).select("doc_id", F.col("text_sha256").alias("__sha"))
    return _keep(docs, docs.withColumn("__sha", F.sha2(text_of(), 256)), keys, of("not kept").distinct(), of("kept and group_size > 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or by others, one row stays: the least id's.

    Rows are told apart by id and text, so other texts under a repeated id and rows with null ids are decided by
    themselves. Where an id has several texts in a group, that with the smallest MD5 stays. Texts without words all stay.
    """
    found = Workspace(spark).write(jaccard_groups(docs, k=5, num=80, den=100), "found")
    keys = ["doc_id", "__md5"]
    of = lambda rows: found.where(rows).select("doc_id", F.col("text_md5").alias("__md5"))
    return _keep(docs, docs.withColumn("__md5", F.md5(text_of())), keys, of("not kept").distinct(), of("kept and n_shingles > 0"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; rows are told apart by id and text, null ids included."""
    held = Workspace(spark).write(contaminated(docs, table(spark, sf_dir, "benchmark")), "held")
    held = held.select("doc_id", F.col("fp").alias("__fp")).distinct()
    return _join(docs.withColumn("__fp", F.xxhash64(text_of())), held, ["doc_id", "__fp"], "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, as in the packing query."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Classifier, connected components and tokeniser are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    space, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = space.write(stage(spark, docs, sf_dir), f"stage-{i}")
    return space.write(STAGES[-1][1](spark, docs, sf_dir), "packed")
