"""Removal of lines that many documents repeat, in DataFrame operations only.

Hashes of the lines are range-partitioned with the document behind them, so a line that very many documents hold is cut
into several ranges, and sorted by document (largest first) and position. Each range gives the first occurrence and the
number of documents of its lines, a row a line; what ranges share is added up. The result is a run-length-coded keep
bitmap for each document that loses lines, not its text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, small, text_of

_BLANK = " \t\n\x0b\x0c\r"
#: Repeated lines (28 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_LINES = 200_000
#: Bytes of bitmaps that may be broadcast to the texts; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    """(doc, text_hash, n_lines, pos, h1, h2): the lines whose keys have at least `least` characters, by 128-bit hashes."""
    t = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("doc"), F.xxhash64(t).alias("text_hash"), F.split(t, "\n").alias("lines")).withColumn("n_lines", F.size("lines"))
    rows = rows.select("doc", "text_hash", "n_lines", F.posexplode("lines").alias("pos", "line")).where(F.octet_length("line") >= least)
    keyed = rows.where(F.char_length(F.btrim("line", F.lit(_BLANK))) >= least).withColumn("key", line_key(F.col("line")))
    return keyed.select("doc", "text_hash", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def line_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 40, documents: int = 5) -> DataFrame:
    """(id, text_hash, n_lines, n_dropped, keep) for each document that loses lines; all others keep every line.

    A line whose key has at least `least` characters and stands in at least `documents` documents stays only in the one
    with the largest id, there everywhere. Rows that repeat an id and its text are one document; other texts under one
    id are documents of their own, and all of the largest id keep the line. A null id is smaller than any other; among
    null ids alone nothing goes. Null texts are empty, an empty text is one empty line, an empty table gives no rows.
    keep: for each run of kept lines its first line and its length, 4 bytes each.
    """
    space = Workspace(docs.sparkSession)
    hashes = space.write(line_hashes(docs, id_column, text_column, least), "hashes")  # ranges are sampled from these
    order = ["h1", "h2", F.desc("doc"), "text_hash"]
    dealt = hashes.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    # by ranges already: no further shuffle
    held = space.write(dealt.groupBy("h1", "h2", "doc", "text_hash", "n_lines").agg(F.collect_set("pos").alias("at")), "held")
    crowded = space.write(held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("first")).where(F.col("n") >= documents).drop("n"), "crowded")
    gone = held.join(small(crowded, BROADCAST_LINES), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    lost = gone.select("doc", "text_hash", "n_lines", F.explode("at").alias("pos")).groupBy("doc", "text_hash", "n_lines").agg(F.array_sort(F.collect_list("pos")).alias("lost"))
    before, behind = F.concat(F.array(F.lit(-1)), "lost"), F.concat("lost", F.array("n_lines"))
    runs = F.filter(F.zip_with(before, behind, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n"))), lambda r: r["n"] > 0)
    packed = F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(F.lpad(F.hex(r["start"]), 8, "0"), F.lpad(F.hex(r["n"]), 8, "0"))), ""))
    return space.write(lost.select(F.col("doc").alias(id_column), "text_hash", "n_lines", F.size("lost").alias("n_dropped"), packed.alias("keep")), "bitmaps")


def kept_runs(keep: Column) -> Column:
    """The runs (start, n) of a keep bitmap."""
    number = lambda at: F.conv(F.hex(F.substring(keep, at, 4)), 16, 10).cast("int")
    starts = F.when(F.octet_length(keep) > 0, F.sequence(F.lit(1), F.octet_length(keep), F.lit(8))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(number(i).alias("start"), number(i + 4).alias("n")))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines of a text; without a bitmap all of it."""
    lines = F.split(text, "\n")
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.flatten(F.transform(kept_runs(keep), lambda r: F.slice(lines, r["start"] + 1, r["n"]))), "\n"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept) for every row of docs: its line counts and the text that its bitmap leaves."""
    size = bitmaps.agg(F.sum(F.octet_length("keep") + 64)).first()[0] or 0
    marks = bitmaps.select(F.col(id_column).alias("doc"), F.col("text_hash").alias("hash"), "n_dropped", "keep")
    rows = docs.select(F.col(id_column), text_of(text_column).alias("body")).withColumn("text_hash", F.xxhash64("body"))
    both = rows.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, rows[id_column].eqNullSafe(marks["doc"]) & (rows["text_hash"] == marks["hash"]), "left")
    n_lines = F.octet_length("body") - F.octet_length(F.replace("body", F.lit("\n"), F.lit(""))) + 1
    return both.select(id_column, n_lines.cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), kept_text(F.col("body"), F.col("keep")).alias("kept"))
