"""Catalogues of sources and reads: what they have, their facets, orders, ids and assignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions import prose, text
from feedloom.operators.feed import ranked
from feedloom.operators.graph import Workspace

# fixed values: types of sources that are read by jobs elsewhere, states in their order
DEFERRED_TYPES = ["x"]
STATES = ["producing", "dormant", "failing", "deferred", "disabled"]


def enriched(registry: DataFrame, items: DataFrame) -> DataFrame:
    """Sources (enabled, strikes, type) with n_items, mean minutes, last_s of their items, and their state."""
    own = items.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_items"), (text.half_up(F.avg(F.greatest(F.lit(1), "minutes")) * 10) / 10).alias("minutes"), F.max("published_s").alias("last_s"))
    rows = registry.join(own, "id", "left").na.fill(0, ["n_items", "minutes"])
    state = F.when(~F.col("enabled"), F.when(F.col("type").isin(DEFERRED_TYPES), "deferred").otherwise("disabled")).when(F.col("strikes") > 0, "failing").when(F.col("n_items") > 0, "producing").otherwise("dormant")
    return rows.withColumn("state", state)


def source_facets(sources: DataFrame) -> DataFrame:
    """(facet, value, n, mean_trust): how many in all and their mean trust, by state, type and channel, in one pass."""
    facets = F.array(*(F.struct(F.lit(k).alias("facet"), c.alias("value")) for k, c in (("all", F.lit("total")), ("state", F.col("state")), ("type", F.col("type")), ("channel", F.col("channel")))))
    rows = sources.select(F.explode(facets).alias("f"), "trust").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"), F.avg("trust").alias("t"))
    return rows.select("facet", "value", "n", F.when(F.col("facet") == "all", F.col("t")).alias("mean_trust"))


def cards(items: DataFrame) -> DataFrame:
    """Reads as cards: id, title, topics, source, kind, published_s, read_min (230 words a minute, one at least), date_label, excerpt."""
    day = F.date_format(F.timestamp_seconds("published_s"), "yyyy-MM-dd")
    # a column of its own, as the words' number needs it three times
    read = items.withColumn("plain", text.plain(F.col("body")))
    minutes = F.greatest(F.lit(1), text.half_up(text.plain_words(F.col("plain")) / 230))
    return read.select("id", "title", "topics", "source", "kind", "published_s", minutes.alias("read_min"), day.alias("date_label"), prose.excerpt(F.col("body")).alias("excerpt"))


def reads_index(read: DataFrame) -> DataFrame:
    """(facet, value, n, minutes): all reads and their minutes, reads by kind and by channel, in one pass."""
    facets = F.concat(F.array(F.struct(F.lit("all").alias("facet"), F.lit("total").alias("value")), F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("value"))), F.transform("topics", lambda t: F.struct(F.lit("channel").alias("facet"), t.alias("value"))))
    rows = read.select(F.explode(facets).alias("f"), "read_min").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"), F.sum("read_min").alias("m"))
    return rows.select("facet", "value", "n", F.when(F.col("facet") == "all", F.col("m")).alias("minutes"))


def by_channel(sources: DataFrame) -> DataFrame:
    """(channel, pos, n, best): sources by each of their channels, or unsorted; pos is the vocabulary's, 99 beyond it."""
    named = F.when(F.size("channels") > 0, F.col("channels")).otherwise(F.array(F.lit("unsorted")))
    rows = sources.select("id", "trust", F.explode(named).alias("channel"))
    best = F.min(F.struct((-F.coalesce("trust", F.lit(0))).alias("t"), "id"))
    pos = F.array_position(F.array(*map(F.lit, v.CHANNELS)), F.col("channel"))
    return rows.groupBy("channel").agg(F.count("*").alias("n"), best.alias("b")).select("channel", F.when(pos > 0, pos).otherwise(99).alias("pos"), "n", F.col("b.id").alias("best"))


def places(rows: DataFrame, orders: dict[str, list[Column]]) -> DataFrame:
    """id and its place under each of the orders (none of which may have ties), each sorted by ranges.

    Each sort reads its rows twice, so they are written first: what they are computed from (texts, say) is read once.
    """
    rows, out = Workspace(rows.sparkSession).write(rows, "rows"), None
    for name, order in orders.items():
        one = ranked(rows, order, name).select("id", name)
        out = one if out is None else out.join(one, "id")
    return out


def looked_up(lists: DataFrame, key: str, ids: str, rows: DataFrame) -> DataFrame:
    """(key, found): the rows that a list of ids names, in the list's order; unknown ids drop out."""
    asked = lists.select(key, F.posexplode(ids).alias("__at", "id"))
    one = F.struct("__at", *(c for c in rows.columns))
    return asked.join(rows, "id").groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("found"))


def skip_next(sentences: str, bad: Callable[[Column], Column]) -> Column:
    """The sentences without the bad ones and the one behind each; what is skipped doesn't count as bad."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(s: Column, x: Column) -> Column:
        drop = s["skip"] | bad(x)
        return F.struct(F.when(drop, s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"), (~s["skip"] & bad(x)).alias("skip"))

    return F.aggregate(F.col(sentences), start, step)["kept"]


def allocated_ids(rows: DataFrame, key: str, taken: DataFrame) -> DataFrame:
    """(key, id): base, base-2, base-3 and so on in the order of keys, behind the highest number that is taken."""
    used = taken.select(F.regexp_replace("id", r"-\d+$", "").alias("base"), F.coalesce(F.nullif(F.regexp_extract("id", r"-(\d+)$", 1), F.lit("")).cast("bigint"), F.lit(1)).alias("k"))
    top = Workspace(rows.sparkSession).write(used.groupBy("base").agg(F.max("k").alias("top")), "taken")
    # places within a base are numbered by ranges, so a base that very many share is no single task
    placed = ranked(rows.select(key, "base"), [F.col("base"), F.col(key)], "place")
    first = placed.groupBy("base").agg(F.min("place").alias("first"))
    n = F.col("place") - F.col("first") + 1 + F.coalesce("top", F.lit(0))
    return placed.join(first, "base").join(top, "base", "left").select(key, F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("id"))


def synthetic_body(minutes: Column, full: Column) -> Column:
    """A text with these read minutes that is or isn't over the bound of a full text."""
    n = minutes * v.WORDS_PER_MINUTE
    words = F.greatest(n, F.when(full, F.lit(1)).otherwise(0)).cast("int")
    word = F.when(full & (minutes <= 1), "w" * 900).otherwise("w" * (v.FULL_TEXT_CHARS // 225))
    plain = F.when(full, F.concat(word, F.repeat(F.lit(" word"), words - 1))).otherwise(F.trim(F.repeat(F.lit("w "), words)))
    return F.when(words == 0, "").otherwise(plain)


def assignments(scored: DataFrame, formats: DataFrame | None, weekday: int, most: int = 3) -> DataFrame:
    """(turn, format, channel, title, is_column, id, pos): what to write next, from `most` assignments at most, a row an item.

    The columns that are due on the weekday (Monday is 0) come first, with the best items of their channel (four, or two
    for a short format; a column without any has one row without an id). Then the best stories by summed total and size
    that no column has used, with all their items. A story's format serves the channel of its best item; formats: liking
    (format, v) decides, or, where that is None, the length: stories of several items get a long one. Ties go by name.
    """
    spark, space = scored.sparkSession, Workspace(scored.sparkSession)
    best = [F.desc("total"), F.col("id")]
    due = [f for f, day in v.SERIES.items() if day is None or day == weekday][:most]
    kind = "turn int, format string, channel string, title string, is_column boolean, id string, pos bigint, cluster_id string"
    picked = spark.createDataFrame([], kind)
    for turn, f in enumerate(due):
        channel = v.FORMATS[f][0]
        rows = scored.where(F.array_contains("topics", channel)).orderBy(*best).limit(2 if f in v.BRIEF_FORMATS else 4).select("id", "title", "cluster_id", F.struct((-F.col("total")).alias("t"), "id").alias("key"))
        listed = rows.agg(F.array_sort(F.collect_list(F.struct("key", "id", "title", "cluster_id"))).alias("l"))  # four rows
        opened = listed.select(F.posexplode_outer("l").alias("pos", "i"), F.coalesce(F.get("l", 0)["title"], F.lit(f"{f} column")).alias("title"))
        picked = picked.union(opened.select(F.lit(turn), F.lit(f), F.lit(channel), "title", F.lit(True), "i.id", F.col("pos").cast("bigint"), "i.cluster_id"))
    picked = space.write(picked, "columns")
    lead = F.min(F.struct((-F.col("total")).alias("t"), "id", "title", F.coalesce(F.get("topics", 0), F.lit(v.OTHER_CHANNEL)).alias("channel"))).alias("lead")
    stories = scored.groupBy("cluster_id").agg((F.sum("total") + F.log10(1 + F.count("*"))).alias("score"), F.max("published_s").alias("newest_s"), F.count("*").alias("n"), lead)
    used = F.broadcast(picked.select("cluster_id").where("cluster_id is not null").distinct())
    top = stories.join(used, "cluster_id", "left_anti").orderBy(F.desc("score"), F.desc("newest_s"), "cluster_id").limit(most - len(due))
    keyed = top.select("cluster_id", "n", "lead", F.struct((-F.col("score")).alias("s"), (-F.col("newest_s")).alias("d"), "cluster_id").alias("key"))
    turns = keyed.agg(F.array_sort(F.collect_list(F.struct("key", "cluster_id", "n", "lead"))).alias("l")).select(F.posexplode("l").alias("k", "s"))  # `most` rows at most
    turns = space.write(turns.select((F.col("k") + len(due)).cast("int").alias("turn"), "s.cluster_id", "s.n", F.col("s.lead.title").alias("title"), F.col("s.lead.channel").alias("channel")), "turns")
    served = spark.createDataFrame([(c, f, f not in v.BRIEF_FORMATS) for f, cs in v.FORMATS.items() for c in cs], "channel string, format string, long boolean")
    pool = turns.join(F.broadcast(served), "channel", "left").select("turn", "n", F.coalesce("format", F.lit(v.OTHER_FORMAT)).alias("format"), F.coalesce("long", F.lit(v.OTHER_FORMAT not in v.BRIEF_FORMATS)).alias("long"))
    if formats is None:
        order = F.struct(F.when(F.col("n") >= 2, ~F.col("long")).otherwise(F.col("long")).alias("wrong"), "format")
    else:
        pool = pool.join(F.broadcast(formats.select("format", "v")), "format", "left")  # a row a format
        order = F.struct((-F.coalesce("v", F.lit(0.0))).alias("v"), "format")
    chosen = F.broadcast(pool.groupBy("turn").agg(F.min(order)["format"].alias("format")).join(turns, "turn"))
    own = scored.select("id", "cluster_id", "total").join(chosen.drop("n"), "cluster_id")
    placed = ranked(own, [F.col("turn"), *best])
    first = F.broadcast(placed.groupBy("turn").agg(F.min("place").alias("first")))
    told = placed.join(first, "turn").select("turn", "format", "channel", "title", F.lit(False).alias("is_column"), "id", (F.col("place") - F.col("first")).alias("pos"))
    return picked.drop("cluster_id").union(told)
