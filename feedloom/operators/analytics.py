"""Aggregates behind the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions import text


def cooccurrence(items: DataFrame) -> DataFrame:
    """(a, b, n): how many items have both channels; the diagonal counts items with one channel only."""
    pairs = F.flatten(F.transform("topics", lambda x: F.transform(F.filter("topics", lambda y: y != x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    single = F.when(F.size("topics") == 1, F.array(F.struct(F.get("topics", 0).alias("a"), F.get("topics", 0).alias("b")))).otherwise(pairs)
    return items.select(F.explode(single).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def cluster_summary(items: DataFrame) -> DataFrame:
    """Per cluster: size, main group, main channel of it, best title and its score. Ties go to the smaller name."""
    rows = items.withColumn("channel", F.coalesce(F.get("topics", 0), F.lit("tech"))).withColumn("grp", text.group_of(F.col("channel")))
    counts = rows.groupBy("cluster_id", "grp", "channel").agg(F.count("*").alias("n"))
    by_group = counts.groupBy("cluster_id", "grp").agg(F.sum("n").alias("g"), F.min(F.struct((-F.col("n")).alias("n"), "channel")).alias("c"))
    main = by_group.groupBy("cluster_id").agg(F.sum("g").alias("size"), F.min(F.struct((-F.col("g")).alias("g"), "grp", F.col("c.channel").alias("channel"))).alias("m"))
    best = rows.groupBy("cluster_id").agg(F.min(F.struct((-F.col("total")).alias("t"), "id", "title")).alias("b"))
    return main.join(best, "cluster_id").select("cluster_id", "size", F.col("m.grp").alias("grp"), F.col("m.channel").alias("channel"), F.col("b.title").alias("title"), (-F.col("b.t")).alias("best"))


def per_channel(items: DataFrame, value: str = "trust") -> DataFrame:
    return items.select(F.explode("topics").alias("channel"), F.coalesce(value, F.lit(0.0)).alias("x")).groupBy("channel").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


def histogram(rows: DataFrame, value: Column, width: float, bins: int) -> DataFrame:
    """(bin, n) for bins of one width from 0, all present; the last one is closed above, nulls are left out."""
    spark = rows.sparkSession
    placed = rows.select(value.alias("x")).where("x is not null").groupBy(F.least(F.floor(F.col("x") / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").alias("bin")).join(placed, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def equal_bins(rows: DataFrame, value: str) -> DataFrame:
    """Equal-width bins, as many as Sturges' rule gives (5 to 40); one bin if all values are equal."""
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("cnt"))
    k = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.greatest(F.lit(5), F.least(F.lit(40), F.ceil(F.log2(F.col("cnt").cast("double"))) + 1)))
    span = F.broadcast(span.withColumn("bins", k))
    bin_of = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1))
    return rows.where(F.col(value).isNotNull()).crossJoin(span).groupBy(bin_of.cast("bigint").alias("bin"), F.col("bins").cast("bigint").alias("bins")).agg(F.count("*").alias("n"))


def box(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Five-number summaries by group, quartiles by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(group).agg(F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi"), F.count(value).alias("n")).select(group, "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "hi", "n")


def weekly(items: DataFrame, weeks: int = 26) -> DataFrame:
    """(week, a column a group): items a week (Monday, as day number), zero-filled, the last `weeks` weeks."""
    day = F.floor(F.col("published_s") / v.DAY)
    week = day - (day + 3) % 7
    rows = items.select(week.alias("week"), text.group_of(F.get("topics", 0)).alias("grp"))
    wide = rows.groupBy("week").pivot("grp", list(v.GROUPS)).count().na.fill(0)
    return wide.orderBy(F.desc("week")).limit(weeks)


def calendar(items: DataFrame) -> DataFrame:
    """(day, n): items a day from the first to the last day, zero-filled; the last 365 of more than 400 days."""
    days = items.select(F.floor(F.col("published_s") / v.DAY).alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    ends = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    every = ends.select(F.explode(F.sequence(F.when(F.col("hi") - F.col("lo") + 1 > 400, F.col("hi") - 364).otherwise(F.col("lo")), F.col("hi"))).alias("day"))
    return every.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n)


def produced(items: DataFrame, newest: int = 5) -> DataFrame:
    """Per source, from items (id, source, topics, published_s, minutes): items, mean minutes (one decimal), last date, all channels
    produced (sorted, joined by commas) and the ids of the `newest` items, the latest first. Items without a source are left out.

    Both lists are bounded, by the vocabulary of channels and by `newest`; Spark cuts a large source down before it is shuffled.
    """
    rows = items.where("source is not null")
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), (text.half_up(F.avg("minutes") * 10) / 10).alias("mean_minutes"), F.max("published_s").alias("last_s"))
    channels = rows.select("source", F.explode("topics").alias("c")).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("channels"))
    top = top_per_group(rows.select("source", "id", "published_s"), "source", [F.desc("published_s"), F.col("id")], newest)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda t: t["id"])
    latest = top.groupBy("source").agg(F.array_join(ids, ",").alias("newest"))
    return sums.join(channels, "source", "left").join(latest, "source").withColumn("channels", F.coalesce("channels", F.lit("")))


def source_health(items: DataFrame, registry: DataFrame, key: str = "source") -> DataFrame:
    """Every source of the registry with its items' number, mean trust (one decimal) and last date; zeros without items."""
    found = items.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n_items"), F.avg("trust").alias("t"), F.max("published_s").alias("last_s"))
    return registry.join(found, "id", "left").select("id", "status", F.coalesce("n_items", F.lit(0)).alias("n_items"), (text.half_up(F.coalesce("t", F.lit(0.0)) * 10) / 10).alias("mean_trust"), "last_s")


def shares(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value summed, its share of all, its ratio to the greatest)."""
    sums = rows.groupBy(group).agg(F.sum(value).alias("v"))
    all_of = F.broadcast(sums.agg(F.sum("v").alias("all_v"), F.max("v").alias("top_v")))
    return sums.crossJoin(all_of).select(group, "v", F.try_divide("v", "all_v").alias("share"), F.try_divide("v", "top_v").alias("ratio"))


def _block(name: str, rows: DataFrame, k1: Column | None = None, k2: Column | None = None, n: Column | None = None, x: Column | None = None) -> DataFrame:
    return rows.select(F.lit(name).alias("block"), *((F.lit(None) if c is None else c).cast(t).alias(a) for a, c, t in (("k1", k1, "string"), ("k2", k2, "string"), ("n", n, "bigint"), ("x", x, "double"))))


def _stacked(blocks: list[DataFrame]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def dashboard(items: DataFrame, sources: int = 12, authors: int = 10, best: int = 10) -> DataFrame:
    """The whole dashboard as rows (block, k1, k2, n, x), from scored items (id, title, topics, source, source_type, author, published_s,
    trust, affinity, total, minutes, cluster_id).

    Blocks: hero (what, number), cooccurrence (two channels, items), cluster (id, main channel, items, best score), scatter (item,
    channel, minutes, taste), read_bin, week (Monday's day number, group), box (source type, point of the summary), channel (with group,
    items, mean taste), source_type, top_source, top_author (blank ones left out), top_item (by taste, with channel and minutes) and
    trust_bin. The tops are limited to what a page shows; everything else is whole. `items` is read once a block: write it before.
    """
    c = F.col
    rows = items.withColumns({"channel": F.coalesce(F.get("topics", 0), F.lit("tech")), "read": F.greatest("minutes", F.lit(1)), "taste": F.coalesce("affinity", F.lit(0.0))}).withColumn("grp", text.group_of(c("channel")))
    hero = rows.agg(F.count("*").alias("items"), (F.sum("read") / 60).alias("hours"), F.percentile("read", F.lit(0.5)).alias("median"), F.count_distinct("channel").alias("channels"), F.count_distinct("source").alias("sources"), F.count_if(c("read") >= 5).alias("long_reads"), F.max("published_s").alias("newest_s"))
    facts = hero.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c(k).cast("double").alias("x")) for k in hero.columns))).alias("f"))
    weeks = weekly(rows).unpivot("week", list(v.GROUPS), "grp", "n")
    boxes = box(rows, "source_type", "read").unpivot("source_type", [c(p).cast("double").alias(p) for p in ("lo", "q1", "median", "q3", "hi")], "point", "x")
    tally = lambda by: rows.groupBy(by).agg(F.count("*").alias("n"))
    writers = rows.where(F.trim("author") != "").groupBy(F.trim("author").alias("author")).agg(F.count("*").alias("n"))
    return _stacked([
        _block("hero", facts, c("f.k"), x=c("f.x")),
        _block("cooccurrence", cooccurrence(rows), c("a"), c("b"), c("n")),
        _block("cluster", cluster_summary(rows), c("cluster_id"), c("channel"), c("size"), c("best")),
        _block("scatter", rows, c("id"), c("channel"), c("read"), c("taste")),
        _block("read_bin", histogram(rows, c("read"), 2, 30), c("bin"), n=c("n")),
        _block("week", weeks, c("week"), c("grp"), c("n")),
        _block("box", boxes, c("source_type"), c("point"), x=c("x")),
        _block("channel", per_channel(rows, "taste"), c("channel"), text.group_of(c("channel")), c("n"), c("mean")),
        _block("source_type", tally("source_type"), c("source_type"), n=c("n")),
        _block("top_source", tally("source").orderBy(F.desc("n"), "source").limit(sources), c("source"), n=c("n")),
        _block("top_author", writers.orderBy(F.desc("n"), "author").limit(authors), c("author"), n=c("n")),
        _block("top_item", rows.orderBy(F.desc("taste"), "id").limit(best), c("id"), c("channel"), c("read"), c("taste")),
        _block("trust_bin", histogram(rows, c("trust"), 0.1, 10), c("bin"), n=c("n")),
    ])


def bundle(items: DataFrame, registry: DataFrame, reads: DataFrame, top: int = 150) -> DataFrame:
    """What a writer is given, as rows (block, k1, k2, n, x).

    From scored items (with snippet and cluster_id), sources (id, type, channel, trust, enabled) and earlier reads (id, title): meta
    (numbers of all of these and of what is included), channel (items), type (sources), covered (channels that have a source), source
    (its type, whether it is enabled, trust), cluster (size, score), digest (the `top` best liked items with snippet and place),
    and read.
    """
    c = F.col
    liked = items.select("id", "snippet", F.coalesce("affinity", F.lit(0.0)).alias("taste")).orderBy(F.desc("taste"), "id").limit(top)
    channels = items.select(F.explode("topics").alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))
    stories = items.groupBy("cluster_id").agg(F.count("*").alias("n"), (F.sum("total") + F.log10(1 + F.count("*"))).alias("score"))
    numbers = {"items": items, "included": liked, "clusters": stories, "channels": channels, "sources": registry, "reads": reads}
    meta = [_block("meta", df.agg(F.count("*").alias("n")), F.lit(k), n=c("n")) for k, df in numbers.items()]
    return _stacked([
        *meta,
        _block("channel", channels, c("channel"), n=c("n")),
        _block("type", registry.groupBy("type").agg(F.count("*").alias("n")), c("type"), n=c("n")),
        _block("covered", registry.where("channel is not null").select("channel").distinct(), c("channel")),
        _block("source", registry, c("id"), c("type"), c("enabled").cast("int"), c("trust")),
        _block("cluster", stories, c("cluster_id"), n=c("n"), x=c("score")),
        _block("digest", liked, c("id"), c("snippet"), x=c("taste")),
        _block("read", reads, c("id"), c("title")),
    ])


def compare_counts(live: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Full outer join of two count maps; a side that lacks a key counts zero."""
    a, b = live.select(F.col(key), F.col("n").alias("live")), snapshot.select(F.col(key), F.col("n").alias("snapshot"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("snapshot", F.lit(0)).alias("snapshot"))


def channel_gaps(registry: DataFrame, channels: DataFrame, least: int = 2) -> DataFrame:
    """Per channel, from sources (channel, type, status, enabled): how many are enabled, how many failures have disabled, the types that
    were lost with them (sorted), and whether too few are left; channels without sources are kept."""
    lost = ~F.col("enabled") & (F.col("status") == "disabled")
    counts = registry.groupBy("channel").agg(F.count_if("enabled").alias("enabled"), F.count_if(lost).alias("disabled"), F.array_sort(F.collect_set(F.when(lost, F.col("type")))).alias("lost_types"))
    rows = channels.join(counts, "channel", "left").na.fill(0, ["enabled", "disabled"])
    return rows.withColumns({"lost_types": F.coalesce("lost_types", F.array().cast("array<string>")), "underserved": F.col("enabled") < least})


def spread(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Adds weight: the values spread evenly between low and high, the middle if all are equal."""
    ends = F.broadcast(rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    w = F.when(F.col("__lo") == F.col("__hi"), (low + high) / 2).otherwise(low + (high - low) * (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return rows.crossJoin(ends).withColumn("weight", w).drop("__lo", "__hi")
