"""Entity resolution, taste, ranking and selection of items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions import scoring, sources, text
from feedloom.operators.graph import Workspace, components, small


# entity resolution --------------------------------------------------------------------------------------------------


def title_sessions(items: DataFrame, hours: int = v.SAME_TITLE_HOURS) -> DataFrame:
    """Adds key (normalised title) and session: items of one title whose gaps are at most `hours` share one.

    The closure of "same title and at most `hours` apart" is a split of the sorted times at larger gaps. Items of one
    title in one time slot of that width are never split, so the slots' first and last times, summed before the
    shuffle, are all that has to be sorted, however common a title is. Blank titles and null times have no session.
    """
    width = hours * 3600
    keyed = items.withColumns({"key": text.normalise_title(F.col("title")), "slot": F.floor(F.col("published_s") / width)})
    slots = keyed.where("key <> '' and slot is not null").groupBy("key", "slot").agg(F.min("published_s").alias("lo"), F.max("published_s").alias("hi"))
    w = Window.partitionBy("key").orderBy("slot")
    far = F.coalesce((F.col("lo") - F.lag("hi").over(w) > width).cast("int"), F.lit(0))
    numbered = slots.withColumn("far", far).withColumn("session", F.sum("far").over(w)).select("key", "slot", "session")
    # written first, so that the join can split a title that very many items share
    numbered = Workspace(items.sparkSession).write(numbered, "sessions")
    return keyed.join(numbered, ["key", "slot"], "left").drop("slot")


def duplicate_groups(items: DataFrame) -> DataFrame:
    """Adds group, the least ord of the items connected by title sessions or by URL."""
    space = Workspace(items.sparkSession)
    sessions = space.write(title_sessions(items.select("ord", "url", "title", "published_s")).select("ord", "url", "key", "session"), "keyed")
    titles = space.write(sessions.where("session is not null").groupBy("key", "session").agg(F.min("ord").alias("b")), "titles")
    urls = space.write(sessions.where("url is not null").groupBy("url").agg(F.min("ord").alias("b")), "urls")
    links = sessions.join(titles, ["key", "session"]).select(F.col("ord").alias("a"), "b").union(sessions.join(urls, "url").select(F.col("ord").alias("a"), "b"))
    named = space.write(components(items.sparkSession, space, links), "named")
    return items.join(named.withColumnRenamed("node", "ord"), "ord", "left").withColumn("group", F.coalesce("component", "ord")).drop("component")


def representatives(grouped: DataFrame) -> DataFrame:
    """One item a group: full text first, then the longer (n_plain), the more trusted, the more active, the smaller id.

    The representative keeps its own fields; topics and entities are united, its own first; metrics are the greatest of
    the group.
    """
    plain = F.col("n_plain")
    rank = F.struct((plain <= v.FULL_TEXT_CHARS).alias("short"), (-plain).alias("length"), (-F.coalesce("trust", F.lit(0.5))).alias("trust"), (-(F.coalesce("score", F.lit(0)) + F.coalesce("comments", F.lit(0)))).alias("volume"), F.col("id").alias("i"))
    # one by one: the sets are the vocabularies at most, however large the group
    sets = {c: grouped.select("group", F.explode(c).alias("t")).groupBy("group").agg(F.array_sort(F.collect_set("t")).alias(f"all_{c}")) for c in ("topics", "entities")}
    own = [c for c in grouped.columns if c not in ("score", "comments", "group")]
    best = grouped.withColumns({"rank": rank, "own": F.struct(*own)}).groupBy("group").agg(F.min_by("own", "rank").alias("own"), F.max("score").alias("score"), F.max("comments").alias("comments"), F.count("*").alias("size"), F.min("ord").alias("first"))
    none = F.array().cast("array<string>")
    joined = best.select("group", "own.*", "score", "comments", "size", "first").join(sets["topics"], "group", "left").join(sets["entities"], "group", "left")
    return joined.withColumns({c: F.array_distinct(F.concat(c, F.coalesce(f"all_{c}", none))) for c in sets}).drop("group", *(f"all_{c}" for c in sets))


def title_classes(items: DataFrame) -> DataFrame:
    """(ord, words, c): the items with title words; items of one word set share c, the least ord of them."""
    sets = items.select("ord", F.array_sort(text.title_tokens(F.col("title"))).alias("words")).where(F.size("words") > 0)
    classes = Workspace(items.sparkSession).write(sets.groupBy("words").agg(F.min("ord").alias("c")), "classes")
    return sets.join(classes, "words")


def story_links(items: DataFrame, threshold: float = v.TITLE_JACCARD, shared: int = v.SHARED_ENTITIES) -> DataFrame:
    """(x, y, kind): links whose components are the stories. Items of one story by definition are linked by them.

    title: pairs x < y of classes of equal title word sets, named by their least ord, with a Jaccard similarity of at
    least threshold; member: an item and its class; entities: an item and the least ord of those that have the same
    `shared` entities. Groups of copies are thus stars and never opened into pairs. Rare words come first in a class's
    prefix; classes meet on prefix words whose places leave room for the similarity, and are compared there and then.
    """
    members, prefix = title_prefixes(items, threshold)
    met = like_titles(prefix, prefix, F.col("a.c") < F.col("b.c"), threshold)
    near = met.select(F.col("a.c").alias("x"), F.col("b.c").alias("y"), F.lit("title").alias("kind")).distinct()
    return near.union(_member_links(members)).union(entity_links(items, shared))


def _member_links(members: DataFrame) -> DataFrame:
    return members.where("ord <> c").select(F.col("c").alias("x"), F.col("ord").alias("y"), F.lit("member").alias("kind"))


def title_prefixes(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The items in their classes of titles, and (c, n, words, at, w): each class with the words w that it can meet its likes on."""
    space = Workspace(items.sparkSession)
    members = space.write(title_classes(items), "members")
    classes = members.where("ord = c").select("c", "words")
    worded = classes.select("c", F.size("words").alias("n"), F.explode("words").alias("w"))
    often = space.write(worded.groupBy("w").agg(F.count("*").alias("df")), "often")
    # prefix length: n - ceil(threshold * n) + 1
    ordered = worded.join(often, "w").groupBy("c", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("words"))
    stop = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    return members, space.write(ordered.select("c", "n", "words", F.posexplode(F.slice("words", 1, stop)).alias("at", "w")), "prefix")


def like_titles(a: DataFrame, b: DataFrame, which: Column, threshold: float) -> DataFrame:
    """Rows of a and of b (as a and b) whose titles are alike, of the pairs that `which` admits."""
    a, b = a.alias("a"), b.alias("b")
    # the first common word of a pair stands before all others they share
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    need = threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9
    both = F.size(F.array_intersect("a.words", "b.words"))
    return a.join(b, (F.col("a.w") == F.col("b.w")) & which & (room >= need)).where(both >= threshold * (F.col("a.n") + F.col("b.n") - both) - 1e-9)


def title_bridges(prefix: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the components of `known` (node, component) that like titles connect; classes without one are their own.

    What is connected already is not compared again. A word's rows are split: those of the component that most of them
    are in meet only the others, so a word within one component has no pairs, however many titles have it.
    """
    space = Workspace(prefix.sparkSession)
    based = space.write(prefix.join(known.withColumnRenamed("node", "c"), "c", "left").withColumn("base", F.coalesce("component", "c")).drop("component"), "based")
    most = based.groupBy("w", "base").agg(F.count("*").alias("k")).groupBy("w").agg(F.max_by("base", F.struct("k", "base")).alias("main"), F.count("*").alias("bases")).where("bases > 1").drop("bases")
    mixed = space.write(based.join(most, "w"), "mixed")
    apart = (F.col("a.base") != F.col("b.base")) & ((F.col("b.base") == F.col("b.main")) | (F.col("a.c") < F.col("b.c")))
    return like_titles(mixed.where("base <> main"), mixed, apart, threshold).select(F.col("a.base").alias("a"), F.col("b.base").alias("b")).distinct()


def story_components(items: DataFrame, threshold: float = v.TITLE_JACCARD, shared: int = v.SHARED_ENTITIES) -> DataFrame:
    """(node, component): the components of all story_links. Equal titles and entities first, then like titles between what is left."""
    spark, space = items.sparkSession, Workspace(items.sparkSession)
    members, prefix = title_prefixes(items, threshold)
    links = _member_links(members).union(entity_links(items, shared)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    known = space.write(components(spark, space, links, "known"), "known")
    bridged = space.write(components(spark, space, title_bridges(prefix, known, threshold), "bridged"), "bases").select(F.col("node").alias("base"), F.col("component").alias("least"))
    nodes = known.select("node", F.col("component").alias("base"))
    # ends of bridges that nothing else links
    alone = bridged.select(F.col("base").alias("node"), "base").join(known.select("node"), "node", "left_anti")
    return nodes.union(alone).join(bridged, "base", "left").select("node", F.coalesce("least", "base").alias("component"))


def _entity_keys(items: DataFrame, shared: int) -> DataFrame:
    """(ord, k): the entities of an item, or all pairs of them (p < r)."""
    sets = items.select("ord", F.array_sort(F.array_distinct("entities")).alias("e"))
    if shared == 1:
        return sets.select("ord", F.explode("e").alias("k"))
    pairs = F.flatten(F.transform("e", lambda p: F.transform(F.filter("e", lambda r: r > p), lambda r: F.struct(p.alias("p"), r.alias("r")))))
    return sets.select("ord", F.explode(pairs).alias("k"))


def entity_classes(items: DataFrame, shared: int = v.SHARED_ENTITIES) -> DataFrame:
    """(ord, k, first, n): the items that share an entity, or a pair of them, as classes k of n items, first being the least ord.

    Two items are linked by entities when they are in one class; a class is never opened into pairs.
    """
    keyed = _entity_keys(items, shared)
    classes = Workspace(items.sparkSession).write(keyed.groupBy("k").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1"), "entity-classes")
    return keyed.join(classes, "k").select("ord", "k", "first", "n")


def entity_links(items: DataFrame, shared: int = v.SHARED_ENTITIES) -> DataFrame:
    """(x, y, kind): each item and the least ord of those that share the same `shared` (1 or 2) entities with it."""
    return entity_classes(items, shared).where("ord <> first").select(F.col("first").alias("x"), F.col("ord").alias("y"), F.lit("entities").alias("kind")).distinct()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, cluster_id, cluster_size) from rows sorted by component and id; ids are hashed as they stream by."""
    component, sha, n = None, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"component": pa.array([component], pa.int64()), "cluster_id": [sha.hexdigest()[:12]], "cluster_size": pa.array([n], pa.int64())})

    for batch in batches:
        for c, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n and c == component:
                sha.update(b"|")
            else:
                if n:
                    yield row()
                component, sha, n = c, hashlib.sha1(usedforsecurity=False), 0
            sha.update(i.encode())
            n += 1
    if n:
        yield row()


def story_clusters(items: DataFrame) -> DataFrame:
    """Adds cluster_id, the hash of the sorted ids of the items whose titles or entities connect, and cluster_size."""
    space = Workspace(items.sparkSession)
    slim = items.select("ord", "id", "title", "entities")
    named = story_components(slim)
    placed = space.write(slim.select("ord", "id").join(named.withColumnRenamed("node", "ord"), "ord"), "placed")
    # a story's ids pass one task, which holds none of them
    dealt = placed.select("component", "id").repartition("component").sortWithinPartitions("component", "id")
    stories = space.write(dealt.mapInArrow(_digests, "component bigint, cluster_id string, cluster_size bigint"), "stories")
    clusters = placed.join(stories, "component").select("ord", "cluster_id", "cluster_size")
    alone = F.substring(F.sha1(F.col("id").cast("binary")), 1, 12)
    return items.join(clusters, "ord", "left").withColumns({"cluster_id": F.coalesce("cluster_id", alone), "cluster_size": F.coalesce("cluster_size", F.lit(1))})


# taste --------------------------------------------------------------------------------------------------------------


def gate(events: DataFrame, min_events: int = v.MIN_EVENTS, min_days: int = v.MIN_DAYS) -> DataFrame:
    """One row: n_events, span_days, ready, events_needed, days_needed, over all events, joined or not."""
    span = F.coalesce((F.max("at_s") - F.min("at_s")) / float(v.DAY), F.lit(0.0))
    g = events.agg(F.count("*").alias("n_events"), span.alias("span_days"))
    return g.withColumns({"ready": (F.col("n_events") >= min_events) & (F.col("span_days") >= min_days), "events_needed": F.greatest(F.lit(0), min_events - F.col("n_events")), "days_needed": F.greatest(F.lit(0.0), min_days - F.col("span_days"))})


def _normalised(sums: DataFrame, *kind: str) -> DataFrame:
    """v as a share of the greatest (of its kind). The greatest are a row a kind."""
    top = sums.groupBy(*kind).agg(F.max("v").alias("top"))
    both = sums.join(F.broadcast(top), list(kind)) if kind else sums.crossJoin(F.broadcast(top))
    return both.where("top > 0").withColumn("v", F.col("v") / F.col("top")).drop("top")


def taste_profile(events: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """(kind, term, v): decayed engagement by topic and by entity, the greatest of each kind being 1.

    Empty until the gate is ready. Ages aren't clamped.
    """
    weight = scoring.event_weight(F.col("type"), F.col("dwell_ms")) * scoring.decay((F.lit(now) - F.col("at_s")) / float(v.DAY))
    by_item = events.withColumn("w", weight).groupBy("item_id").agg(F.sum("w").alias("w"))
    return profile_of(by_item.join(F.broadcast(gate(events).where("ready").select("ready"))).drop("ready"), items)


def profile_of(by_item: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, term, v) from the weight of each item's engagement (item_id, w)."""

    def named(kind: str, column: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term")))

    terms = F.concat(named("topic", "topics"), named("entity", "entities"))
    joined = by_item.join(items.select(F.col("id").alias("item_id"), terms.alias("ts")), "item_id")
    sums = joined.select(F.explode("ts").alias("t"), "w").groupBy("t.kind", "t.term").agg(F.sum("w").alias("v"))
    return _normalised(sums, "kind")


def format_affinity(events: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """(format, v): engagement shared equally by the distinct formats of an item's channels; ages clamped at 0."""
    spark = events.sparkSession
    served = F.broadcast(spark.createDataFrame([(c, f) for f, cs in v.FORMATS.items() for c in cs], "channel string, format string"))
    kinds = F.when(F.col("type") == "open", 1.0).when(F.col("type") == "read", 3.0).otherwise(2.0)
    by_item = events.withColumn("w", kinds * scoring.decay(F.greatest((F.lit(now) - F.col("at_s")) / float(v.DAY), F.lit(0.0)))).groupBy("item_id").agg(F.sum("w").alias("w"))
    formats = items.select(F.col("id").alias("item_id"), F.explode("topics").alias("channel")).join(served, "channel").select("item_id", "format").distinct()
    counted = formats.groupBy("item_id").agg(F.count("*").alias("n"))
    sums = by_item.join(formats, "item_id").join(counted, "item_id").groupBy("format").agg(F.sum(F.col("w") / F.col("n")).alias("v"))
    return _normalised(sums)


#: Rows of a profile (a topic or an entity each) that may be broadcast; more are joined by a shuffle.
PROFILE_ROWS = 100_000


def affinity(items: DataFrame, profile: DataFrame) -> DataFrame:
    """(id, liked): the mean liking of an item's topics plus that of its entities; items without any have no row."""
    terms = [items.select("id", F.explode(c).alias("term"), F.size(c).alias("n"), F.lit(k).alias("kind")) for k, c in (("topic", "topics"), ("entity", "entities"))]
    return terms[0].union(terms[1]).join(small(profile, PROFILE_ROWS), ["kind", "term"]).groupBy("id").agg(F.sum(F.col("v") / F.col("n")).alias("liked"))


def score_items(items: DataFrame, profile: DataFrame, now: int, **tuning: Any) -> DataFrame:
    """Adds the seven terms and total to items with cluster_size (and n_plain and minutes for their bodies). tuning: as of the terms."""
    rows = items.join(affinity(items, profile), "id", "left")
    terms = scoring.contributions(now, F.col("cluster_size"), F.coalesce("liked", F.lit(0.0)), **tuning)
    return rows.withColumns(terms).withColumn("total", sum((F.col(t) for t in scoring.TERMS[1:]), F.col(scoring.TERMS[0]))).drop("liked")


# ranking and selection ------------------------------------------------------------------------------------------------

def by_total() -> list[Column]:
    return [F.desc("total"), F.col("id")]


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """All rows with their place from 0 in the order, which must have no ties.

    Rows are dealt by ranges of the order and numbered within their range as they are written; the ranges' sizes (a row
    each) give what is to be added.
    """
    space = Workspace(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = space.write(dealt, "dealt").withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("before") + F.col("__at")).drop("__part", "__at", "before")


def top(scored: DataFrame, n: int) -> DataFrame:
    """The best n by total with their place: a top-k, so no task sorts all rows."""
    best = scored.orderBy(*by_total()).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*by_total())) - 1)


def diversity_floor(listed: DataFrame) -> DataFrame:
    """Promotes videos, then audio, from behind the list's window until it has enough of each; places are numbered anew.

    A few rows at most are promoted; all others move by how many of those stood behind them.
    """
    for kind in ("video", "audio"):
        stop = F.least(F.lit(v.FEATURED + v.LIST_WINDOW), F.col("n_rows"))
        inside = (F.col("place") >= v.FEATURED) & (F.col("kind") == kind)
        have = listed.where(F.col("place") < v.FEATURED + v.LIST_WINDOW).agg(F.count_if(inside).alias("have"), F.count("*").alias("n_rows"))
        late = listed.where((F.col("place") >= v.FEATURED + v.LIST_WINDOW) & (F.col("kind") == kind)).orderBy(F.desc("total"), "place").limit(v.MIN_PER_MEDIUM)
        late = late.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("t"), "place"))), lambda x: x["place"]).alias("late"))
        moves = have.crossJoin(late).select(stop.alias("stop"), F.slice("late", 1, F.greatest(F.lit(0), v.MIN_PER_MEDIUM - F.col("have")).cast("int")).alias("late"))
        p = F.col("place")
        behind = F.size(F.filter("late", lambda x: x > p))
        new = F.when(F.array_contains("late", p), F.col("stop") - F.size("late") + F.array_position("late", p) - 1).when(p >= F.col("stop") - F.size("late"), p + behind).otherwise(p)
        listed = listed.crossJoin(F.broadcast(moves)).withColumn("place", new.cast("bigint")).drop("late", "stop")
    return listed


def balanced(scored: DataFrame, n: int) -> DataFrame:
    """n of the scored items, the best as feature, the others dealt evenly over primary channels (n a channel suffice)."""
    rows = scored.withColumn("channel", F.get("topics", 0))
    best = rows.orderBy(*by_total()).limit(1).select(F.col("id").alias("feature"), F.col("channel").alias("feature_channel"))
    rest = rows.join(F.broadcast(best), F.col("id") != F.col("feature")).where("channel is not null")
    body = rest.withColumn("nth", F.row_number().over(Window.partitionBy("channel").orderBy(*by_total()))).where(F.col("nth") <= n)
    w = Window.partitionBy("channel")
    body = body.withColumns({"turn": F.col("nth") + F.coalesce(F.col("channel") == F.col("feature_channel"), F.lit(False)).cast("int"), "lead": F.max("total").over(w), "lead_id": F.min_by("id", "nth").over(w)})
    first = rows.join(F.broadcast(best), F.col("id") == F.col("feature")).withColumns({"nth": F.lit(0), "turn": F.lit(0), "lead": F.col("total"), "lead_id": F.col("id")})
    pick = F.row_number().over(Window.orderBy("turn", F.desc("lead"), "lead_id")) - 1
    return first.unionByName(body).withColumn("pick", pick).where(F.col("pick") < n).drop("turn", "lead", "lead_id", "nth", "feature", "feature_channel")


def one_per_source(scored: DataFrame, n: int, slack: int = 2) -> DataFrame:
    """Each source's best, n at most; a list that is short by at most `slack` is filled up with the next best of all."""
    key = F.struct((-F.col("total")).alias("t"), F.col("id").alias("i"))
    best = scored.groupBy("source").agg(F.min(key).alias("b")).select(F.col("b.i").alias("id"))
    first = scored.join(best, "id", "left_semi").orderBy(*by_total()).limit(n).withColumn("late", F.lit(0))
    more = scored.join(best, "id", "left_anti").orderBy(*by_total()).limit(slack).withColumn("late", F.lit(1))
    short = F.broadcast(best.limit(n).agg((n - F.count("*")).alias("__short")))  # one row
    more = more.crossJoin(short).where(F.col("__short") <= slack).drop("__short")
    return first.unionByName(more).orderBy("late", *by_total()).limit(n).drop("late")


def featured(scored: DataFrame, n: int = v.FEATURED) -> DataFrame:
    """The ids of the best n whose body takes enough minutes: what the front page features."""
    return scored.where(F.col("minutes") >= v.FEATURE_MINUTES).orderBy(*by_total()).limit(n).select("id")


def maker(sources: list[str]) -> Column:
    """Is an item a maker's, by its source or by a channel that is hardware for sure?"""
    return F.coalesce(F.col("source").isin(sources), F.lit(False)) | F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, v.HARD_CHANNELS))), F.lit(False))


def substantial(items: DataFrame, makers: list[str] | None = None) -> DataFrame:
    """Items with a full text that takes long enough to read: five minutes, or three for makers."""
    long = (F.col("minutes") >= v.MIN_READ_MINUTES) | (F.col("minutes") >= v.MAKER_READ_MINUTES) & maker(v.MAKER_SOURCES if makers is None else makers)
    return items.where((F.col("n_plain") > v.FULL_TEXT_CHARS) & long)


def curate(items: DataFrame, events: DataFrame, now: int, makers: list[str] | None = None) -> DataFrame:
    """The curated feed: all items that stay, with place, total, its terms, cluster_id and cluster_size.

    Duplicates are one item before stories are told; then the gates; taste and the sizes of stories are those of what is
    left; all of it is ranked, and videos and audio come forward where the list has too few.
    """
    space = Workspace(items.sparkSession)
    once = space.write(representatives(duplicate_groups(items)).drop("size", "first"), "once")
    kept = space.write(substantial(story_clusters(once), makers).drop("cluster_size"), "kept")
    sizes = kept.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    profile = space.write(taste_profile(events, kept, now), "profile")
    return diversity_floor(ranked(score_items(kept.join(sizes, "cluster_id"), profile, now), by_total()))


def rerank(items: DataFrame, profile: DataFrame, now: int, *, least_minutes: int = 0, channels: list[str] | None = None, group: str | None = None, diverse: bool = True, **tuning: Any) -> DataFrame:
    """A feed by a reader's own weights, gates and filters: items (with cluster_id) with their terms, total and place.

    least_minutes: the shortest read; channels: primary channels, group: a group of channels, of which items may be
    (None or empty: any); stories are as large as what is left of them; diverse: bring videos and audio forward.
    tuning: weights (by term; the others keep theirs), peak, sigma and half_life.
    """
    primary = F.get("topics", 0)
    keep = F.col("minutes") >= least_minutes
    if channels:
        keep &= F.coalesce(primary.isin(channels), F.lit(False))
    if group:
        keep &= text.group_of(primary) == group
    kept = Workspace(items.sparkSession).write(items.where(keep).drop("cluster_size"), "kept")
    sizes = kept.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    order = ranked(score_items(kept.join(sizes, "cluster_id"), profile, now, **tuning), by_total())
    return diversity_floor(order) if diverse else order


def front_page(listed: DataFrame) -> DataFrame:
    """(section, rail, id, pos) of the front page from the ranked feed (place, total, and url, title, kind, minutes, n_plain).

    Shorts, raw clips and short texts go; what has no text stays. featured: the balanced block; category: each channel's
    longer reads behind it, if there are enough; watch and listen: videos that can be shown and audio, one a source;
    register: all that is not featured, in order.
    """
    space = Workspace(listed.sparkSession)
    junk = sources.is_short(F.coalesce("url", F.lit(""))) | sources.is_junk_video(F.col("kind"), F.coalesce("title", F.lit("")))
    every = space.write(listed.where(~F.coalesce(junk, F.lit(False)) & ((F.col("n_plain") == 0) | (F.col("minutes") >= v.MIN_READ_MINUTES))), "every")
    block = space.write(balanced(every.where(F.col("minutes") >= v.FEATURE_MINUTES), v.FRONT_FEATURED).select("id", "pick"), "block")
    rest = space.write(every.join(F.broadcast(block.select("id")), "id", "left_anti"), "rest")
    part = lambda df, section, rail, pos: df.select(F.lit(section).alias("section"), rail.alias("rail"), "id", pos.cast("bigint").alias("pos"))
    none = F.lit(None).cast("string")
    read = rest.where((F.col("minutes") >= v.MIN_READ_MINUTES) & F.get("topics", 0).isNotNull()).select("id", "place", F.get("topics", 0).alias("rail"))
    rows = ranked(read, [F.col("rail"), F.col("place")], "at")
    first = F.broadcast(rows.groupBy("rail").agg(F.min("at").alias("first"), F.count("*").alias("n")).where(F.col("rail").isin(v.CHANNELS) & (F.col("n") >= v.ROW_LEAST)))  # a row a channel
    category = part(rows.join(first, "rail"), "category", F.col("rail"), F.col("at") - F.col("first"))
    numbered = lambda df: df.withColumn("pos", F.row_number().over(Window.orderBy(*by_total())) - 1)  # noqa: E731  a dozen rows
    watch = numbered(one_per_source(rest.where((F.col("kind") == "video") & sources.video_id(F.col("url")).isNotNull()), v.WATCH))
    listen = numbered(one_per_source(rest.where("kind = 'audio'"), v.LISTEN))
    register = ranked(rest.select("id", "place"), [F.col("place")], "at")
    return part(block, "featured", none, F.col("pick")).union(category).union(part(watch, "watch", none, F.col("pos"))).union(part(listen, "listen", none, F.col("pos"))).union(part(register, "register", none, F.col("at")))


# archive --------------------------------------------------------------------------------------------------------------


def upsert(existing: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """All rows of fresh and the rows of existing whose key is not in it."""
    return fresh.unionByName(existing.join(fresh.select(key), key, "left_anti"))


def archive(existing: DataFrame, fresh: DataFrame, now: int | None, days: int = v.ARCHIVE_DAYS) -> DataFrame:
    """The merged archive: dated items of the last `days`, without bodies; without a clock nothing is too old."""
    rows = upsert(existing, fresh).where("published_s is not null")
    if now is not None:
        rows = rows.where(F.col("published_s") >= now - max(0, days) * v.DAY)
    return archived(rows)


def archived(rows: DataFrame) -> DataFrame:
    """Items as the archive has them: a clean summary, no body."""
    return rows.withColumn("summary", text.clean_summary(F.col("body"))).drop("body")
