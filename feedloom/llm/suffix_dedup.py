"""Removal of repeated long substrings by longest-previous-factor arrays over sampled suffixes.

A full suffix array of a corpus would weigh eight bytes and a deep sort per byte. Here each window of `length` bytes
names one anchor in it, its least k-gram, so equal windows have equal anchors at equal distances. Anchors whose k-gram
occurs once rule out all their windows. Of the others, anchors with equal surroundings are one context with a count, and
the contexts of one k-gram are that part of the suffix order in which their windows can meet: the suffixes from the
anchors on are sorted by their bytes, and the suffixes that start one byte earlier follow from that order by one stable
sort on that byte (with the lengths of common prefixes), until the first window is reached. In each of these orders the
previous and next smaller positions give a suffix's longest previous factor; windows whose factor reaches `length` have
an earlier copy (the same on negated positions: a later one).

Texts that occur several times are one text with a count before all this. Contexts of a k-gram with very many different
surroundings are split by the windows' distance from the anchor, each half again named by the bytes all its windows
share, until the groups are small; at the end a group is a single window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import _GOLD, Rolling, Workspace, chunks, mix, small, string_buffers, text_of

LENGTH = 400
GRAM = 100
#: Contexts of one group (up to 2 * LENGTH bytes each) that may meet in one task.
GROUP = 1000
#: Repeated k-grams or texts (16 bytes and a count each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_BLOCK = 4 << 20
_ANCHORS = "id bigint, fp binary, n bigint, lo int, hi int, at int, gram bigint, around bigint"
_CONTEXTS = "key bigint, around bigint, id bigint, fp binary, n bigint, place int, reach int, context binary"
_HALVES = "parent bigint, parent_around bigint, shift int, " + _CONTEXTS
_FOUND = "key bigint, around bigint, fp binary, place int, start int, stop int"
_TOP = np.uint64(0xFFFFFFFF00000000)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width`, from minima over blocks forwards and backwards."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window, anchor (all from the row's start), k-gram hash and hash of the surroundings."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    roll = Rolling(data)
    grams = roll.grams(gram)
    # the order of k-grams has 32 bits of the hash, then the place: leftmost among equals, alike in every text
    keys = (grams & _TOP) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, length - gram + 1)
    inside = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(at) >= length)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(windows):
        return none
    place = (least[windows] & ~_TOP).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    lo, hi, p = windows[first], windows[np.append(first[1:], len(windows)) - 1], place[first]
    around = mix(roll.spans(lo, hi + length) ^ mix((p - lo).astype(np.uint64) * _GOLD + (hi - lo).astype(np.uint64)))
    row = np.searchsorted(at, lo, "right") - 1
    return row, lo - at[row], hi - at[row], p - at[row], grams[p], around


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _anchor_rows(length: int, gram: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            row, lo, hi, p, g, around = anchors(*string_buffers(batch.column("body")), length, gram)
            own = batch.select(["id", "fp", "n"]).take(pa.array(row)).columns
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int32()) for x in (lo, hi, p)), pa.array(g.view(np.int64)), pa.array(around.view(np.int64))], _fields(_ANCHORS))

    return rows


def suffix_orders(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, order, lcp) for d = 0, 1 and so on: the suffixes that start d bytes before the anchors, group by group.

    left and right: how many bytes a context has before its anchor, and from it on; group: ascending numbers. A context
    takes part up to d = left. lcp: how many bytes a suffix has in common with the one before it in the order, within
    both contexts; 0 at the start of a group.
    """
    if not len(anchor):
        return
    width = int(right.max())
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    ahead = np.empty((len(anchor), width + 4), np.uint8)
    ahead[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    ahead[:, 4:] = np.lib.stride_tricks.sliding_window_view(padded, width)[anchor]
    ahead[:, 4:][np.arange(width) >= right[:, None]] = 0
    # a suffix that ends stands before those that go on, also if they go on with zero bytes
    by_end = np.argsort(right, kind="stable")
    order = by_end[np.argsort(ahead[by_end].view(f"S{width + 4}").ravel(), kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    differ = ahead[order[1:]] != ahead[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 4) - 4
    lcp[1:] = np.maximum(0, np.minimum(common, np.minimum(right[order[1:]], right[order[:-1]])))
    yield 0, order, lcp
    for d in range(1, int(left.max()) + 1):
        old = np.flatnonzero(left[order] >= d)
        key = group[order[old]] << 8 | data[anchor[order[old]] - d]
        turn = np.argsort(key, kind="stable")
        old, key = old[turn], key[turn]
        same = np.flatnonzero(key[1:] == key[:-1])
        longer = np.zeros(len(old), np.int64)
        if len(same):
            # the least common prefix on the way from the one to the other
            ends = np.stack([old[same] + 1, old[same + 1] + 1], 1).ravel()
            longer[same + 1] = np.minimum.reduceat(np.append(lcp, 0), ends)[::2] + 1
        order, lcp = order[old], longer
        yield d, order, lcp


def longest_factors(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in order: the most bytes that each has in common with one of smaller position; 0 where below least.

    That one is the previous or the next smaller position in suffix order. Each suffix looks at its neighbour and, as
    long as the position there is not smaller, goes on to where that neighbour has got to.
    """
    best = np.zeros(len(position), np.int64)
    for turned in (False, True):
        p = position[::-1] if turned else position
        common = np.concatenate([[0], lcp[:0:-1]]) if turned else lcp.copy()
        seen = np.arange(len(p)) - 1
        going = np.flatnonzero(common >= least)
        while len(going := going[(common[going] >= least) & (p[seen[going]] >= p[going])]):
            next_common, next_seen = np.minimum(common[going], common[seen[going]]), seen[seen[going]]
            common[going], seen[going] = next_common, next_seen
        found = np.where(common >= least, common, 0)
        best = np.maximum(best, found[::-1] if turned else found)
    return best


def copied_windows(data: np.ndarray, at: np.ndarray, reach: np.ndarray, group: np.ndarray, position: np.ndarray, weight: np.ndarray, length: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(context, window from its start) of the windows that have an earlier copy, or any copy without keep_first.

    at: where the contexts' bytes start and end; reach: the anchor in them; weight: how many places a context stands for.
    """
    right = np.diff(at) - reach
    several = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d, order, lcp in suffix_orders(data, (at[:-1] + reach)[several], reach[several], right[several], group[several]):
        met = lcp >= length
        met[:-1] |= met[1:]
        order, lcp = several[order[met]], lcp[met]
        factors = longest_factors(position[order], lcp, length)
        if not keep_first:
            factors = np.maximum(factors, longest_factors(-position[order], lcp, length))
        cut = order[factors >= length]
        who.append(cut)
        where.append(reach[cut] - d)
    if not keep_first:
        heavy = np.flatnonzero(weight > 1)
        windows = np.diff(at)[heavy] - length + 1
        who.append(np.repeat(heavy, windows))
        where.append(np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    return np.concatenate(who), np.concatenate(where)


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about `most` bytes of contexts from rows sorted by key; a key's rows are never in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, (_, at) = batch.column("key").to_numpy(), string_buffers(batch.column("context"))
        goes_on = bool(held) and held[-1].column("key")[-1].as_py() == keys[0]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        block = (at[start] + sum(b.nbytes for b in held)) // most
        if goes_on:
            block[start == 0] = 0
        cuts = np.flatnonzero(np.diff(block)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and block[low] > 0:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _match(length: int, keep_first: bool) -> Callable:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, _BLOCK):
            data, at = string_buffers(table["context"])
            keys = table["key"].to_numpy()
            group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
            prints = np.frombuffer(string_buffers(table["fp"])[0].tobytes(), ">u8").reshape(-1, 2)
            columns = (table["place"].to_numpy(), prints[:, 1], prints[:, 0], table["id"].to_numpy())
            turn = np.lexsort(columns)
            position = np.empty(len(turn), np.int64)
            position[turn] = np.cumsum(np.concatenate([[False], np.any([c[turn][1:] != c[turn][:-1] for c in columns], axis=0)]))
            who, where = copied_windows(data, at, table["reach"].to_numpy().astype(np.int64), group, position, table["n"].to_numpy(), length, keep_first)
            turn = np.lexsort((where, who))
            who, where = who[turn], where[turn]
            first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (np.diff(where) > 1)])) if len(who) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(who)) - 1 if len(who) else first
            own = table.select(["key", "around", "fp", "place"]).take(pa.array(who[first])).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns), pa.array(where[first], pa.int32()), pa.array(where[last] + length, pa.int32())], _fields(_FOUND))

    return match


def _halve(length: int, size: int) -> Callable:
    """Parts of contexts whose windows start in one range of `size` distances from the anchor, with the range's key."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "context", _BLOCK):
            data, at = string_buffers(batch.column("context"))
            reach = batch.column("reach").to_numpy().astype(np.int64)
            roll, p = Rolling(data), at[:-1] + reach
            near, far = reach - (np.diff(at) - length), reach
            for number in range(int(near.min()) // size, int(far.max()) // size + 1):
                low, high = np.maximum(near, number * size), np.minimum(far, (number + 1) * size - 1)
                rows = np.flatnonzero(low <= high)
                if not len(rows):
                    continue
                low, high, q = low[rows], high[rows], p[rows]
                core = roll.spans(q - number * size, q - (number + 1) * size + 1 + length)
                key = mix(core + batch.column("key").to_numpy().view(np.uint64)[rows] * _GOLD + np.uint64(number))
                around = mix(roll.spans(q - high, q - low + length) ^ mix(high.astype(np.uint64) * _GOLD + low.astype(np.uint64)))
                shift = far[rows] - high
                context = pa.array([data[a:b].tobytes() for a, b in zip((q - high).tolist(), (q - low + length).tolist(), strict=True)], pa.binary())
                own = batch.take(pa.array(rows))
                place = own.column("place").to_numpy() + shift
                yield pa.RecordBatch.from_arrays(
                    [own.column("key"), own.column("around"), pa.array(shift, pa.int32()), pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), own.column("id"), own.column("fp"), own.column("n"), pa.array(place, pa.int32()), pa.array(high, pa.int32()), context],
                    _fields(_HALVES),
                )

    return halve


def _repeats(space: Workspace, met: DataFrame, length: int, size: int, keep_first: bool) -> DataFrame:
    """Runs of copied windows of the contexts in met (written): in the context's bytes, as (key, around, start, stop).

    With keep_first also fp and place, for one row a context stands for its first place alone.
    """
    crowded = space.write(met.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > GROUP).select("key"), f"crowded-{size}")
    if size == 1 or not crowded.limit(1).count():
        return met.repartition("key").sortWithinPartitions("key").mapInArrow(_match(length, keep_first), _FOUND)
    crowded = small(crowded, BROADCAST_ROWS)
    found = met.join(crowded, "key", "left_anti").select(*_fields(_CONTEXTS)).repartition("key").sortWithinPartitions("key").mapInArrow(_match(length, keep_first), _FOUND)
    halves = space.write(met.join(crowded, "key", "left_semi").select(*_fields(_CONTEXTS)).mapInArrow(_halve(length, size // 2), _HALVES), f"halves-{size}")
    first = F.min(F.struct("id", "fp", "place", "reach", "context")).alias("first")
    parts = space.write(halves.groupBy("key", "around").agg(F.sum("n").alias("n"), first).select("key", "around", "first.id", "first.fp", "n", *(f"first.{x}" for x in ("place", "reach", "context"))), f"parts-{size}")
    again = space.write(_repeats(space, parts, length, size // 2, keep_first), f"again-{size}")
    if keep_first:
        names = parts.select("key", "around", *(F.col(x).alias(f"first_{x}") for x in ("fp", "place")))
        later = halves.join(names, ["key", "around"]).where((F.col("fp") != F.col("first_fp")) | (F.col("place") != F.col("first_place")))
        return found.union(again).union(later.select("key", "around", "fp", "place", F.lit(0).alias("start"), F.octet_length("context").alias("stop")))
    back = halves.select("key", "around", "fp", "place", "shift", F.col("parent").alias("p"), F.col("parent_around").alias("a")).join(again.select("key", "around", "start", "stop"), ["key", "around"])
    return found.union(back.select(F.col("p").alias("key"), F.col("a").alias("around"), "fp", "place", F.col("start") + F.col("shift"), F.col("stop") + F.col("shift")))


def merge_spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what the spans cover; spans that touch are one run."""
    order = np.argsort(starts)
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    return starts[new], stops[np.append(np.flatnonzero(new)[1:], len(new)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    for batch in chunks(batches, "body", 8 << 20):
        data, at = string_buffers(batch.column("body"))
        spans, kept = [], []
        for i, found in enumerate(batch.column("found").to_pylist()):
            body = data[at[i] : at[i + 1]]
            if found:
                a, b = merge_spans(np.array([x["start"] for x in found]), np.array([x["stop"] for x in found]))
                spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                kept.append(b"".join(body[x:y].tobytes() for x, y in zip([0, *b.tolist()], [*a.tolist(), len(body)], strict=True)))
            else:
                spans.append([])
                kept.append(body.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, spans (maximal removed runs of bytes), kept (the other bytes).

    Texts are UTF-8 bytes; null is empty. With keep_first, bytes covered by a string of `length` bytes that starts
    earlier too (in order of id, then place) go; else those covered by one that starts anywhere else. Texts below
    `length` bytes lose nothing. Rows that repeat an id and its text count as copies of one another, and keep alike;
    null ids come first. Windows are compared byte by byte; k-grams, equal surroundings and equal texts by hashes of 64,
    64 and 128 bits.
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("true_id"), F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63))).alias("id"), text_of(text_column).alias("body")).withColumn("fp", F.unhex(F.md5("body")))
    prints = rows.where(F.octet_length("body") >= length).groupBy("fp").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    rows = rows.join(small(space.write(prints.where("copies > 1"), "copies"), BROADCAST_ROWS), "fp", "left")
    # of equal texts the first stands for all
    texts = rows.where((F.octet_length("body") >= length) & (F.col("least").isNull() | (F.col("id") == F.col("least")))).select("id", "fp", F.coalesce("copies", F.lit(1)).alias("n"), "body")
    found = space.write(texts.mapInArrow(_anchor_rows(length, gram), _ANCHORS), "anchors")
    # written first: a join against a table can split a frequent k-gram, one against an aggregation cannot
    often = space.write(found.groupBy("gram").agg(F.sum("n").alias("total")).where("total > 1").select("gram"), "often")
    again = space.write(found.join(small(often, BROADCAST_ROWS), "gram").withColumnRenamed("gram", "key"), "again")
    space.drop("anchors")
    contexts = again.groupBy("key", "around").agg(F.sum("n").alias("n"), F.min(F.struct("id", "fp", "lo", "hi", "at")).alias("first"))
    contexts = space.write(contexts.select("key", "around", "n", "first.*"), "contexts")
    wanted = contexts.groupBy("fp").agg(F.collect_list(F.struct("key", "around", "n", "lo", "hi", "at")).alias("w"))
    raw = F.encode("body", "UTF-8")
    read = F.transform("w", lambda w: F.struct(w["key"].alias("key"), w["around"].alias("around"), w["n"].alias("n"), w["lo"].alias("place"), (w["at"] - w["lo"]).alias("reach"), F.substring(F.col("raw"), w["lo"] + 1, w["hi"] - w["lo"] + length).alias("context")))
    met = texts.select("id", "fp", raw.alias("raw")).join(wanted, "fp").select("id", "fp", F.explode(read).alias("c")).select("c.key", "c.around", "id", "fp", "c.n", "c.place", "c.reach", "c.context")
    met = space.write(met, "surroundings")
    copied = _repeats(space, met, length, 1 << max(0, length - gram).bit_length(), keep_first)
    if keep_first:
        others = contexts.where("n > 1").select("key", "around", *(F.col(x).alias(f"first_{x}") for x in ("fp", "lo")))
        later = again.join(others, ["key", "around"]).where((F.col("fp") != F.col("first_fp")) | (F.col("lo") != F.col("first_lo")))
        spans = copied.select("fp", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop")).union(later.select("fp", F.col("lo"), F.col("hi") + length))
    else:
        copied = space.write(copied.select("key", "around", "start", "stop"), "copied")
        spans = again.join(copied, ["key", "around"]).select("fp", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("stop")).alias("stop"))
    spans = spans.select("fp", F.struct(F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")).alias("s"))
    spans = space.write(spans.groupBy("fp").agg(F.collect_set("s").alias("found")), "spans")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.octet_length("body").cast("bigint").alias("stop")))
    cut = F.when(F.col("id") != F.col("least"), whole).otherwise(F.col("found")) if keep_first else F.col("found")
    out = rows.join(spans, "fp", "left").select(F.col("true_id").alias("id"), "body", cut.alias("found")).mapInArrow(_cut, "id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_column)
