"""Benchmark decontamination on templates.

Numbers, names and units become typed placeholders (neighbours of one kind become one), so a question with other
values keeps its template. Each text is read three times: with names inside sentences as placeholders, with no names
(so that case doesn't matter), and with names that open sentences too. Windows of template tokens are hash-joined
within a reading; a document holds an item where enough of the item's windows lie on one diagonal and the values in
its slots stand for the item's values one to one, or enough windows have the item's own values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import _LOWER, Rolling, Workspace, chunks, mix, randoms, string_buffers, text_of, words

#: Template tokens in a window; shorter items are one window. A window needs half as many literal words.
WINDOW = 8
#: A document holds an item if this share of its windows, or a run of this many of its tokens, is matched.
SHARE, RUN = 0.5, 13
#: Distinct window hashes of the benchmark (8 bytes each) that may be broadcast as a filter.
BROADCAST_WINDOWS = 2_000_000
# fixed values: units of measure, lower case
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l s min h ms hz khz mhz ghz kb mb gb tb w kw v a k c f n j pa bar usd eur gbp meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters inch inches foot feet yard yards mile miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degrees".split()
# fixed values: words that open sentences and are no names, lower case
OPENERS = "a about after all also although an and another any are as at because before both but by can could did do does during each every few find first for from given had has have he her here his how however if in is it its let many more most much my no not now of on one or our she should since so some suppose than that the their then there these they this those though to under until was we were what when where whether which while who whose why will with without would you your".split()
#: Names inside sentences, no names at all, names that open sentences too.
READINGS = 3
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = randoms(4, 11)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;")] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1 (two bytes in UTF-8, the first C3) in lower case."""
    out = _LOWER[data]
    out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    return out


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(_lower(data)).spans(starts, ends)


def _sorted_hashes(listed: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(listed).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return np.sort(_hash_words(data, starts, ends))


def templates(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each reading template tokens, kinds (0 word, 1 number, 2 name, 3 unit), values of the slots, which words are
    names that the reading takes as words, and each row's first token.

    A word is stripped of ASCII punctuation and lower-cased; words of punctuation alone don't count. Words with a digit
    are numbers; units of measure behind a number are units. Names are capitalised words within a sentence in the first
    reading, none in the second, and also those that open a sentence and are not of OPENERS in the third.
    """
    starts, ends, row = words(data, at)
    solid = np.flatnonzero(_PLAIN[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    keep = high > low
    owner = np.repeat(np.arange(len(at) - 1), np.diff(row))[keep]
    raw_starts, raw_ends = starts[keep], ends[keep]
    starts, ends = solid[low[keep]], solid[high[keep] - 1] + 1
    n = len(starts)
    first_token = np.searchsorted(owner, np.arange(len(at)))
    if not n:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, bool), first_token)] * READINGS
    value = _hash_words(data, starts, ends)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    little = (data >= 97) & (data < 123)
    little[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x9F)
    small = np.concatenate([[0], np.cumsum(little)])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(n, bool)  # the first word of a sentence, line or row
    opens[1:] = (owner[1:] != owner[:-1]) | _ENDS[data[raw_ends[:-1] - 1]] | (lines[raw_starts[1:]] > lines[raw_ends[:-1]])
    number = digits[ends] > digits[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = (data[starts] >= 65) & (data[starts] <= 90) | (data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    proper = capital & ~number & (small[ends] > small[np.minimum(starts + 1 + (data[starts] == 0xC3), ends)])
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & (owner[1:] == owner[:-1]) & np.isin(value[1:], _sorted_hashes(UNITS)) & ~number[1:]
    opening = proper & opens
    opening[opening] = ~np.isin(value[opening], _sorted_hashes(OPENERS))
    inside = proper & ~opens
    return [_reading(value, owner, np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8), inside | opening, len(at)) for name in (inside, np.zeros(n, bool), inside | opening)]


def _reading(value: np.ndarray, owner: np.ndarray, kind: np.ndarray, names: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    again = np.zeros(len(kind), bool)
    again[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & (owner[1:] == owner[:-1])
    head = np.flatnonzero(~again)
    value = mix(np.add.reduceat(value * np.where(again, _MARK[0], np.uint64(1)), head))
    kind, owner, names = kind[head], owner[head], names[head]
    token = np.where(kind > 0, _MARK[kind], value)
    return token, kind, mix(value + _MARK[kind]), names & (kind == 0), np.searchsorted(owner, np.arange(rows))


def _pattern(slots: np.ndarray) -> int:
    """A hash of where each slot's value stands first, so of which slots of an item are equal."""
    _, first, place = np.unique(slots, return_index=True, return_inverse=True)
    x = first[place].astype(np.uint64)
    return int(mix(np.sum((x + np.uint64(1)) * randoms(len(x), 13), keepdims=True, dtype=np.uint64))[0].view(np.int64))


def _window_rows(sizes: list[int], wanted: np.ndarray | None) -> Callable:
    """Windows of the given sizes (those among the sorted wanted hashes, or all); items have one size, given by theirs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            none = np.zeros(0, np.int64)
            out: list[tuple[np.ndarray, ...]] = [(none,) * 10]
            for reading, (token, kind, value, names, first) in enumerate(templates(*string_buffers(batch.column(batch.schema.get_field_index("body"))))):
                literal, named = (np.concatenate([[0], np.cumsum(x)]) for x in (kind == 0, names))
                count = np.diff(first)
                owner = np.repeat(np.arange(len(count)), count)
                patterns = np.zeros(len(count), np.int64) if sizes else np.array([_pattern(value[a:b][kind[a:b] > 0]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.int64)
                for size in sizes or sorted({min(WINDOW, int(c)) for c in count if c}):
                    n = len(token) - size + 1
                    if n <= 0:
                        continue
                    rolled = np.full(n, size + (reading << 8), np.uint64)
                    for i, factor in enumerate(randoms(size, 12)):
                        rolled += token[i : i + n] * factor
                    rolled = mix(rolled)
                    good = (owner[:n] == owner[size - 1 :]) & (literal[size:] - literal[:n] >= max(1, size // 2))
                    if not sizes:
                        good &= np.minimum(count[owner[:n]], WINDOW) == size
                    if wanted is not None and len(wanted):
                        i = np.minimum(np.searchsorted(wanted, rolled), len(wanted) - 1)
                        good &= wanted[i] == rolled
                    elif wanted is not None:
                        good[:] = False
                    j = np.flatnonzero(good)
                    o, cells = owner[j], j[:, None] + np.arange(size)
                    slots = kind[cells] > 0
                    out.append((o, rolled[j].view(np.int64), j - first[o], value[cells][slots].view(np.int64), slots.sum(1), np.full(len(j), size), count[o], np.full(len(j), reading), patterns[o], named[j + size] > named[j]))
            row, hashes, place, values, each, size, tokens, reading, pattern, some = (np.concatenate(x) for x in zip(*out, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(row, pa.int64())).columns, pa.array(hashes, pa.int64()), pa.array(place, pa.int64()), lists, pa.array(size, pa.int32()), pa.array(tokens, pa.int64()), pa.array(reading, pa.int32()), pa.array(pattern, pa.int64()), pa.array(some.astype(bool))], ["id", "fp", "hash", "place", "slots", "size", "tokens", "reading", "pattern", "named"])

    return rows


_WINDOWS = "id bigint, fp bigint, hash bigint, place bigint, slots array<bigint>, size int, tokens bigint, reading int, pattern bigint, named boolean"


def _shapes(windows: DataFrame) -> DataFrame:
    return windows.groupBy("id", "fp", "reading", "pattern").agg(F.sum(F.xxhash64("place", "hash").cast("decimal(38,0)")).alias("shape"), F.count("*").alias("windows"))


def template_classes(benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per item with a window and reading: id, reading (0 to 2), class_id.

    class_id is the smallest id of the items with the same template and pattern of equal slots in that reading; a
    document reported for the one holds them all. Items without windows (empty, nearly all placeholders) have no row.
    """
    items = benchmark.select(F.col(item_column).cast("bigint").alias("id"), text_of(item_text).alias("body")).withColumn("fp", F.xxhash64("body"))
    shape = Workspace(benchmark.sparkSession).write(_shapes(items.select("id", "fp", "body").mapInArrow(_window_rows([], None), _WINDOWS)), "shapes")
    key = ["reading", "pattern", "shape", "windows"]
    return shape.join(shape.groupBy(*key).agg(F.min("id").alias("class_id")), key).select(F.col("id").alias(item_column), "reading", "class_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and template of the benchmark that it holds.

    Returns id, fp (xxhash64 of the text), item_id (the smallest of the items with that template and the same pattern
    of equal slots), matched_windows, item_windows, matched_tokens, n_slots, n_items (how many items are in that class,
    see template_classes), of the reading and diagonal that match best. Where slots contradict each other, the windows that have the item's own values count by themselves, if there
    are values in them. Null or empty texts hold nothing, and empty items are held by nothing; rows that repeat an id
    and its text give one row; items whose words are nearly all placeholders have no window. Rows with null ids are looked at and reported with a null id.
    """
    spark = docs.sparkSession
    space = Workspace(spark)
    items = benchmark.select(F.col(item_column).cast("bigint").alias("id"), text_of(item_text).alias("body")).withColumn("fp", F.xxhash64("body"))
    all_windows = space.write(items.select("id", "fp", "body").mapInArrow(_window_rows([], None), _WINDOWS), "item_windows")
    # items with one template and one pattern of equal slots are one class of a reading, named as in the first reading
    shape = _shapes(all_windows)
    classes = shape.groupBy("reading", "pattern", "shape", "windows").agg(F.min(F.struct("id", "fp")).alias("c"), F.count_distinct("id").alias("n_items"))
    names = shape.where("reading = 0").join(classes, ["reading", "pattern", "shape", "windows"]).select("id", "fp", F.col("c.id").alias("item_id"))
    classes = classes.select("c.id", "c.fp", "reading", "n_items", F.col("windows").alias("item_windows")).join(names, ["id", "fp"], "left").distinct()
    windows = space.write(all_windows.join(classes, ["id", "fp", "reading"]).select("reading", F.col("id").alias("held_id"), F.coalesce("item_id", "id").alias("item_id"), "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "size", F.col("tokens").alias("item_tokens"), "item_windows", "n_items", F.col("named").alias("item_named")).distinct(), "classes")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW values at most
    hashes = windows.select("hash").distinct()
    few = hashes.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    wanted = np.sort(np.array([r["hash"] for r in hashes.collect()], np.int64).view(np.uint64)) if few else None
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), text_of(text_column).alias("body")).withColumn("fp", F.xxhash64("body"))
    found = rows.select("id", "fp", "body").mapInArrow(_window_rows(sizes or [WINDOW], wanted), _WINDOWS).drop("tokens", "size", "reading", "pattern")
    met = found.join(windows, "hash").withColumn("diagonal", F.col("place") - F.col("item_place"))
    pairs = F.arrays_zip(F.col("slots").alias("d"), F.col("item_slots").alias("i"))
    same = F.col("slots") == F.col("item_slots")
    on = met.groupBy("id", "fp", "reading", "held_id", "item_id", "item_windows", "n_items", "item_tokens", "size", "diagonal").agg(F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs"), F.collect_set(F.when(same, F.col("item_place"))).alias("same_places"), F.array_distinct(F.flatten(F.collect_list(F.when(same, pairs)))).alias("same_pairs"), F.max(F.when(same, F.col("named") | F.col("item_named"))).alias("same_named"), F.max(F.col("named") | F.col("item_named")).alias("any_named"))
    one_to_one = (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.d")))) & (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.i"))))
    # the second reading decides only where it matches names as words: else the others see at least as much
    proof = F.when(F.col("reading") == 1, F.when(F.col("fits"), F.col("any_named")).otherwise(F.col("same_named"))).otherwise(F.col("fits") | (F.size("same_pairs") > 0))
    on = on.withColumn("fits", one_to_one).where(proof)
    on = on.withColumns({"places": F.when(F.col("fits"), F.col("places")).otherwise(F.col("same_places")), "pairs": F.when(F.col("fits"), F.col("pairs")).otherwise(F.col("same_pairs"))})
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    on = on.withColumns({"matched_windows": F.size("places"), "matched_tokens": covered, "n_slots": F.size("pairs")})
    on = on.where((F.col("matched_windows") >= SHARE * F.col("item_windows")) | (F.col("matched_tokens") >= RUN))
    best = on.groupBy("id", "fp", "item_id").agg(F.max(F.struct("matched_windows", "matched_tokens", "n_slots", "item_windows", "n_items")).alias("b"))
    return best.select(F.col("id").alias(id_column), "fp", "item_id", *(F.col(f"b.{c}").cast("bigint").alias(c) for c in ("matched_windows", "item_windows", "matched_tokens", "n_slots", "n_items")))
