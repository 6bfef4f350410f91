"""An interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map.

Files in the shared folder, cut into as many pieces as the session shuffles to:
  words   sorted 64-bit word hashes with counts; a word's id is its rank
  pairs   sorted (previous id, id) with counts, owned by the previous word, or by both words where that one is frequent
  tables  per id: how often it is a context, the mass its context keeps for lower order, how many words come before it
Tasks map the files and look up sorted queries, so only the pages they touch are read. Everything grows with the
corpus; nothing but the pieces' names and sums passes through the driver.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, add_up, chunks, mix, shards, store_of, string_buffers, text_of, word_hashes

#: The end of a text is a word of its own.
END = mix(np.array([0x656E64], np.uint64))[0]
_CHUNK = 1 << 20
#: Entries a task gathers before it sends them on.
_HELD = 2_000_000
_PIECE = "piece int, keys binary, counts binary"
_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(x: np.ndarray) -> bytes:
    return len(x.tobytes()).to_bytes(8, "little") + _ZSTD.compress(x.tobytes(), asbytes=True)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True), kind)


# files of arrays in the shared folder -------------------------------------------------------------------------------

_MAPPED: dict[str, np.ndarray] = {}
#: Bytes of pieces from a store without local files that a worker holds in memory; the oldest go first.
_HELD_BYTES = 256 << 20
_READ: OrderedDict[str, np.ndarray] = OrderedDict()


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays under a new name (each attempt of a task has its own) and returns it."""
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    for kind, x in arrays.items():
        with store.open_output_stream(f"{path}/{name}.{kind}", compression=None) as out:
            out.write(memoryview(np.ascontiguousarray(x)).cast("B") if len(x) else b"")
    return name


def mapped(folder: str, name: str, kind: str, dtype: str) -> np.ndarray:
    """A saved array, memory-mapped; from a store without local files, read into a bounded part of memory."""
    from pyarrow import fs

    key = f"{folder}/{name}.{kind}"
    if key in _MAPPED:
        return _MAPPED[key]
    if key in _READ:
        _READ.move_to_end(key)
        return _READ[key]
    store, path = store_of(folder)
    file = f"{path}/{name}.{kind}"
    if isinstance(store, fs.LocalFileSystem):
        _MAPPED[key] = np.memmap(file, dtype, "r") if os.path.getsize(file) else np.zeros(0, dtype)
        return _MAPPED[key]
    with store.open_input_file(file) as f:
        _READ[key] = np.frombuffer(f.read(), dtype)
    while len(_READ) > 1 and sum(x.nbytes for x in _READ.values()) > _HELD_BYTES:
        _READ.popitem(last=False)
    return _READ[key]


# counting -----------------------------------------------------------------------------------------------------------


def _piece_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def tokens(batch: pa.RecordBatch, column: str = "body") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text with END behind them, all in a row, and the texts' offsets."""
    hashes, row = word_hashes(*string_buffers(batch.column(column)))
    n = np.diff(row)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(at[-1], END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes
    return out, at


class _Gather:
    """Adds up (key, count) chunk by chunk and cuts the sums into pieces before they outgrow memory."""

    def __init__(self, piece: Callable[[np.ndarray], np.ndarray], n: int):
        self.piece, self.n, self.keys, self.counts, self.size = piece, n, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > 2 * _HELD:
            k, c = add_up(self.keys, self.counts)
            self.keys, self.counts, self.size = [k], [c], len(k)
            if self.size > _HELD:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        k, c = add_up(self.keys, self.counts)
        self.keys, self.counts, self.size = [], [], 0
        piece = self.piece(k)
        order = np.argsort(piece, kind="stable")
        cuts = np.searchsorted(piece[order], np.arange(self.n + 1))
        for p in range(self.n):
            if cuts[p + 1] > cuts[p]:
                part = order[cuts[p] : cuts[p + 1]]
                yield p, k[part], c[part]


def _rows(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for p, k, c in found:
        # high halves ascend, so their differences pack well
        high, low = (k >> np.uint64(32)).astype("<u4"), k.astype("<u4")
        keys = _pack(np.concatenate([np.diff(high, prepend=np.uint32(0)), low]))
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p], pa.int32()), "keys": [keys], "counts": [_pack(c.astype("<u4"))]})


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for k, c in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
        both = _unpack(k, "<u4")
        n = len(both) // 2
        keys.append(np.cumsum(both[:n], dtype=np.uint32).astype(np.uint64) << np.uint64(32) | both[n:])
        counts.append(_unpack(c, "<u4").astype(np.int64))
    return add_up(keys, counts)


def _count_words(n: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(lambda k: _piece_of(k, n), n)
        for batch in chunks(batches, "body", _CHUNK):
            yield from _rows(gather.add(tokens(batch)[0]))
        yield from _rows(gather.flush())

    return count


def _save_words(folder: str) -> Callable:
    def keep(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        return pa.table({"piece": table["piece"][:1], "name": [save(folder, {"keys": keys, "counts": counts})], "n": [len(keys)], "total": [int(counts.sum())]})

    return keep


@dataclass
class Words:
    """The vocabulary: piece p has the ids base[p] to base[p + 1]; id V is the place before a text's first word."""

    folder: str
    names: list[str | None]
    base: list[int]
    total: int

    @property
    def size(self) -> int:
        return self.base[-1]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(_piece_of(hashes, len(self.names)), np.arange(len(self.names) + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            part, name = slice(cuts[p], cuts[p + 1]), self.names[p]
            if name and len(keys := mapped(self.folder, name, "keys", "<u8")):
                i = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
                hit = keys[i] == hashes[part]
                out[part] = np.where(hit, i + self.base[p], -1)
                count[part] = np.where(hit, mapped(self.folder, name, "counts", "<i8")[i], 0)
        return out, count


def _pair_piece(pairs: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
    """The owner: by the first word, or by both if the first is among the frequent ones (sorted ids, at most 4 * n)."""
    first = pairs >> np.uint64(32)
    i = np.minimum(np.searchsorted(often, first), max(0, len(often) - 1))
    hot = often[i] == first if len(often) else np.zeros(len(pairs), bool)
    return (mix(np.where(hot, pairs, first)) % np.uint64(n)).astype(np.int64)


def _id_pairs(words: Words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Previous ids, ids, counts of the words, and the texts' offsets."""
    hashes, at = tokens(batch)
    unique, inverse = np.unique(hashes, return_inverse=True)
    ids, counts = words.ids(unique)
    ids, counts = ids[inverse], counts[inverse]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1]] = words.size
    return before, ids, counts, at


def _count_pairs(words: Words, often: np.ndarray, n: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(lambda k: _pair_piece(k, often, n), n)
        for batch in chunks(batches, "body", _CHUNK):
            before, ids, _, _ = _id_pairs(words, batch)
            yield from _rows(gather.add(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)))
        yield from _rows(gather.flush())

    return count


_STAT = "kind string, owner int, name string, body binary"


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype("<i8")


def _save_pairs(folder: str, ids: int, n: int) -> Callable:
    def keep(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        name = save(folder, {"keys": keys, "counts": counts.astype("<u4")})
        out = [("meta", table["piece"][0].as_py(), name, _frequencies(counts).tobytes())]
        first = (keys >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x, at).astype("<i8") if len(at) else np.zeros(0, "<i8") for x in (counts, counts == 1, counts == 2, counts > 2)]
        follow, ways = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        for kind, who, columns in (("context", first[at], sums), ("ways", follow.astype(np.int64), [ways.astype("<i8")])):
            owner = who * n // ids
            cuts = np.searchsorted(owner, np.arange(n + 1))
            for o in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[o], cuts[o + 1])
                out.append((kind, o, "", _pack(np.concatenate([np.diff(who[part], prepend=0).astype("<i8"), *(c[part] for c in columns)]))))
        return pa.table(dict(zip(("kind", "owner", "name", "body"), (pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)), strict=True)))

    return keep


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more from how many counts are 1 to 4; fixed ones where those are too few."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _save_tables(folder: str, ids: int, n: int, off: tuple[float, float, float]) -> Callable:
    def keep(table: pa.Table) -> pa.Table:
        o = table["owner"][0].as_py()
        low, high = -(-(o * ids) // n), -(-((o + 1) * ids) // n)
        sums = np.zeros((4, high - low), np.int64)
        ways = np.zeros(high - low, np.int64)
        for kind, body in zip(table["kind"].to_pylist(), table["body"].to_pylist(), strict=True):
            x = _unpack(body, "<i8").reshape(5 if kind == "context" else 2, -1)
            who = np.cumsum(x[0]) - low
            if kind == "context":
                sums[:, who] += x[1:]
            else:
                ways[who] += x[1]
        kept = (off[0] * sums[1] + off[1] * sums[2] + off[2] * sums[3]) / np.maximum(sums[0], 1)
        name = save(folder, {"total": sums[0], "kept": kept.astype("<f8"), "ways": ways})
        found = ways[ways > 0]
        return pa.table({"kind": ["table"], "owner": pa.array([o], pa.int32()), "name": [name], "body": [np.concatenate([_frequencies(found), [found.sum(), len(found), (found > 2).sum()]]).astype("<i8").tobytes()]})

    return keep


@dataclass
class Model:
    """Names of the model's files and the few numbers that hold for all of it."""

    words: Words
    often: np.ndarray
    pairs: list[str | None]
    tables: list[str | None]
    pair_off: tuple[float, float, float]
    word_off: tuple[float, float, float]
    all_ways: int
    word_kept: float
    n_train: int

    def _of_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, kept mass and ways of ids (any order; negative: unknown)."""
        n, size = len(self.tables), self.words.size + 1
        u, inverse = np.unique(ids, return_inverse=True)
        total, kept, ways = np.zeros(len(u)), np.ones(len(u)), np.zeros(len(u))
        owner = np.where(u < 0, -1, u * n // size)
        cuts = np.searchsorted(owner, np.arange(n + 1))
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            if self.tables[o]:
                part = slice(cuts[o], cuts[o + 1])
                i = u[part] - -(-(o * size) // n)
                total[part], kept[part], ways[part] = (self._file("tables", o, k)[i] for k in ("total", "kept", "ways"))
        return total[inverse], kept[inverse], ways[inverse]

    def _file(self, group: str, piece: int, kind: str) -> np.ndarray:
        dtype = {"keys": "<u8", "counts": "<u4", "total": "<i8", "kept": "<f8", "ways": "<i8"}[kind]
        return mapped(self.words.folder, getattr(self, group)[piece], kind, dtype)

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        u, inverse = np.unique(pairs, return_inverse=True)
        out = np.zeros(len(u), np.int64)
        piece = _pair_piece(u, self.often, len(self.pairs))
        order = np.argsort(piece, kind="stable")
        cuts = np.searchsorted(piece[order], np.arange(len(self.pairs) + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            if self.pairs[p]:
                part = order[cuts[p] : cuts[p + 1]]
                keys = self._file("pairs", p, "keys")
                i = np.minimum(np.searchsorted(keys, u[part]), len(keys) - 1)
                out[part] = np.where(keys[i] == u[part], self._file("pairs", p, "counts")[i], 0)
        return out[inverse]

    def log10(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 P(id | before), interpolated down to the even share of each word and of unknown ones."""
        total, kept, _ = self._of_ids(before)
        _, _, ways = self._of_ids(ids)
        p = self.word_kept / (self.words.size + 1)
        if self.all_ways:
            p = p + np.maximum(ways - _off(ways, self.word_off), 0) / self.all_ways
        count = np.zeros(len(ids), np.int64)
        known = (before >= 0) & (ids >= 0)
        count[known] = self.pair_counts(before[known].astype(np.uint64) << np.uint64(32) | ids[known].astype(np.uint64))
        top = np.maximum(count - _off(count, self.pair_off), 0) / np.maximum(total, 1)
        return np.log10(np.where(total > 0, top + kept * p, p))


def _off(counts: np.ndarray, off: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *off])[np.minimum(counts, 3).astype(np.int64)]


def _by_piece(rows: list, n: int, key: str = "piece") -> list[str | None]:
    names: list[str | None] = [None] * n
    for r in rows:
        names[r[key]] = r["name"]
    return names


def train(texts: DataFrame, space: Workspace) -> Model:
    """texts: one string column, body. The files lie in the workspace's folder. An empty table gives an even model."""
    n, folder = shards(texts), space.folder("model")
    counted = texts.mapInArrow(_count_words(n), _PIECE).groupBy("piece").applyInArrow(_save_words(folder), "piece int, name string, n bigint, total bigint")
    meta = sorted(space.write(counted, "words").collect())  # a row a piece
    size = {r["piece"]: r["n"] for r in meta}
    base = np.concatenate([[0], np.cumsum([size.get(p, 0) for p in range(n)])]).tolist()
    words = Words(folder, _by_piece(meta, n), base, sum(r["total"] for r in meta))
    # words so frequent as contexts that one piece would have too much of them: 4 * n at most
    often = texts.sparkSession.createDataFrame([(r["piece"], r["name"]) for r in meta], "piece int, name string").repartition(n, "piece").mapInArrow(_frequent(folder, base, words.total / (4 * n)), "id bigint") if meta else None
    often = np.array(sorted([r["id"] for r in often.collect()] if meta else []) + [words.size], np.uint64)
    pairs = texts.mapInArrow(_count_pairs(words, often, n), _PIECE).groupBy("piece").applyInArrow(_save_pairs(folder, words.size + 1, n), _STAT)
    pairs = space.write(pairs, "pairs")
    meta = pairs.where("kind = 'meta'").collect()
    pair_off = discounts(sum((np.frombuffer(r["body"], "<i8") for r in meta), np.zeros(4, np.int64)))
    tables = space.write(pairs.where("kind <> 'meta'").groupBy("owner").applyInArrow(_save_tables(folder, words.size + 1, n, pair_off), _STAT), "tables")
    found = tables.collect()
    sums = sum((np.frombuffer(r["body"], "<i8") for r in found), np.zeros(7, np.int64))
    word_off = discounts(sums[:4])
    kept = (word_off[0] * sums[0] + word_off[1] * sums[1] + word_off[2] * sums[6]) / max(1, sums[4])
    space.drop("pairs")
    return Model(words, often, _by_piece(meta, n, "owner"), _by_piece(found, n, "owner"), pair_off, word_off, int(sums[4]), float(kept) if sums[4] else 1.0, words.total)


def _frequent(folder: str, base: list[int], least: float) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hit = np.flatnonzero(mapped(folder, r["name"], "counts", "<i8") > least)
                yield pa.RecordBatch.from_arrays([pa.array(hit + base[r["piece"]])], ["id"])

    return find


def _score(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words
        for batch in chunks(batches, "body", _CHUNK):
            before, ids, counts, at = _id_pairs(words, batch)
            sums = [np.add.reduceat(x, at[:-1]) for x in (np.log10((counts + 0.5) / (words.total + 0.5 * (words.size + 1))), model.log10(before, ids), counts > 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(at) - 1, words.total, np.int64)), pa.array(sums[0]), pa.array(sums[1])], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_texts(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Trains on the rows where held_out is false and scores all rows of docs.

    Returns id, held_out, n_tokens (words and one end), n_known (tokens that training has), train_tokens, base_score
    (smoothed unigram), score (log10 probability by the model) and perplexity. Null texts are empty; rows that repeat
    an id are scored each by itself and count as often as they come. With no training rows all words are unknown.
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), held_out.alias("held_out"), text_of(text_column).alias("body"))
    model = train(rows.where("not held_out").select("body"), space)
    kind = docs.schema[id_column].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_column)
