"""Shared pieces of the training-data operators: tables in the shared folder, text buffers and hashing.

All hashing here is 64-bit and depends on content alone, so every executor agrees on it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.graph import Workspace, components, shared_folder, small

__all__ = ["Rolling", "Workspace", "add_up", "chunks", "components", "merge_sorted", "mix", "randoms", "release", "shards", "shared_folder", "shingles", "small", "store_of", "string_buffers", "text_of", "word_hashes", "words"]

#: Bytes of text that a task turns into arrays at a time (a single longer text is taken whole).
CHUNK_BYTES = 1 << 19
#: Bytes of text whose index entries one piece may hold.
PIECE_BYTES = 256 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shards(texts: DataFrame, column: str = "body") -> int:
    """Pieces to deal an index of texts over: as many as the session shuffles to, or more if they hold over PIECE_BYTES each."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE_BYTES))


def release() -> None:
    """Gives freed memory back to the system, for workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed * 1000003 + 7))


_BYTE = randoms(256, 1)
_STEP = int(randoms(1, 2)[0]) | 1
_BACK = pow(_STEP, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    name = str(base)
    if name not in _TABLES or len(_TABLES[name]) < n:
        out = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _TABLES[name] = np.multiply.accumulate(out)
    return _TABLES[name][:n]


class Rolling:
    """Polynomial hashes of byte strings modulo 2**64, any substring from two prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=self.sums[1:])
        self.back = _powers(_BACK, len(data) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * _GOLD)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of text each, or one row."""
    for batch in batches:
        _, at = string_buffers(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
    release()


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row starts of the words `[^\\x20\\x09-\\x0D]+`; words never cross rows.

    at: offsets of the rows; gap: which bytes stand between words. The third array has, for each row and the end, how many words start before it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~gap[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z lower-cased, and for each row and the end how many words stand before it."""
    starts, ends, row = words(data, at)
    return Rolling(_LOWER[data]).spans(starts, ends), row


def shingles(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row's k-word shingles, one row after the other, and the rows' offsets.

    Rows with fewer words have one shingle, all their words; rows without words have none.
    """
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for i, factor in enumerate(randoms(k, 3)):
        if n > i:
            rolled[: n - i] += hashes[i:] * factor
    rolled = mix(rolled)
    count = np.diff(row)
    for j in np.flatnonzero((count > 0) & (count < k)):
        rolled[row[j]] = mix(np.sum(hashes[row[j] : row[j + 1]] * randoms(int(count[j]), 4), keepdims=True, dtype=np.uint64))[0]
    keep = np.ones(n, bool)
    for low, high in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
        if high - low >= k:
            rolled[low : high - k + 1].sort()
            keep[high - k + 1 : high] = False
        elif high > low:
            keep[low + 1 : high] = False
    same = np.zeros(n, bool)
    same[1:] = rolled[1:] == rolled[:-1]
    same[row[:-1][row[:-1] < n]] = False
    keep &= ~same
    before = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return rolled[keep], before[row]


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def merge_sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of several, each sorted and distinct, as one: neighbours are merged in pairs, nothing is sorted anew."""
    while len(parts) > 1:
        parts = [_merge_two(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _merge_two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    at = np.searchsorted(a[0], b[0])
    same = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    same &= at < len(a[0])
    counts = a[1].copy()
    counts[at[same]] += b[1][same]
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(counts, at[~same], b[1][~same])


def store_of(uri: str):
    """The file system that a task reaches a folder of the shared folder by, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
