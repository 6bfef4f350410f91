"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n (full sequences first). A piece is
a sequence of its own, so no sequence crosses documents and none has padding; equal lengths share a bucket.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import chunks, text_of

SEQUENCE = 2048
END_ID = 1
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 200_000
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
_TRAILING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"


def _byte_letters() -> dict[int, str]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts from ids of their words, each distinct word being tokenised once.

    The vocabulary never joins characters over white space, and it lower-cases, so the ids of a text are those of its
    lower-cased words in a row. A run of letters with ASCII punctuation behind it is two such units.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.units: dict[bytes, bytes] = {}  # 32-bit ids packed into bytes: a tenth of a list's memory
        self.code = _Codes(self)
        self.fresh: list[bytes] = []  # ids of words met since the last call ended
        self.pool, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.filled = self.known = 0

    def _keep_fresh(self) -> None:
        sizes = np.fromiter(map(len, self.fresh), np.int64, len(self.fresh)) // 4
        n, total = len(sizes), int(sizes.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled // 2 + 2 * total, np.uint32)])
        if self.known + n > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x[: self.known], np.zeros(self.known // 2 + 2 * n, np.int64)]) for x in (self.starts, self.sizes))
        self.pool[self.filled : self.filled + total] = np.frombuffer(b"".join(self.fresh), np.uint32)
        self.sizes[self.known : self.known + n] = sizes
        self.starts[self.known : self.known + n] = self.filled + np.cumsum(sizes) - sizes
        self.filled, self.known, self.fresh = self.filled + total, self.known + n, []

    def _whole_ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def unit(self, u: bytes) -> bytes:
        if (got := self.units.get(u)) is None:
            if u.isascii():
                s = u.decode() if u.isalpha() else ""
            else:
                s = unicodedata.normalize("NFC", u.decode("utf-8", "replace"))
                s = s.lower() if max(s) < "ƀ" else ""
                s = "".join(map(self.letters.__getitem__, s.encode())) if s.isalpha() else ""
            got = array("I", [t.id for t in self.model.tokenize(s)]).tobytes() if s else self._whole_ids(u.decode("utf-8", "replace"))
            self.units[u] = got
        return got

    def word(self, w: bytes) -> bytes:
        core = w.rstrip(_TRAILING)
        if core and len(core) < len(w) and (core[-1] in _LETTERS or core.decode("utf-8", "replace")[-1].isalpha()):
            return self.unit(core) + self.unit(w[len(core) :])
        return self.unit(w)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's with END_ID behind them, and the texts' offsets."""
        if self.known > CACHE_WORDS:
            self.forget()
        code = self.code
        end = code[b" "]  # no word has a space: it stands for the end
        flat: list[int] = []
        counts = []
        for t in texts:
            before = len(flat)
            # a text that may hold special tokens, which are matched before lower-casing, is one unit
            flat += map(code.__getitem__, t.lower().split()) if b"<|" not in t else [code[b" " + t]]
            flat.append(end)
            counts.append(len(flat) - before)
        self._keep_fresh()
        codes = np.array(flat, np.int64)
        each = self.sizes[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        out = self.pool[np.repeat(self.starts[codes] - total[:-1], each) + np.arange(total[-1])]
        return out, total[np.concatenate([[0], np.cumsum(counts)])]


class _Codes(dict):
    def __init__(self, owner: WordTokenizer):
        self.owner = owner

    def __missing__(self, w: bytes) -> int:
        if w[0] != 32:
            ids = self.owner.word(w)
        else:
            ids = self.owner._whole_ids(w[1:].decode()) if len(w) > 1 else END_ID.to_bytes(4, "little")
        self[w] = n = len(self)
        self.owner.fresh.append(ids)
        return n


_LOADED: dict[str, WordTokenizer] = {}


def binary_pieces(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths that add up to n: as many of the longest as fit, then the binary digits of the rest."""
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length() - 1)) if n % longest >> b & 1]


def _pieces(path: str, longest: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        tokenizer = _LOADED.get(path) or _LOADED.setdefault(path, WordTokenizer(path))
        for batch in chunks(batches, "body"):
            ids, at = tokenizer.ids([t.as_py().encode() for t in batch.column(1)])
            ids = ids.astype("<u4", copy=False)
            doc, start, length, total = [], [], [], []
            for i, n in enumerate(np.diff(at).tolist()):
                cuts = binary_pieces(n, longest)
                doc += [i] * len(cuts)
                length += cuts
                total += [n] * len(cuts)
                place = 0
                for c in cuts:
                    start.append(place)
                    place += c
            size = np.array(length, np.int64)
            cutpoints = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size * 4, out=cutpoints[1:])
            number = np.arange(made, made + len(size), dtype=np.int64)
            made += len(size)
            sequence = (np.log2(size).astype(np.int64) << 58) | np.int64(task << 34) | number
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(size), pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cutpoints), pa.py_buffer(ids)]), pa.array(total, pa.int64()), pa.array(sequence), pa.array(np.zeros(len(size), np.int64))],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return cut


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", longest: int = SEQUENCE) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (0).

    vocabulary: a tokenizer file that lower-cases and drops white space, at the same path on all executors. A text's
    ids end with END_ID, so null and empty texts are one piece of one token. Sequence ids are unique, and ascending
    ones go from short buckets to long ones. Rows that repeat an id are packed each by itself; null ids stay null. No
    shuffle: a lost task is made again alone, with the same ids.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))])
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("body")).mapInArrow(_pieces(vocabulary, longest), schema).withColumnRenamed("id", id_column)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the pieces with a folder for each length, from which batches of equal lengths are read."""
    pieces.write.mode("overwrite").partitionBy("length").parquet(path)
