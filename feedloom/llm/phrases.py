"""Collocations by contiguous pattern growth over occurrence pointers.

Three passes over the texts. The first counts words a language; frequent ones get ids, in files that tasks map. The
second counts pairs of neighbouring frequent words. In the third every occurrence of a frequent pair whose next pair is
frequent too becomes a pointer with the ids that growth can reach from it, as far as all pairs on the way are frequent.
Equal windows are one with a count before they are dealt by their prefix; the task that owns a prefix extends it to the
right depth-first. A prefix with a large part of all occurrences is dealt by its three-word extensions instead.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import _LOWER, Rolling, Workspace, add_up, chunks, mix, shards, small, string_buffers, text_of, words
from feedloom.llm.ngram_lm import _PIECE, Words, _by_piece, _Gather, _merged, _pack, _rows, _unpack, mapped, save
from feedloom.operators.feed import ranked

_CHUNK = 1 << 20
#: Distinct words, or windows, that a task gathers before it sends them on.
_HELD_WORDS, _HELD_WINDOWS = 300_000, 1_000_000
#: Rows of counts that may be broadcast to be looked up; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The place behind the last word that growth can reach.
_NONE = np.uint32(0xFFFFFFFF)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_GROWN = "kind string, piece int, name string, n bigint, lang string, phrase string, size int, lefts array<bigint>, a bigint"


# tokens -------------------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """Words of a batch: hashes of (language, word), their bytes, languages, and which have the next one in their piece."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    langs: list[str]
    lang: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Tokens:
        data, at = string_buffers(batch.column("body"))
        data = _LOWER[data]
        starts, ends, row = words(data, at, _GAP)
        named = batch.column("lang").dictionary_encode()
        langs = named.dictionary.to_pylist()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
        of_row = np.repeat(np.arange(batch.num_rows), np.diff(row))
        lang = named.indices.to_numpy()[of_row]
        pieces = np.concatenate([[0], np.cumsum(_BREAK[data])])[starts]
        joined = np.zeros(len(starts), bool)
        joined[:-1] = (pieces[1:] == pieces[:-1]) & (of_row[1:] == of_row[:-1])
        return cls(mix(Rolling(data).spans(starts, ends) ^ salts[lang]) if len(starts) else np.zeros(0, np.uint64), data, starts, ends, langs, lang, joined)


# words --------------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, h, n); a row without a word has the number of all words of its language."""
    known: dict[int, tuple[str, bytes]] = {}
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    every: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        k, c = add_up(keys, counts)
        for low in range(0, len(k), 50_000):
            part = k[low : low + 50_000]
            pairs = [known[h] for h in part.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([w.decode("utf-8", "replace") for _, w in pairs], pa.string()), pa.array(part.view(np.int64)), pa.array(c[low : low + 50_000])], ["lang", "word", "h", "n"])

    for batch in chunks(batches, "body", _CHUNK):
        t = Tokens.of(batch)
        u, first, c = np.unique(t.hashes, return_index=True, return_counts=True)
        raw = t.data.tobytes()
        for h, i in zip(u.tolist(), first.tolist(), strict=True):
            if h not in known:
                known[h] = (t.langs[t.lang[i]], raw[t.starts[i] : t.ends[i]])
        keys.append(u)
        counts.append(c)
        for x, n in enumerate(np.bincount(t.lang, minlength=len(t.langs)).tolist()):
            every[t.langs[x]] += n
        if sum(map(len, keys)) > 4 * _HELD_WORDS:
            keys, counts = ([x] for x in add_up(keys, counts))
        if len(known) > _HELD_WORDS:
            yield from out()
            known, keys, counts = {}, [], []
    yield from out()
    if every:
        langs, n = zip(*every.items(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(n), pa.string()), pa.array([0] * len(n), pa.int64()), pa.array(n, pa.int64())], ["lang", "word", "h", "n"])


def _save_words(folder: str) -> Callable:
    def keep(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        texts = [f"{x}\n{w}".encode() for x, w in zip(table["lang"].to_pylist(), table["word"].to_pylist(), strict=True)]
        texts = [texts[i] for i in order.tolist()]
        name = save(folder, {"keys": h[order], "counts": table["n"].to_numpy()[order].astype("<i8"), "at": np.cumsum([0, *map(len, texts)]).astype("<i8"), "text": np.frombuffer(b"".join(texts), np.uint8)})
        return pa.table({"piece": table["piece"][:1], "name": [name], "n": [len(h)]})

    return keep


class Lexicon(Words):
    """The frequent words of all languages with their counts."""

    def entries(self, ids: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """Languages, words and counts of ids (any order)."""
        langs, found, counts = [], [], np.zeros(len(ids), np.int64)
        piece = np.searchsorted(self.base, ids, "right") - 1
        for j, (p, i) in enumerate(zip(piece.tolist(), (ids - np.array(self.base)[piece]).tolist(), strict=True)):
            at = mapped(self.folder, self.names[p], "at", "<i8")
            lang, _, word = bytes(mapped(self.folder, self.names[p], "text", "|u1")[at[i] : at[i + 1]]).decode().rpartition("\n")
            langs.append(lang)
            found.append(word)
            counts[j] = mapped(self.folder, self.names[p], "counts", "<i8")[i]
        return langs, found, counts

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch's words (-1: not frequent), and which stand before a frequent one in the same piece."""
        t = Tokens.of(batch)
        unique, inverse = np.unique(t.hashes, return_inverse=True)
        ids = self.ids(unique)[0][inverse]
        joined = t.joined & (ids >= 0)
        joined[:-1] &= ids[1:] >= 0
        return ids, joined


def _phrases(lexicon: Lexicon, found: list[tuple[list[int], list[int]]]) -> dict[str, list]:
    """Columns of _GROWN for phrases given as ids and the counts of their first one, two, ... words."""
    ids = np.unique(np.array([i for p, _ in found for i in p], np.int64))
    langs, texts, _ = lexicon.entries(ids)
    lang, text = dict(zip(ids.tolist(), langs, strict=True)), dict(zip(ids.tolist(), texts, strict=True))
    return {"lang": [lang[p[0]] for p, _ in found], "phrase": [" ".join(text[i] for i in p) for p, _ in found], "size": [len(p) for p, _ in found], "lefts": [c[:-1] for _, c in found], "a": [c[-1] for _, c in found]}


def _table(kinds: dict[str, list], n: int) -> pa.Table:
    types = {"kind": pa.string(), "piece": pa.int32(), "name": pa.string(), "n": pa.int64(), "lang": pa.string(), "phrase": pa.string(), "size": pa.int32(), "lefts": pa.list_(pa.int64()), "a": pa.int64()}
    return pa.table({k: pa.array(kinds.get(k, [None] * n), t) for k, t in types.items()})


# pairs --------------------------------------------------------------------------------------------------------------


def _count_pairs(lexicon: Lexicon, n: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(lambda k: (mix(k) % np.uint64(n)).astype(np.int64), n)
        for batch in chunks(batches, "body", _CHUNK):
            ids, joined = lexicon.of(batch)
            i = np.flatnonzero(joined)
            yield from _rows(gather.add(ids[i].astype(np.uint64) << np.uint64(32) | ids[i + 1].astype(np.uint64)))
        yield from _rows(gather.flush())

    return count


def _save_pairs(lexicon: Lexicon, least: int) -> Callable:
    def keep(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        often = counts >= least
        keys, counts = keys[often], counts[often]
        name = save(lexicon.folder, {"keys": keys, "counts": counts.astype("<i8")})
        meta = _table({"kind": ["meta"], "piece": table["piece"][:1].to_pylist(), "name": [name], "n": [int(counts.sum())]}, 1)
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(_NONE)).astype(np.int64)
        u, inverse = np.unique(first, return_inverse=True)
        alone = lexicon.entries(u)[2][inverse]
        found = [([a, b], [x, c]) for a, b, x, c in zip(first.tolist(), second.tolist(), alone.tolist(), counts.tolist(), strict=True)]
        return pa.concat_tables([meta, _table({"kind": ["phrase"] * len(found), **_phrases(lexicon, found)}, len(found))])

    return keep


@dataclass
class Pairs:
    """The frequent pairs and their counts."""

    folder: str
    names: list[str | None]
    total: int

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of pairs in any order (0: not frequent)."""
        u, inverse = np.unique(pairs, return_inverse=True)
        out = np.zeros(len(u), np.int64)
        piece = (mix(u) % np.uint64(len(self.names))).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        cuts = np.searchsorted(piece[order], np.arange(len(self.names) + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            if self.names[p] and len(keys := mapped(self.folder, self.names[p], "keys", "<u8")):
                part = order[cuts[p] : cuts[p + 1]]
                i = np.minimum(np.searchsorted(keys, u[part]), len(keys) - 1)
                out[part] = np.where(keys[i] == u[part], mapped(self.folder, self.names[p], "counts", "<i8")[i], 0)
        return out[inverse]


# growth -------------------------------------------------------------------------------------------------------------


def _distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(counts, first) if len(first) else counts


def _windows(lexicon: Lexicon, pairs: Pairs, n: int, longest: int) -> Callable:
    """Projects the frequent pairs: (piece, windows, counts), a window being the ids from an occurrence on."""
    hot = pairs.total / (4 * n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts = [np.zeros((0, longest + 1), np.uint32)], [np.zeros(0, np.int64)]

        def out() -> Iterator[pa.RecordBatch]:
            r, c = _distinct(np.concatenate(rows), np.concatenate(counts))
            cuts = np.searchsorted(r[:, 0], np.arange(n + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[p], cuts[p + 1])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_pack(np.ascontiguousarray(r[part, 1:].T))], pa.binary()), pa.array([_pack(c[part])], pa.binary())], ["piece", "keys", "counts"])

        for batch in chunks(batches, "body", _CHUNK):
            ids, joined = lexicon.of(batch)
            often = np.zeros(len(ids) + longest, np.int64)
            i = np.flatnonzero(joined)
            often[i] = pairs.counts(ids[i].astype(np.uint64) << np.uint64(32) | ids[i + 1].astype(np.uint64))
            pointers = np.flatnonzero((often[:-1] > 0) & (often[1:] > 0))
            if not len(pointers):
                continue
            found = np.full((len(pointers), longest + 1), _NONE, np.uint32)
            found[:, 1] = ids[pointers]
            on = np.ones(len(pointers), bool)
            for j in range(1, longest):
                on &= often[pointers + j - 1] > 0
                found[on, j + 1] = ids[pointers[on] + j]
            prefix = found[:, 1].astype(np.uint64) << np.uint64(32) | found[:, 2].astype(np.uint64)
            prefix = np.where(often[pointers] > hot, mix(prefix) ^ mix(found[:, 3].astype(np.uint64)), prefix)
            found[:, 0] = mix(prefix) % np.uint64(n)
            r, c = _distinct(found, np.ones(len(found), np.int64))
            rows.append(r)
            counts.append(c)
            if sum(map(len, rows)) > _HELD_WINDOWS:
                rows, counts = ([x] for x in _distinct(np.concatenate(rows), np.concatenate(counts)))
                if len(rows[0]) > _HELD_WINDOWS // 2:
                    yield from out()
                    rows, counts = [rows[0][:0]], [counts[0][:0]]
        yield from out()

    return project


def extend(rows: np.ndarray, counts: np.ndarray, prefix: list[int], had: list[int], least: int, found: list[tuple[list[int], list[int]]]) -> None:
    """Grows the prefix that all rows begin with by one word to the right, each frequent one at once further on.

    rows are sorted; had: counts of the prefix's first one, two, ... words. Phrases and such counts go to found.
    """
    depth = len(prefix)
    column = rows[:, depth]
    cuts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    sums = np.add.reduceat(counts, cuts)
    stops = np.append(cuts[1:], len(column))
    for k in np.flatnonzero((sums >= least) & (column[cuts] != _NONE)).tolist():
        low, high, longer, have = cuts[k], stops[k], [*prefix, int(column[cuts[k]])], [*had, int(sums[k])]
        found.append((longer, have))
        if depth + 1 < rows.shape[1]:
            extend(rows[low:high], counts[low:high], longer, have, least, found)


def _grow(lexicon: Lexicon, pairs: Pairs, least: int, longest: int) -> Callable:
    def grow(table: pa.Table) -> pa.Table:
        rows = np.concatenate([_unpack(k, "<u4").reshape(longest, -1).T for k in table["keys"].to_pylist()])
        rows, counts = _distinct(rows, np.concatenate([_unpack(c, "<i8") for c in table["counts"].to_pylist()]))
        prefix = rows[:, 0].astype(np.uint64) << np.uint64(32) | rows[:, 1].astype(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        both = pairs.counts(prefix[cuts])
        u, inverse = np.unique(rows[cuts, 0].astype(np.int64), return_inverse=True)
        alone = lexicon.entries(u)[2][inverse]
        found: list[tuple[list[int], list[int]]] = []
        for low, high, one, two in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], alone.tolist(), both.tolist(), strict=True):
            extend(rows[low:high], counts[low:high], rows[low, :2].tolist(), [one, two], least, found)
        return _table({"kind": ["phrase"] * len(found), **_phrases(lexicon, found)}, len(found))

    return grow


def frequent_phrases(texts: DataFrame, space: Workspace, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of the words, and (lang, phrase, size, lefts, a) of the phrases of 2 to `longest` words, that occur at least `least` times.

    texts: (lang, body), no nulls. A words row without a word has the number of all words of its language. lefts: the
    counts of a phrase's first one, two, ... words.
    """
    n, folder, spark = shards(texts), space.folder("lexicon"), texts.sparkSession
    counted = texts.mapInArrow(_count_words, "lang string, word string, h bigint, n bigint").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    counted = space.write(counted.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    piece = F.shiftright(F.shiftrightunsigned("h", 32) * n, 32).cast("int")
    meta = sorted(space.write(counted.where("word is not null").withColumn("piece", piece).groupBy("piece").applyInArrow(_save_words(folder), "piece int, name string, n bigint"), "lexicon-names").collect())  # a row a piece
    size = {r["piece"]: r["n"] for r in meta}
    base = [0, *np.cumsum([size.get(p, 0) for p in range(n)]).tolist()]
    if base[-1] >= int(_NONE):
        raise ValueError(f"{base[-1]} frequent words; ids have 32 bits")
    lexicon = Lexicon(folder, _by_piece(meta, n), base, 0)
    two = space.write(texts.mapInArrow(_count_pairs(lexicon, n), _PIECE).groupBy("piece").applyInArrow(_save_pairs(lexicon, least), _GROWN), "pairs")
    meta = two.where("kind = 'meta'").select("piece", "name", "n").collect()  # a row a piece
    pairs = Pairs(folder, _by_piece(meta, n), sum(r["n"] for r in meta))
    phrases = two.where("kind = 'phrase'")
    if longest > 2:
        phrases = phrases.unionByName(space.write(texts.mapInArrow(_windows(lexicon, pairs, n, longest), _PIECE).groupBy("piece").applyInArrow(_grow(lexicon, pairs, least, longest), _GROWN), "grown"))
    return counted.drop("h"), phrases.select("lang", "phrase", "size", "lefts", "a")


def collocations(docs: DataFrame, top: int | None = 2000, least: int = 30, longest: int = 4, cover: int = 80, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    Phrases lie within pieces, which end at . , ; : ! ? and line ends. a: occurrences, at least `least`; score: twice a
    as a share of l + r (in millionths), the occurrences of the two parts at the cut where that is least, the first of
    equal ones; n: all words of the language. A phrase goes if a longer frequent one that contains it has `cover`
    percent of its occurrences. top: rows a language, None for all. Null languages are "und", null and empty texts have
    no words; repeated rows count each time; a language without frequent phrases and an empty table have no rows.
    """
    space = Workspace(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_of(text_column).alias("body"))
    singles, phrases = frequent_phrases(texts, space, least, longest)
    known = singles.where("word is not null").select("lang", F.col("word").alias("rest"), F.col("n").alias("r")).union(phrases.where(F.col("size") < longest).select("lang", "phrase", "a"))
    cuts = phrases.select("lang", "phrase", "size", "a", F.posexplode("lefts").alias("k", "l")).withColumn("rest", F.expr("substring_index(phrase, ' ', k + 1 - size)"))
    cuts = cuts.join(small(known, BROADCAST_ROWS), ["lang", "rest"]).withColumn("score", F.expr("(cast(a as decimal(38, 0)) * 2000000) div (l + r)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("size") - m), lambda i: F.array_join(F.slice(w, i + 1, m), " "))))
    within = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.coalesce("longer", F.lit(0)).cast("decimal(38, 0)") * 100 < F.col("a") * cover)
    kept = space.write(kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score"), "kept")
    placed = ranked(kept, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")])
    start = placed.groupBy("lang").agg(F.min("place").alias("start"))
    total = singles.where("word is null").select("lang", "n")
    out = placed.join(small(start.join(total, "lang"), BROADCAST_ROWS), "lang").withColumn("rank", F.col("place") - F.col("start") + 1)
    out = out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return out if top is None else out.where(F.col("rank") <= top)
