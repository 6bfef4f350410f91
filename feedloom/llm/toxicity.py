"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

The counts behind the ratios, and the choice of features, come from all training rows, summed by Spark. The weights
are fitted by logistic regression on a bounded sample of those rows (TRAIN_ROWS), reduced to the chosen features.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import _LOWER, Rolling, chunks, small, string_buffers, text_of

#: Bytes in a feature, bits of the feature space, chosen features, distinct texts that the weights are fitted on (a bound).
ORDERS, BITS, CHOSEN, TRAIN_ROWS = (3, 4, 5), 20, 4096, 20_000
#: Steps of the descent, its pull to zero, the score from which a text is predicted toxic.
STEPS, PULL, THRESHOLD = 200, 1e-5, 0.3
_BLOCKS = 64
#: The text beside the columns of the rows that are filtered.
_SCORED = "__text_to_score"
#: Label rows (12 bytes each) that may be broadcast.
BROADCAST_ROWS = 2_000_000
_FOLD = _LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32


def features(body: np.ndarray) -> np.ndarray:
    """Hashed n-grams of a text's bytes (A-Z lower-cased, white space as spaces, one more at both ends), with repeats."""
    roll = Rolling(np.concatenate([[32], _FOLD[body], [32]]).astype(np.uint8))
    return np.concatenate([roll.grams(n) >> np.uint64(64 - BITS) for n in ORDERS]).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and block of features: in how many texts of label 0 and of label 1 each feature occurs."""
    seen, rows = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for batch in chunks(batches, "body"):
        data, at = string_buffers(batch.column(0))
        for i, label in enumerate(batch.column(1).to_pylist()):
            found = np.zeros(1 << BITS, bool) if at[i + 1] - at[i] > 1 << 18 else None
            f = features(data[at[i] : at[i + 1]])
            if found is None:
                seen[label, np.unique(f)] += 1
            else:
                found[f] = True
                seen[label] += found
            rows[label] += 1
    if rows.sum():
        parts = seen.reshape(2, _BLOCKS, -1)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(_BLOCKS), pa.int32()), "counts": [zlib.compress(parts[:, b].astype("<i8").tobytes(), 1) for b in range(_BLOCKS)], "rows": [rows.tobytes()] * _BLOCKS})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the blocks up as they stream by; holds one sum a block."""
    total: dict[int, np.ndarray] = {}
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            total[b] = total.get(b, 0) + np.frombuffer(zlib.decompress(c), "<i8")
            rows[b] = rows.get(b, 0) + np.frombuffer(n, "<i8")
    if total:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in total.values()], "rows": [x.tobytes() for x in rows.values()]})


@dataclass
class Model:
    """weights: per feature of the whole space, the product of log-count ratio and fitted weight; ratios squared for the length."""

    features: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        """found: positions in self.features of those that a text has."""
        v = self.ratios[found]
        z = self.bias + float(self.weights[found] @ v) / float(np.sqrt(v @ v + 1.0))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _present(model_features: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    place = np.full(1 << BITS, -1, np.int32)
    place[model_features] = np.arange(len(model_features), dtype=np.int32)

    def present(body: np.ndarray) -> np.ndarray:
        p = place[features(body)]
        return np.unique(p[p >= 0])

    return present


def _vectors(chosen: np.ndarray) -> Callable:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _present(chosen)
        for batch in chunks(batches, "body"):
            data, at = string_buffers(batch.column(0))
            found = [present(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["label", "draw", "found"])

    return vectors


def fit_weights(found: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on the scaled and normalised features; without rows of both labels, the prior alone.

    times: how many rows each row stands for.
    """
    n, times = len(labels), np.ones(len(labels)) if times is None else times
    rows, positive = float(times.sum()), float(times @ labels)
    bias = float(np.log((positive + 0.5) / (rows - positive + 0.5)))
    weights = np.zeros(len(ratios))
    if not 0 < positive < rows:
        return weights, bias
    column = np.concatenate(found).astype(np.int64)
    row = np.repeat(np.arange(n), [len(f) for f in found])
    value = ratios[column]
    value = value / np.sqrt(np.bincount(row, value * value, n) + 1.0)[row]
    m, s, mb, sb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(row, weights[column] * value, n) + bias, -700, 700)
        miss = (1 / (1 + np.exp(-z)) - labels) * times / rows
        g, gb = np.bincount(column, miss[row] * value, len(weights)) + PULL * weights, miss.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        weights -= 0.05 * (m / a) / (np.sqrt(s / b) + 1e-8)
        bias -= 0.05 * (mb / a) / (np.sqrt(sb / b) + 1e-8)
    return weights, bias


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """labelled: columns body (string) and label (0 or 1). An empty table gives a model that scores one half."""
    counted = labelled.select("body", "label").mapInArrow(_count, "block int, counts binary, rows binary")
    summed = counted.repartition(_BLOCKS, "block", F.crc32("counts") % 16).mapInArrow(_sum, "block int, counts binary, rows binary")
    summed = summed.repartition(_BLOCKS, "block").mapInArrow(_sum, "block int, counts binary, rows binary")
    parts = sorted(summed.collect())  # _BLOCKS rows, 16 MB at most
    if not parts:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.0)
    clean, toxic = np.stack([np.frombuffer(zlib.decompress(p["counts"]), "<i8").reshape(2, -1) for p in parts], 1).reshape(2, -1).astype(float)
    rows = np.frombuffer(parts[0]["rows"], "<i8")
    ratio = np.log((toxic + 1) / (rows[1] + 2)) - np.log((clean + 1) / (rows[0] + 2))
    n = toxic + clean
    expected = n * rows[1] / rows.sum()
    # the features that tell most about the label (likelihood ratio against independence)
    gain = sum(x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)) for x, e in ((toxic, expected), (clean, n - expected)))
    chosen = np.sort(np.argsort(-gain, kind="stable")[:CHOSEN])
    rate = train_rows / max(1, int(rows.sum()))
    sample = labelled.select("body", "label", F.xxhash64("body", F.lit(7)).alias("draw"))
    if rate < 1:  # by content, so that it is the same sample each time
        sample = sample.where(F.pmod("draw", F.lit(1_000_000)) < int(rate * 1_000_000))
    # equal texts are one row with a weight, so that copies can't fill the sample
    vectors = sample.mapInArrow(_vectors(chosen), "label int, draw bigint, found array<int>")
    got = vectors.groupBy("draw", "label").agg(F.first("found").alias("found"), F.count("*").alias("n")).orderBy("draw", "label").limit(train_rows).collect()
    weights, bias = fit_weights([np.array(r["found"], np.int64) for r in got], np.array([r["label"] for r in got], float), ratio[chosen], np.array([r["n"] for r in got], float))
    return Model(chosen, ratio[chosen], weights, bias)


def _scores(model: Model) -> Callable:
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _present(model.features)
        for batch in chunks(batches, "body"):
            data, at = string_buffers(batch.column(2))
            score = [model.score(present(data[at[i] : at[i + 1]])) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["id", "held_out", "score"])

    return scores


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_texts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """(body, label) of labelled rows that are not held out. Of several labels of an id the highest counts; null ones don't."""
    marks = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label")).where("label in (0, 1)")
    rows = docs.where(~held_out(id_column)).select(F.col(id_column).alias("id"), text_of(text_column).alias("body"))
    return rows.join(small(marks, BROADCAST_ROWS), "id").select("body", "label")


def toxicity_scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 from THRESHOLD on). Null texts are empty ones."""
    out = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), text_of(text_column).alias("body"))
    kind = docs.schema[id_column].dataType.simpleString()
    scored = out.mapInArrow(_scores(model), f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_column), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _clean(model: Model) -> Callable:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _present(model.features)
        for batch in chunks(batches, _SCORED):
            data, at = string_buffers(batch.column(batch.num_columns - 1))
            keep = [model.score(present(data[at[i] : at[i + 1]])) < THRESHOLD for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return clean


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of docs whose text the model does not predict toxic, all columns as they are."""
    return docs.select("*", text_of(text_column).alias(_SCORED)).mapInArrow(_clean(model), docs.schema)
