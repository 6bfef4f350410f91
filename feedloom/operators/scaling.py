"""Positions of sources on one line from how often each of them uses each word (Poisson scaling)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.graph import Workspace

#: Sources that can be scaled: three numbers each reach the driver a round. Words and texts have no bound.
SOURCES = 20_000
#: Rounds that are mixed.
MIXED = 6
#: Counts in a task's block of words times sources.
BLOCK = 4_000_000
#: Spread of a word's weight around zero, which holds words of a single source.
WORD_SPREAD = 3.0


def word_fits(counts: np.ndarray, alpha: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(psi, beta, mu) for words in rows, given the sources' sizes and positions; the fit of a word has one best place."""
    base = np.exp(alpha)
    psi, beta = np.log(counts.sum(1) / base.sum()), np.zeros(len(counts))

    def loss(psi: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = psi[:, None] + beta[:, None] * omega + alpha
        mu = np.exp(np.minimum(line, 50))
        return mu, (mu - counts * line).sum(1) + beta * beta / (2 * WORD_SPREAD**2)

    mu, now = loss(psi, beta)
    for _ in range(60):
        rest = counts - mu
        g0, g1 = rest.sum(1), rest @ omega - beta / WORD_SPREAD**2
        h00, h01, h11 = mu.sum(1), mu @ omega, mu @ (omega * omega) + 1 / WORD_SPREAD**2
        det = h00 * h11 - h01 * h01
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = np.ones(len(counts))
        for _ in range(30):  # halve the step of words that it makes worse
            new_mu, new = loss(psi + size * d0, beta + size * d1)
            worse = new > now + 1e-9 * np.abs(now)
            if not worse.any():
                break
            size[worse] /= 2
        psi, beta, mu, now = psi + size * d0, beta + size * d1, new_mu, new
        if max(np.abs(size * d0).max(), np.abs(size * d1).max()) < 1e-9:
            break
    return psi, beta, mu


def alike_words(words: DataFrame) -> DataFrame:
    """(ks, ns, words): how many words have these uses, as the sources' numbers and the counts; all of them have one fit."""
    return words.select(F.col("uses.k").alias("ks"), F.col("uses.n").alias("ns")).groupBy("ks", "ns").agg(F.count("*").alias("words"))


def wordfish(counts: DataFrame, low: str, high: str, rounds: int = 200, settled: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Sources and words on one line, from counts (source, word, n).

    n of a source's word is taken as Poisson with mean exp(alpha + psi + beta * omega). The first table has (source, n,
    alpha, omega, se), the second (word, n, psi, beta). omega has mean 0 and variance 1 over the sources, and that of
    `low` is below that of `high`. A round fits every word to the sources as they stand, sums slopes and curvatures by
    source in Spark, and moves each source by a Newton step of at most 1. It stops when no position has moved by
    `settled`, at the latest after `rounds` (then an error says so). se is the curvature's standard error. Words that all
    sources use equally often have one fit, so a round fits each such row of counts once and weighs it by its words.

    Rows with a null source or word, or with n null or below 1, are left out; repeated rows are added up. No rows give two
    empty tables; a single source, or `low` or `high` without words, is an error, as are more than `SOURCES` sources.
    """
    spark = counts.sparkSession
    space = Workspace(spark)
    pairs = space.write(counts.where("source is not null and word is not null and n > 0").groupBy("source", "word").agg(F.sum("n").alias("n")), "pairs")
    sizes = pairs.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").limit(SOURCES + 1).collect()
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    names = [r["source"] for r in sizes]
    if not names:
        return spark.createDataFrame([], "source string, n bigint, alpha double, omega double, se double"), spark.createDataFrame([], "word string, n bigint, psi double, beta double")
    if low not in names or high not in names or low == high:
        raise ValueError("the two sources that give the direction need words")
    place = F.broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(names)], "source string, k int"))  # at most SOURCES rows
    words = space.write(pairs.join(place, "source").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("uses"), F.sum("n").alias("n")), "words")
    # few rows with much to do for each: not left to one task
    alike = space.write(alike_words(words).repartition(spark.sparkContext.defaultParallelism), "alike")

    many, rows_at_once = len(names), max(1, BLOCK // len(names))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for batch in batches:
            for i in range(0, len(batch), rows_at_once):
                part = batch.iloc[i : i + rows_at_once]
                table = np.zeros((len(part), many))
                table[np.repeat(np.arange(len(part)), part["ks"].str.len()), np.concatenate(part["ks"].to_numpy())] = np.concatenate(part["ns"].to_numpy())
                yield part, table

    def sums(alpha: np.ndarray, omega: np.ndarray):
        def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((5, many))
            for part, table in blocks(batches):
                _, beta, mu = word_fits(table, alpha, omega)
                rest, m = table - mu, part["words"].to_numpy(dtype=float)
                total += [m @ rest, (m * beta) @ rest, m @ mu, (m * beta) @ mu, (m * beta * beta) @ mu]
            yield pd.DataFrame({"k": np.arange(many), **{f"x{j}": total[j] for j in range(5)}})

        return of_task

    def fitted(alpha: np.ndarray, omega: np.ndarray):
        def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, table in blocks(batches):
                psi, beta, _ = word_fits(table, alpha, omega)
                yield pd.DataFrame({"word": part["word"].to_numpy(), "n": part["n"].to_numpy(), "psi": psi, "beta": beta})

        return of_task

    def curvatures(alpha: np.ndarray, omega: np.ndarray) -> np.ndarray:
        parts = alike.mapInPandas(sums(alpha, omega), "k int, x0 double, x1 double, x2 double, x3 double, x4 double")
        rows = parts.groupBy("k").agg(*(F.sum(f"x{j}").alias(f"x{j}") for j in range(5))).collect()  # one a source
        return np.array([r[1:] for r in sorted(rows)]).T

    count = np.array([r["n"] for r in sizes], dtype=float)
    alpha = np.log(count / count.mean())
    a, b = names.index(low), names.index(high)
    # a start that tells the two ends apart: by how alike a source's words are to the one's rather than the other's
    uses = pairs.join(pairs.where(F.col("source").isin(low, high)).groupBy("word").agg(F.sum(F.when(F.col("source") == high, F.col("n")).otherwise(0)).alias("h"), F.sum(F.when(F.col("source") == low, F.col("n")).otherwise(0)).alias("l")), "word")
    lean = F.log((F.col("h") / count[b] * 1e6 + 1) / (F.col("l") / count[a] * 1e6 + 1))
    near = {r["source"]: r["x"] for r in uses.groupBy("source").agg((F.sum(F.col("n") * lean) / F.sum("n")).alias("x")).collect()}  # one a source
    omega = np.array([near.get(s, 0.0) for s in names])

    def standard(x: np.ndarray) -> np.ndarray:
        x = x - x.mean()
        return x / (x.std() or 1.0) * (1 if x[a] <= x[b] else -1)

    def improved(x: np.ndarray) -> np.ndarray:
        """Sizes and positions after a round, in one row."""
        alpha, omega = x[:many], x[many:]
        g0, g1, h00, h01, h11 = curvatures(alpha, omega)
        g1, h11 = g1 - omega, h11 + 1  # positions spread by 1
        det = np.maximum(h00 * h11 - h01 * h01, 1e-12)
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        alpha = alpha + np.clip(d0, -1, 1)
        return np.concatenate([alpha - alpha.mean(), standard(omega + np.clip(d1, -1, 1))])

    # rounds by themselves settle slowly; mixing the last few (Anderson) leaves their fixed point as it is
    x, seen = np.concatenate([alpha - alpha.mean(), standard(omega)]), []
    for _ in range(rounds):
        new = improved(x)
        step = new - x
        if np.abs(step[many:]).max() < settled:
            break
        if seen and np.abs(step).max() > 2 * np.abs(seen[-1][1]).max():
            seen = []
        seen = [*seen[-MIXED:], (new, step)]
        x = new
        if len(seen) > 1:
            by_step = np.array([step - s for _, s in seen[:-1]]).T
            mixed = new - np.array([new - y for y, _ in seen[:-1]]).T @ np.linalg.lstsq(by_step, step, rcond=1e-8)[0]
            if np.abs(mixed - new).max() <= 1:  # further than a round may go by itself: not trusted
                x = np.concatenate([mixed[:many] - mixed[:many].mean(), standard(mixed[many:])])
    else:
        raise RuntimeError(f"positions still move after {rounds} rounds")
    alpha, omega = new[:many], new[many:]
    _, _, h00, h01, h11 = curvatures(alpha, omega)
    se = np.sqrt(h00 / np.maximum(h00 * (h11 + 1) - h01 * h01, 1e-12))
    rows = [(s, int(c), float(x), float(o), float(e)) for s, c, x, o, e in zip(names, count, alpha, omega, se)]
    sources = spark.createDataFrame(rows, "source string, n bigint, alpha double, omega double, se double")
    return sources, words.select("word", "n", F.col("uses.k").alias("ks"), F.col("uses.n").alias("ns")).mapInPandas(fitted(alpha, omega), "word string, n bigint, psi double, beta double")
