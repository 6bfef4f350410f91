"""Scores and their terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import vocab as v

TERMS = ["recency", "trust", "metrics", "cluster", "content", "read_time", "affinity"]


def decay(age_days: Column, half_life: float = v.HALF_LIFE_DAYS) -> Column:
    return F.exp(F.lit(-0.6931471805599453) * age_days / half_life)


def read_score(minutes: Column, peak: float = v.PEAK_MINUTES, sigma: float = v.SIGMA_MINUTES) -> Column:
    return F.exp(-F.pow(minutes - peak, F.lit(2.0)) / (2 * sigma * sigma))


def volume_term(score: Column, comments: Column) -> Column:
    return F.log10(1 + F.greatest(F.coalesce(score, F.lit(0)) + F.coalesce(comments, F.lit(0)), F.lit(0))) / 5


def kelly(p: Column, b: Column) -> Column:
    """The stake that grows fastest at odds b and chance p; nothing without an edge."""
    return F.greatest(p - (1 - p) / b, F.lit(0.0))


def growth(p: Column, b: Column, f: Column) -> Column:
    """Log growth a bet at stake f."""
    return p * F.ln(1 + b * f) + (1 - p) * F.ln(1 - f)


def event_weight(kind: Column, dwell_ms: Column) -> Column:
    points = F.least(F.coalesce(dwell_ms, F.lit(0.0)) / v.DWELL_MS_PER_POINT, F.lit(v.DWELL_CAP))
    return F.when(kind == "open", 1.0).when(kind == "read", 3.0).when(kind == "dwell", points)


def contributions(now: int, cluster_size: Column, affinity: Column, weights: dict[str, float] | None = None, peak: float = v.PEAK_MINUTES, sigma: float = v.SIGMA_MINUTES, half_life: float = v.HALF_LIFE_DAYS) -> dict[str, Column]:
    """The seven terms of an item's score, from n_plain and minutes. affinity: the mean over its topics plus that over its entities."""
    w = v.WEIGHTS | (weights or {})
    age = F.greatest((F.lit(now) - F.col("published_s")) / float(v.DAY), F.lit(0.0))
    media = F.col("kind").isin("video", "audio")
    full = F.col("n_plain") > v.FULL_TEXT_CHARS
    return {
        "recency": w["recency"] * decay(age, half_life),
        "trust": w["trust"] * F.coalesce("trust", F.lit(0.5)),
        "metrics": w["metrics"] * volume_term(F.col("score"), F.col("comments")),
        "cluster": w["cluster"] * F.log10(cluster_size.cast("double")),
        "content": F.when(full, w["full_text"]).when(media, w["media"]).otherwise(0.0),
        "read_time": w["read_time"] * read_score(F.col("minutes"), peak, sigma),
        "affinity": w["affinity"] * affinity,
    }
