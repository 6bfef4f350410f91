"""The source-health state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import vocab as v


def permanent() -> Column:
    """Is an outcome (ok, error_kind, http_status) a dead or moved feed's?"""
    gone = F.col("error_kind").isin("dns", "not-a-feed") | (F.col("error_kind") == "http-4xx") & F.col("http_status").isin(404, 410)
    return F.coalesce(~F.col("ok") & gone, F.lit(False))


def is_off() -> Column:
    """Disabled by failures: so its status says, or it has none and isn't enabled."""
    return F.coalesce(F.col("status") == "disabled", ~F.col("enabled"))


def reconcile(registry: DataFrame, outcomes: DataFrame, now: int, threshold: int = v.STRIKES) -> DataFrame:
    """The registry after one round of outcomes; sources without an outcome stay as they are.

    A disabled source that answers is active (or dormant without items); one that fails waits anew. Others lose a
    strike count on success, keep it on passing failures, and are disabled when permanent failures reach threshold.
    """
    rows = registry.join(outcomes, "id", "left")
    ok, seen = F.col("ok"), F.col("ok").isNotNull()
    off = is_off()
    alive = F.when(F.col("item_count") > 0, "active").otherwise("dormant")
    out = permanent() & ~off & (F.col("strikes") + 1 >= threshold)
    fail = F.when(off | out, "disabled").otherwise("failing")
    return rows.select(
        "id",
        F.when(~seen, F.col("status")).when(ok, alive).otherwise(fail).alias("status"),
        F.when(~seen, F.col("enabled")).when(ok & off, True).when(~ok & (off | out), False).otherwise(F.col("enabled")).alias("enabled"),
        F.when(~seen | (off & ~ok), F.col("strikes")).when(ok, 0).otherwise(F.col("strikes") + permanent().cast("int")).alias("strikes"),
        F.when(seen & ok, None).when(seen & ~ok & (off | out), F.lit(now)).otherwise(F.col("disabled_s")).alias("disabled_s"),
        F.when(seen & ok, F.lit(now)).otherwise(F.col("last_ok_s")).alias("last_ok_s"),
        F.when(seen & ~ok, F.when(permanent(), "permanent").otherwise("transient")).alias("last_error"),
        F.coalesce(out & seen, F.lit(False)).alias("rediscover"),
    )


def reprobe_eligible(registry: DataFrame, now: int, days: int = v.REPROBE_DAYS) -> DataFrame:
    return registry.where(~F.col("enabled") & is_off() & (F.col("disabled_s").isNull() | (now - F.col("disabled_s") >= days * v.DAY)))


def prune(registry: DataFrame, now: int, strikes: int = v.STRIKES, stale_days: int = 30) -> DataFrame:
    """(id, action): disable at too many strikes, flag what has long not answered. Disabling sets no date here."""
    action = F.when(F.col("enabled") & (F.col("strikes") >= strikes), "disable").when(F.col("enabled") & (now - F.col("last_ok_s") > stale_days * v.DAY), "flag-stale")
    return registry.select("id", action.alias("action")).where("action is not null")


def rediscovered(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Disabled sources for which a new address (id, url) was found are active again; the others stay as they are."""
    rows = registry.join(found, "id", "left")
    hit = (F.col("status") == "disabled") & F.col("url").isNotNull()
    return rows.withColumns({"status": F.when(hit, "active").otherwise(F.col("status")), "enabled": F.when(hit, True).otherwise(F.col("enabled")), "strikes": F.when(hit, 0).otherwise(F.col("strikes")), "disabled_s": F.when(~hit, F.col("disabled_s"))})


def overlaid(seed: DataFrame, stored: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The seed with the stored fields where there are any."""
    over = stored.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    return seed.join(over, key, "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*(f"__{f}" for f in fields))


def rerated(registry: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry (id, trust) with new ratings (id, rated), and the log (id, was, now) of what has changed."""
    rows = registry.join(ratings, "id", "left")
    changed = rows.where(F.col("rated").isNotNull() & ~F.col("trust").eqNullSafe(F.col("rated"))).select("id", F.col("trust").alias("was"), F.col("rated").alias("now"))
    return rows.withColumn("trust", F.coalesce("rated", "trust")).drop("rated"), changed
