"""State by key in streams: each source's health with its re-probe timer, each item's decayed weight, and event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedloom import vocab as v
from feedloom.operators.graph import Workspace

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEALTH = "id string, turn bigint, kind string, status string, enabled boolean, strikes bigint, disabled_s bigint, last_ok_s bigint, last_error string, rediscover boolean"
_STATE = "id string, turn bigint, status string, enabled boolean, strikes bigint, disabled_s bigint, last_ok_s bigint, last_error string, waiting boolean"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
#: Keys that sources are dealt to. Fixed, as the state of a stream that goes on lies under them.
SHARDS = 1 << 16


def transition(state: dict[str, Any], outcome: dict[str, Any], threshold: int = v.STRIKES) -> tuple[dict[str, Any], bool]:
    """A source's health after one outcome (ok, permanent, item_count, at_s), and whether it should be rediscovered."""
    at = outcome["at_s"]
    off = state["status"] == "disabled" or state["status"] is None and not state["enabled"]
    new = {**state, "turn": state["turn"] + 1}
    if outcome["ok"]:
        new |= {"status": "active" if outcome["item_count"] > 0 else "dormant", "strikes": 0, "disabled_s": None, "last_ok_s": at, "last_error": None}
        return new | ({"enabled": True} if off else {}), False
    new["last_error"] = "permanent" if outcome["permanent"] else "transient"
    if off:
        return new | {"enabled": False, "disabled_s": at}, False
    strikes = state["strikes"] + bool(outcome["permanent"])
    gone = bool(outcome["permanent"]) and strikes >= threshold
    new |= {"strikes": strikes, "status": "disabled" if gone else "failing"}
    return new | ({"enabled": False, "disabled_s": at} if gone else {}), gone


class SourceHealth(StatefulProcessor):
    """The health state machines of a shard's sources. A disabled source sets a timer; when event time passes it, it is due for a re-probe.

    A key costs several calls between Spark and Python, so a key holds many sources: their states are read and written
    at once. A timer stands for all sources of the shard that were disabled in that second and still wait for it.
    """

    def __init__(self, window_s: int = v.REPROBE_DAYS * v.DAY):
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("health", _STATE)

    def _held(self) -> dict[Any, dict[str, Any]]:
        return {s[0]: dict(zip(_NAMES, s, strict=True)) for s in self.state.get()}

    def _keep(self, sources: dict[Any, dict[str, Any]]) -> None:
        self.state.put([tuple(s[c] for c in _NAMES) for s in sources.values()])

    def _set_timers(self, before: set[int], sources: dict[Any, dict[str, Any]]) -> None:
        after = {s["disabled_s"] for s in sources.values() if s["waiting"]}
        for at in before - after:
            self.handle.deleteTimer((at + self.window_s) * 1000)
        for at in after - before:
            self.handle.registerTimer((at + self.window_s) * 1000)

    def _row(self, s: dict[str, Any], kind: str, rediscover: bool = False) -> Row:
        return Row(id=s["id"], turn=s["turn"], kind=kind, status=s["status"], enabled=s["enabled"], strikes=s["strikes"], disabled_s=s["disabled_s"], last_ok_s=s["last_ok_s"], last_error=s["last_error"], rediscover=rediscover)

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:  # noqa: N802, N803
        row = initialState if isinstance(initialState, Row) else next(iter(initialState))  # one a shard
        sources = {r["id"]: {"turn": 0, "last_error": None, "waiting": r["disabled_s"] is not None} | {k: r[k] for k in ("id", "status", "enabled", "strikes", "disabled_s", "last_ok_s")} for r in row["sources"]}
        self._keep(sources)
        self._set_timers(set(), sources)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        sources = self._held()
        before = {s["disabled_s"] for s in sources.values() if s["waiting"]}
        new: dict[Any, list[dict[str, Any]]] = {}
        for r in rows:
            new.setdefault(r["id"], []).append(r.asDict())
        gone = {}
        for i, own in new.items():
            s = sources.get(i) or {"id": i, "turn": 0, "status": "active", "enabled": True, "strikes": 0, "disabled_s": None, "last_ok_s": None, "last_error": None, "waiting": False}
            off = s["disabled_s"]
            # a key's outcomes within a batch, in the order of their times; the latest transition speaks
            for r in sorted(own, key=lambda r: (r["at_s"], r["ok"])):
                s, gone[i] = transition(s, r)
            sources[i] = s if s["disabled_s"] == off else s | {"waiting": s["disabled_s"] is not None}
        self._keep(sources)
        self._set_timers(before, sources)
        for i in new:
            yield self._row(sources[i], "outcome", gone[i])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.window_s
        sources = self._held()
        due = [i for i, s in sources.items() if s["waiting"] and s["disabled_s"] == at]
        for i in due:
            sources[i] = sources[i] | {"waiting": False}
        self._keep(sources)
        for i in due:
            yield self._row(sources[i], "reprobe")

    def close(self) -> None:
        pass


def source_health(outcomes: DataFrame, registry: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of HEALTH rows from a stream of outcomes (id, at_ts, ok, permanent, item_count).

    kind outcome: a source's health after a batch, turn counting its outcomes; kind reprobe: event time has passed the
    re-probe window of a disabled source. registry (id, status, enabled, strikes, disabled_s, last_ok_s) is the state to
    begin with. Outcomes later than the watermark's delay are left out, as their turn is over.
    """
    spark = outcomes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS)).alias("shard")
    rows = outcomes.select(shard, "id", "at_ts", F.unix_timestamp("at_ts").alias("at_s"), "ok", F.coalesce("permanent", F.lit(False)).alias("permanent"), F.coalesce("item_count", F.lit(0)).alias("item_count")).withWatermark("at_ts", delay)
    held = F.struct("id", "status", "enabled", F.col("strikes").cast("bigint").alias("strikes"), F.col("disabled_s").cast("bigint").alias("disabled_s"), F.col("last_ok_s").cast("bigint").alias("last_ok_s"))
    first = registry.groupBy(shard).agg(F.collect_list(held).alias("sources")).groupBy("shard")
    return rows.groupBy("shard").transformWithState(SourceHealth(), HEALTH, "Update", "EventTime", initialState=first)


class DecayedWeight(StatefulProcessor):
    """An item's engagement: the weight as of the last event, which decays until the next one; late events decay alone."""

    def __init__(self, half_life_s: float):
        self.half_life_s = half_life_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("weight", "turn bigint, w double, at_s bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        turn, w, at = tuple(self.state.get()) if self.state.exists() else (0, 0.0, None)
        for r in rows:
            now = r["at_s"] if at is None else max(at, r["at_s"])
            w = (0.0 if at is None else w * 0.5 ** ((now - at) / self.half_life_s)) + r["w"] * 0.5 ** ((now - r["at_s"]) / self.half_life_s)
            at = now
        self.state.update((turn + 1, w, at))
        yield Row(item_id=key[0], turn=turn + 1, w=w, at_s=at)

    def close(self) -> None:
        pass


def item_weights(events: DataFrame, half_life_days: float = v.HALF_LIFE_DAYS) -> DataFrame:
    """A stream of (item_id, turn, w, at_s) from events (item_id, at_ts, w): each item's decayed weight as of its last event."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("item_id is not null and at_ts is not null").select("item_id", F.unix_timestamp("at_ts").alias("at_s"), F.col("w").cast("double").alias("w"))
    return rows.groupBy("item_id").transformWithState(DecayedWeight(half_life_days * v.DAY), "item_id string, turn bigint, w double, at_s bigint", "Update", "None")


def run(stream: DataFrame, space: Workspace, name: str, mode: str = "update") -> tuple[DataFrame, StreamingQuery]:
    """Runs a stream over what is there; returns all rows that it has written so far, and the query.

    A batch is written under its number, so one that runs again after a restart replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        space.write(batch, f"{name}/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", space.folder(f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(space.folder(name)).select(*stream.columns), query


def last_turns(rows: DataFrame, key: str) -> DataFrame:
    """The row with the last turn of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "turn").alias("r")).select(key, "r.*")


def distinct_events(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Events once a key: repeats within the watermark's delay go, and so do events behind the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def dropped(query: StreamingQuery) -> int:
    """How many rows a finished query's stateful operators dropped for being behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def fed(parts: list[DataFrame], space: Workspace, name: str, plan: Callable[[DataFrame], DataFrame], mode: str = "update") -> tuple[DataFrame, int]:
    """Appends the parts to a folder one after the other and lets the stream `plan` of it go on each time, from its checkpoint.

    Returns all rows written, and how many rows were dropped for being behind the watermark. No part goes through one task.
    """
    spark, late, out = parts[0].sparkSession, 0, None
    for part in parts:
        part.write.mode("append").parquet(space.folder(f"{name}-in"))
        out, query = run(plan(spark.readStream.schema(part.schema).parquet(space.folder(f"{name}-in"))), space, name, mode)
        late += dropped(query)
    return out, late
