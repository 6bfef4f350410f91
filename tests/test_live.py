"""Reportings, peers, plugged-in sources, keyed state and event time, against loops."""

import math
import random
import statistics

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.operators import divergence as dv
from feedloom.operators import measures
from feedloom.operators.graph import Workspace
from feedloom.sources import plugin
from feedloom.streaming import keyed

# reportings -----------------------------------------------------------------------------------------------------------


def reportings(n=90, seed=2):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.randrange(7), rng.choice([-1.0, 0.0, 1.0, None]), [rng.gauss(1, 1) for _ in range(5)]) for i in range(n)]
    rows += [("a", 5, 1, 1.0, rows[5][4])] * 3 + [(None, 900, 1, 1.0, [1.0] * 5), ("a", 901, 1, 1.0, None), ("a", 902, None, 1.0, [0.0] * 5), ("lone", 903, 2, -1.0, [1.0, 0.0, 0.0, 0.0, 0.0]), ("b", 904, 3, 1.0, [float("nan")] * 5), ("twin", 905, 1, 1.0, [0.0, 1.0, 0.0, 0.0, 0.0]), ("twin", 906, 2, -1.0, [0.0, -1.0, 0.0, 0.0, 0.0])]
    return rows


def test_divergence_equals_all_pairs(spark):
    """The sums give what a loop over all pairs gives, also for a single reporting, opposed ones, copies and unusable vectors."""
    rows = reportings()
    df = spark.createDataFrame(rows, "event string, id bigint, outlet int, lean double, vector array<double>").withColumn("n", F.lit(1)).withColumn("u", F.lit("x"))
    got = {r["event"]: r for r in dv.divergence(df, 16, 0.5).collect()}
    events = {}
    for e, i, o, lean, x in rows:
        if e is not None and x is not None and math.isfinite(sum(x)) and any(x):
            norm = math.sqrt(sum(c * c for c in x))
            events.setdefault(e, []).append((i, o, lean, [c / norm for c in x]))
    assert set(got) == set(events)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for e, own in events.items():
        r = got[e]
        pairs = [dot(a[3], b[3]) for j, a in enumerate(own) for b in own[:j]]
        assert r["n"] == len(own)
        assert (r["divergence"] is None) == (not pairs)
        if pairs:
            assert r["divergence"] == pytest.approx(50 * (1 - statistics.fmean(pairs)))
            assert r["low"] <= r["high"]
        core = [sum(c) for c in zip(*(x[3] for x in own), strict=True)]
        size = math.sqrt(dot(core, core))
        near = [dot(x[3], core) / size if size > 1e-12 else 0.0 for x in own]
        ok = [x for x, c in zip(own, near, strict=True) if c >= 0.5]
        assert r["corroboration"] == pytest.approx(100 * len(ok) / len(own))
        assert r["outlets"] == len({x[1] for x in own if x[1] is not None}) and r["confirming"] == len({x[1] for x in ok if x[1] is not None})
        assert r["both_sides"] == (any((x[2] or 0) < 0 for x in ok) and any((x[2] or 0) > 0 for x in ok))
    assert got["twin"]["divergence"] == pytest.approx(100) and got["lone"]["low"] is None
    again = {r["event"]: r for r in dv.divergence(df.repartition(7), 16, 0.5).collect()}
    assert all(again[e]["low"] == pytest.approx(got[e]["low"]) for e in ("a", "b", "c"))
    shown = {r["event"]: r for r in dv.widened(dv.divergence(df, 16, 0.5), 30).collect()}
    assert shown["c"]["provisional"] and not shown["a"]["provisional"] and shown["a"]["low"] == pytest.approx(got["a"]["low"])
    assert shown["c"]["low"] == pytest.approx(max(0, got["c"]["divergence"] - 2 * (got["c"]["divergence"] - got["c"]["low"])))


def test_resampled_bounds_hold_the_index_and_shrink_with_rows(spark):
    rng = random.Random(4)
    rows = [("few" if i < 25 else "many", i, i, 0.0, [rng.gauss(0.5, 1) for _ in range(4)]) for i in range(1500)]
    got = {r["event"]: r for r in dv.divergence(spark.createDataFrame(rows, "event string, id bigint, outlet int, lean double, vector array<double>"), 40).collect()}
    assert all(r["low"] <= r["divergence"] <= r["high"] for r in got.values())
    assert got["many"]["high"] - got["many"]["low"] < got["few"]["high"] - got["few"]["low"]


def test_divergence_of_nothing_and_blindspots(spark):
    assert dv.divergence(spark.createDataFrame([], "event string, id bigint, outlet int, lean double, vector array<double>")).collect() == []
    rows = [("x", o, 1.0) for o in range(10)] + [("x", 0, 1.0), ("x", 50, -1.0), ("x", None, -1.0), (None, 1, 1.0), ("y", 1, -1.0), ("y", 2, 0.0), ("y", 3, None)] + [("z", o, -1.0) for o in range(3)]
    got = {r["event"]: tuple(r)[1:] for r in dv.blindspots(spark.createDataFrame(rows, "event string, outlet int, lean double")).collect()}
    assert got == {"x": (1, 0, 10, "left"), "y": (1, 1, 0, None), "z": (3, 0, 0, "right")}


# peers ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [1, 5])
def test_percentiles_with_ties(spark, keys):
    """Also with one group of all rows; nulls and NaN are no peers, and null keys are a group of their own."""
    rng = random.Random(keys)
    rows = [(i, None if i % 31 == 0 and keys > 1 else i % keys, rng.choice([None, float("nan"), *map(float, range(6))])) for i in range(400)]
    out = measures.percentiles(spark.createDataFrame(rows, "id bigint, key int, value double").withColumn("place", F.lit(3)), ["key"], "value", "id")
    sound = lambda x: x is not None and x == x
    for r in out.collect():
        peers = [x for _, k, x in rows if k == r["key"] and sound(x)]
        if not sound(r["value"]):
            assert r["percentile"] is None
        else:
            assert r["n"] == len(peers) and r["place"] == 3
            assert r["percentile"] == pytest.approx(100 * (sum(x < r["value"] for x in peers) + sum(x == r["value"] for x in peers) / 2) / len(peers))
    assert out.count() == len(rows)


# plugged-in sources ---------------------------------------------------------------------------------------------------


def write(folder, name, low, high):
    pq.write_table(pa.table({"doc_id": range(low, high), "text": [f"text {i}" for i in range(low, high)], "lang": ["en" if i % 2 else None for i in range(low, high)], "source": [f"s{i % 3}" for i in range(low, high)]}), folder / f"{name}.parquet", row_group_size=10)


def test_a_source_takes_filters_and_limits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a", 0, 35)
    write(tmp_path / "in", "b", 35, 60)
    name = plugin.register(spark, plugin.ParquetItems)
    df = spark.read.format(name).option("path", str(tmp_path / "in")).load()
    assert df.rdd.getNumPartitions() == 7 and [r["ord"] for r in df.orderBy("ord").collect()] == list(range(60))
    assert df.where("ord >= 40 and ord < 45 and lang = 'en'").select("ord").collect() == [(41,), (43,)]
    assert {r["ord"] for r in df.where("ord in (3, 59, 7) and source is not null").collect()} == {3, 7, 59}
    assert df.where("length(body) = 6 and ord <= 12").count() == 10
    some = spark.read.format(name).option("path", str(tmp_path / "in")).option("limit", 23).load()
    assert some.count() == 23 and some.where("ord >= 20").count() == 3
    source = plugin.ParquetItems()
    groups = lambda *f: [s.name[1] for s in source.splits(plugin.Context({"path": str(tmp_path / "in" / "a.parquet")}, None, f))]
    assert groups(("ord", ">", 19)) == [2, 3] and groups(("ord", "in", [1, 31])) == [0, 3] and groups(("ord", "=", 99)) == [] and groups(("source", "=", "s1"), ("ord", "<=", 9)) == [0]


def test_a_source_as_a_stream_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a", 0, 25)
    space, name = Workspace(spark), plugin.register(spark, plugin.ParquetItems)
    stream = lambda: spark.readStream.format(name).option("path", str(tmp_path / "in")).load().select("ord")
    rows, _ = keyed.run(stream(), space, "items", "append")
    assert sorted(r["ord"] for r in rows.collect()) == list(range(25))
    write(tmp_path / "in", "b", 25, 31)
    rows, query = keyed.run(stream(), space, "items", "append")
    assert sorted(r["ord"] for r in rows.collect()) == list(range(31)) and query.recentProgress[-1]["numInputRows"] == 6


def test_a_source_of_ones_own(spark):
    class Numbers(plugin.Source):
        id, type, channels, schema = "numbers_of_mine", "news", ("ai",), "n bigint"

        def splits(self, ctx):
            return [plugin.Split(k, 4) for k in range(int(ctx.options["parts"]))]

        def fetch(self, split, ctx):
            yield pa.RecordBatch.from_pydict({"n": [split.name * 4 + i for i in range(4)]})

    df = spark.read.format(plugin.register(spark, Numbers)).option("parts", 3).load()
    assert sorted(r["n"] for r in df.where("n % 2 = 0 and n > 3").collect()) == [4, 6, 8, 10]
    assert plugin.describe(Numbers) == '{"id": "numbers_of_mine", "type": "news", "channels": ["ai"]}'


# keyed state ----------------------------------------------------------------------------------------------------------

DAY = v.DAY


def outcome_rows(seed=1):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(6)}", DAY + k * DAY // 3, ok := rng.random() < 0.4, not ok and rng.random() < 0.7, rng.randrange(3)) for k in range(120)]


def as_frame(spark, rows):
    df = spark.createDataFrame(rows, "id string, at_s bigint, ok boolean, permanent boolean, item_count bigint")
    return df.withColumn("at_ts", F.timestamp_seconds("at_s")).drop("at_s")


REGISTRY = [(f"s{k}", "disabled" if k == 1 else "active", k != 1, k % 3, 0 if k == 1 else None, None) for k in range(7)]


def loop(rows):
    state = {i: {"turn": 0, "status": s, "enabled": e, "strikes": n, "disabled_s": d, "last_ok_s": o, "last_error": None} for i, s, e, n, d, o in REGISTRY}
    for i, at, ok, permanent, n in sorted(rows, key=lambda r: (r[1], r[2])):
        state[i], _ = keyed.transition(state[i], {"at_s": at, "ok": ok, "permanent": permanent, "item_count": n})
    return state


def test_source_health_as_state_by_key(spark):
    """Parts in order, rows within a part out of order; the stream goes on from its checkpoint each time, as after a restart."""
    rows = outcome_rows()
    parts = [rows[:50], rows[50:51], rows[51:]]
    for p in parts:
        random.Random(3).shuffle(p)
    registry = spark.createDataFrame(REGISTRY, "id string, status string, enabled boolean, strikes bigint, disabled_s bigint, last_ok_s bigint")
    out, late = keyed.fed([as_frame(spark, p) for p in parts], Workspace(spark), "health", lambda s: keyed.source_health(s, registry))
    want = loop(rows)
    got = {r["id"]: r.asDict() for r in keyed.last_turns(out.where("kind = 'outcome'"), "id").collect()}
    assert late == 0 and set(got) == {r[0] for r in rows}
    for i, r in got.items():
        assert {k: r[k] for k in want[i]} == want[i], i
    # timers: a source that is off and silent for the window is due; the first one was off from the start
    due = {(r["id"], r["disabled_s"]) for r in out.where("kind = 'reprobe'").collect()}
    assert ("s1", 0) in due or any(r[0] == "s1" and r[1] <= 7 * DAY for r in rows)
    assert all(d is not None and d + 7 * DAY <= rows[-1][1] + 40 * DAY for _, d in due)


def test_a_silent_source_is_due_and_late_outcomes_count_nothing(spark):
    registry = spark.createDataFrame(REGISTRY, "id string, status string, enabled boolean, strikes bigint, disabled_s bigint, last_ok_s bigint")
    far = 30 * DAY
    parts = [[("s0", DAY, True, False, 1)], [("s0", far, True, False, 1)], [("s0", far + 60, True, False, 0)], [("s2", 2 * DAY, False, True, 0), ("s0", far + 120, False, False, 0)]]
    out, late = keyed.fed([as_frame(spark, p) for p in parts], Workspace(spark), "health", lambda s: keyed.source_health(s, registry, "1 day"))
    rows = [r.asDict() for r in out.collect()]
    assert late == 1 and not any(r["id"] == "s2" for r in rows)
    assert [(r["id"], r["status"], r["disabled_s"]) for r in rows if r["kind"] == "reprobe"] == [("s1", "disabled", 0)]
    assert max((r["turn"], r["status"]) for r in rows if r["id"] == "s0") == (4, "failing")


def test_sources_share_keys_and_keep_their_own_timers(spark, monkeypatch):
    """Three sources of one key were disabled in one second: one comes back, two are due, once each; a fourth is off later."""
    monkeypatch.setattr(keyed, "SHARDS", 1)
    registry = spark.createDataFrame([(f"s{k}", "disabled", False, 3, DAY, None) for k in range(3)] + [("s3", "active", True, 2, None, None)], "id string, status string, enabled boolean, strikes bigint, disabled_s bigint, last_ok_s bigint")
    parts = [[("s0", 2 * DAY, True, False, 1)], [("s3", 3 * DAY, False, True, 0)], [("x", 9 * DAY + 60, True, False, 1)], [("x", 30 * DAY, True, False, 1)]]
    out, late = keyed.fed([as_frame(spark, p) for p in parts], Workspace(spark), "health", lambda s: keyed.source_health(s, registry))
    rows = [r.asDict() for r in out.collect()]
    assert late == 0 and sorted((r["id"], r["disabled_s"]) for r in rows if r["kind"] == "reprobe") == [("s1", DAY), ("s2", DAY), ("s3", 3 * DAY)]
    assert sorted((r["id"], r["turn"], r["status"], r["rediscover"]) for r in rows if r["kind"] == "outcome") == [("s0", 1, "active", False), ("s3", 1, "disabled", True), ("x", 1, "active", False), ("x", 2, "active", False)]


def test_decayed_weights_in_any_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(20 * DAY), rng.random()) for _ in range(200)]
    frame = lambda p: spark.createDataFrame(p, "item_id string, at_s bigint, w double").select("item_id", F.timestamp_seconds("at_s").alias("at_ts"), "w")
    out, _ = keyed.fed([frame(rows[:90]), frame(rows[90:100]), frame(rows[100:])], Workspace(spark), "weights", keyed.item_weights)
    got = {r["item_id"]: (r["at_s"], r["w"]) for r in keyed.last_turns(out, "item_id").collect()}
    for i in "xy":
        last = max(at for k, at, _ in rows if k == i)
        assert got[i][0] == last and got[i][1] == pytest.approx(sum(w * 0.5 ** ((last - at) / (7 * DAY)) for k, at, w in rows if k == i))
    assert set(got) == {"x", "y"}


def test_rows_before_and_behind_the_watermark(spark):
    """Repeats within the delay go; what is older than the watermark of the batch before is dropped and counted."""
    frame = lambda p: spark.createDataFrame(p, "key string, at_s bigint").select("key", F.timestamp_seconds("at_s").alias("at"))
    parts = [[("a", 10 * DAY), ("b", 11 * DAY), ("a", 10 * DAY)], [("a", 10 * DAY + 5), ("c", 20 * DAY)], [("d", 20 * DAY - 60), ("e", 3 * DAY), ("f", 21 * DAY)], [("g", 2 * DAY), ("h", 19 * DAY + 1)]]
    out, late = keyed.fed([frame(p) for p in parts], Workspace(spark), "once", lambda s: keyed.distinct_events(s, "key", "at", "2 days"), "append")
    assert sorted(r["key"] for r in out.collect()) == ["a", "b", "c", "d", "f", "h"] and late == 2
