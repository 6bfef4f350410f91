"""Every query against its SQL, and operators against loops."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom import catalog
from feedloom import vocab as v
from feedloom.operators import catalogue, feed, graph, health, world
from feedloom.sources import files
from feedloom.streaming import streams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    q = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(q.fetchall(), names)


def test_components_by_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(40)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in graph.components(spark, graph.Workspace(spark), spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}


def test_cycles_of_any_length(spark):
    rng = random.Random(5)
    ring = [(i, (i + 1) % 20) for i in range(20)]
    edges = ring + [(3, 100), (100, 101), (200, 0), (7, 7), (300, 300)] + [(rng.randrange(400, 415), rng.randrange(400, 415)) for _ in range(16)]
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    got = [r["node"] for r in graph.cycles(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]
    assert sorted(got) == sorted(x for x in out if x in reach(x)) and set(range(20)) <= set(got)


def test_diversity_floor_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(f"i{k:03d}", rng.choice(["link", "link", "link", "video", "audio"] if k > 70 else ["link"]), 100.0 - k, k) for k in range(120)]
    want = [r[0] for r in rows]
    kind, score = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    end = v.FEATURED + v.LIST_WINDOW
    for k in ("video", "audio"):
        lack = v.MIN_PER_MEDIUM - sum(kind[i] == k for i in want[v.FEATURED : end])
        late = sorted((i for i in want[end:] if kind[i] == k), key=lambda i: (-score[i], want.index(i)))[: max(0, lack)]
        for i in late:
            want.remove(i)
        want[end - len(late) : end - len(late)] = late
    got = feed.diversity_floor(spark.createDataFrame(rows, "id string, kind string, total double, place bigint")).orderBy("place").collect()
    assert [r["id"] for r in got] == want


@pytest.mark.parametrize(
    ("before", "ok", "code", "n", "after"),
    [
        (("disabled", False, 3), True, None, 4, ("active", True, 0)),
        (("disabled", False, 3), True, None, 0, ("dormant", True, 0)),
        (("disabled", False, 3), False, 404, 0, ("disabled", False, 3)),
        (("active", True, 1), False, 503, 0, ("failing", True, 1)),
        (("active", True, 1), False, 410, 0, ("failing", True, 2)),
        (("failing", True, 2), False, 404, 0, ("disabled", False, 3)),
        (("failing", True, 2), None, None, 0, ("failing", True, 2)),
    ],
)
def test_health_transitions(spark, before, ok, code, n, after):
    registry = spark.createDataFrame([("s", *before, None, 5)], "id string, status string, enabled boolean, strikes int, disabled_s bigint, last_ok_s bigint")
    kind = None if code is None else f"http-{code // 100}xx"
    outcome = spark.createDataFrame([("s", ok, code, kind, n)] if ok is not None else [], "id string, ok boolean, http_status int, error_kind string, item_count int")
    r = health.reconcile(registry, outcome, v.NOW).first()
    assert (r["status"], r["enabled"], r["strikes"]) == after
    assert r["rediscover"] == (after[0] == "disabled" and before[0] != "disabled")


def test_empty_profile_below_the_gate(spark):
    events = spark.createDataFrame([(1, "d1", "open", v.NOW, None, 1)], "event_id int, item_id string, type string, at_s bigint, dwell_ms double, device int")
    items = spark.createDataFrame([("d1", ["ai"], ["x"])], "id string, topics array<string>, entities array<string>")
    assert feed.taste_profile(events, items, v.NOW).collect() == []


def test_theater_edges(spark):
    e = spark.createDataFrame([(1, 1_704_067_200, 50.0, 30.0), (2, 1_704_067_199, 50.0, 30.0), (3, 1_704_067_200, 50.1, 30.0)], "event_id int, at_s bigint, lat double, lng double")
    got = {r["event_id"]: r["theater"] for r in world.membership(e, world.theaters(spark)).collect()}
    assert got == {1: "alpha", 2: None, 3: "delta"}


@pytest.mark.parametrize("held", [1000, 0])
def test_equal_events_stay_apart(spark, monkeypatch, held):
    """Also where the areas are too many for an array and are joined."""
    monkeypatch.setattr(world, "HELD_AREAS", held)
    rows = [(1, 1_704_067_200, 50.0, 30.0), (1, 1_704_067_200, 50.0, 30.0), (2, 5, 0.0, 0.0)]
    got = world.membership(spark.createDataFrame(rows, "event_id int, at_s bigint, lat double, lng double"), world.theaters(spark)).collect()
    assert sorted((r["event_id"], r["theater"] or "") for r in got) == [(1, "alpha"), (1, "alpha"), (2, "")]


def test_places_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(f"i{k:04d}", rng.choice([1.0, 2.0, rng.random()])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id string, total double")
    got = {r["id"]: r["place"] for r in feed.ranked(df, feed.by_total()).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert feed.ranked(df.limit(0), feed.by_total()).collect() == []


def test_story_ids(spark):
    """Titles, shared entities, copies; the id is the hash of the sorted ids."""
    import hashlib

    rows = [(1, "a", "Red fox jumps high", ["x", "y"]), (2, "b", "red fox jumps", ["z"]), (3, "c", "Other", ["y", "x", "w"]), (4, "d", "Alone here", ["x"]), (5, "e", None, []), (6, "f", "red, fox jumps!", None)]
    df = spark.createDataFrame(rows, "ord bigint, id string, title string, entities array<string>")
    got = {r["id"]: (r["cluster_id"], r["cluster_size"]) for r in feed.story_clusters(df).collect()}
    name = lambda ids: hashlib.sha1("|".join(ids).encode()).hexdigest()[:12]
    assert got == {**{i: (name("abcf"), 4) for i in "abcf"}, "d": (name("d"), 1), "e": (name("e"), 1)}


def test_streams_go_on_from_their_folder(spark, tmp_path):
    """A restart sums on; a batch that is run again doesn't count twice."""
    import shutil

    def put(k, n):
        spark.createDataFrame([(i % 3, float(k)) for i in range(n)], "k int, w double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("k int, w double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return {r["k"]: (r["n"], r["w"]) for r in streams.rollup_batches(stream, ["k"], "w", "sums", space).collect()}

    space = graph.Workspace(spark)
    put(1, 9)
    assert run() == {k: (3, 3.0) for k in range(3)}
    put(2, 3)
    put(3, 3)
    want = {k: (5, 8.0) for k in range(3)}
    assert run() == want
    commits = sorted((int(x.name) for x in __import__("pathlib").Path(space.folder("sums-state"), "commits").iterdir() if x.name.isdigit()))
    for x in __import__("pathlib").Path(space.folder("sums-state"), "commits").glob(f"*{commits[-1]}*"):
        x.unlink()
    assert run() == want
    shutil.rmtree(tmp_path / "in")


def test_day_ledger_and_loose_files(spark, tmp_path):
    path = str(tmp_path / "days")
    day = lambda *r: spark.createDataFrame(list(r), "day int, n int")
    files.upsert_days(day((1, 5), (2, 6)), path)
    files.upsert_days(day((2, 7)), path)
    assert {tuple(r) for r in files.upsert_days(day((3, 1), (3, 1)), path).collect()} == {(1, 5), (2, 7), (3, 1)}
    (tmp_path / "raw").mkdir()
    for k, body in enumerate(['[{"id": "a", "n": 1}, {"id": null, "n": 2}, 7, {"id": "b", "n": "x"}]', "{}", "", "nonsense", '[\n {"id": "c"}\n]']):
        (tmp_path / "raw" / f"{k}.json").write_text(body)
    from pyspark.sql import functions as F

    good, bad = files.json_arrays(spark, str(tmp_path / "raw"), "id string, n int", F.col("id").isNotNull())
    assert {r["id"] for r in good.collect()} == {"a", "b", "c"} and bad.count() == 2
    assert files.json_arrays(spark, str(tmp_path / "none"), "id string", F.lit(True))[0].collect() == []


def test_title_links_are_all_near_titles(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    titles = [rng.sample(words[: rng.choice([6, 14])], rng.randrange(1, 7)) for _ in range(160)] + [[], ["w1"], ["w1"]]
    rows = spark.createDataFrame([(i, " ".join(t), []) for i, t in enumerate(titles)], "ord bigint, title string, entities array<string>")
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(frozenset(t), i)
    classes = sorted((c, s) for s, c in first.items() if s)
    near = {(a, b) for a, s in classes for b, t in classes if a < b and len(s & t) >= 0.6 * len(s | t) - 1e-9}
    got = feed.story_links(rows, 0.6).collect()
    assert {(r["x"], r["y"]) for r in got if r["kind"] == "title"} == near and sum(r["kind"] == "title" for r in got) == len(near)
    assert {(r["x"], r["y"]) for r in got if r["kind"] == "member"} == {(first[frozenset(t)], i) for i, t in enumerate(titles) if t and first[frozenset(t)] != i}


@pytest.mark.parametrize("seed", range(3))
def test_story_components_are_those_of_all_links(spark, seed):
    """Like titles are only compared between components, which leaves all stories as they are."""
    rng = random.Random(seed)
    pool = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(i, f"i{i}", " ".join(rng.sample(pool, rng.randint(1, 6))) if i % 9 else "", [f"e{rng.randrange(2 + 20 * (i % 2))}" for _ in range(2 - i % 3 // 2)] if i % 4 else []) for i in range(160)]
    rows += [(200, "x", "one two three four five", ["e0", "e1"]), (201, "y", "one two three four", []), (202, "z", "one two three", []), (203, "w", "quite alone", [])]
    items = spark.createDataFrame(rows, "ord bigint, id string, title string, entities array<string>")
    links = feed.story_links(items).select(F.col("x").alias("a"), F.col("y").alias("b"))
    want = sorted(map(tuple, graph.components(spark, graph.Workspace(spark), links).collect()))
    assert sorted(map(tuple, feed.story_components(items).collect())) == want and {n for n, _ in want} >= {201, 202}
    # titles of one component have no pairs, not even of their words
    one = spark.createDataFrame([(i, 0) for i, *_ in rows], "node bigint, component bigint")
    prefix = feed.title_prefixes(items, v.TITLE_JACCARD)[1]
    assert feed.title_bridges(prefix, one, v.TITLE_JACCARD).count() == 0 < feed.title_bridges(prefix, one.where("node < 20"), v.TITLE_JACCARD).count()


def test_orders_read_their_rows_once(spark):
    """Three sorts of a computed column: each row is computed once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        seen.add(1)
        return -x

    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), counted("id").alias("k"))
    got = catalogue.places(rows, {name: [F.col("k"), F.col("id")] for name in ("p", "q", "r")}).collect()
    assert sorted(r["p"] for r in got) == list(range(50)) and all(r["p"] == r["q"] == r["r"] == 49 - int(r["id"]) for r in got)
    assert seen.value == 50


@pytest.mark.parametrize("name", ["win_05_one_per_source", "win_06_balanced", "win_08_featured", "pip_07_rails"])
def test_scores_are_computed_once(spark, monkeypatch, name):
    """What selects from the scored items reads them several times, but each item is scored once."""
    from feedloom.plans import feeds, reading

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = spark.range(40).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.array(F.concat(F.lit("c"), F.col("id") % 3)).alias("topics"), (F.col("id") % 9).alias("minutes"), counted("id").alias("total"))
    monkeypatch.setattr(feeds, "scored", lambda *_: rows)
    monkeypatch.setattr(reading, "scored", lambda *_: rows)
    catalog.QUERIES[name](spark, SF).collect()
    assert seen.value == 40


def test_representatives_keep_their_own_fields(spark):
    columns = "group bigint, ord bigint, id string, n_plain int, trust double, score int, comments int, topics array<string>, entities array<string>, extra string"
    rows = [(1, 1, "a", 100, 0.9, 5, None, ["x"], [], "of a"), (1, 2, "b", 2000, None, 1, 7, ["y", "y"], ["e"], "of b"), (1, 3, "c", 2000, 0.4, 9, 0, None, ["f"], None), (4, 4, "d", 0, None, None, None, [], [], "of d")]
    got = {r["id"]: r for r in feed.representatives(spark.createDataFrame(rows, columns)).collect()}
    assert set(got) == {"b", "d"}
    b = got["b"]
    assert (b["score"], b["comments"], b["size"], b["first"], b["extra"], b["topics"], b["entities"]) == (9, 7, 3, 1, "of b", ["y", "x"], ["e", "f"])
    assert (got["d"]["size"], got["d"]["topics"], got["d"]["extra"]) == (1, [], "of d")
