"""Whole passes: assignments, a reader's own order, the front page, drafts."""

import pytest

from feedloom import vocab as v
from feedloom.operators import catalogue, drafts, feed
from tests.test_rules import DAY, ITEM, item

SCORED = "id string, title string, topics array<string>, total double, published_s bigint, cluster_id string"


def scored(spark, rows):
    return spark.createDataFrame([(i, f"Title {i}", t, s, v.NOW - k, c) for k, (i, t, s, c) in enumerate(rows)], SCORED)


def test_assignments(spark):
    """Columns first, with their stories used up; then stories by score; formats by liking or by length."""
    rows = [("a", ["history", "ai"], 9.0, "A"), ("b", ["geography"], 8.0, "B"), ("c", ["tech"], 7.0, "C"), ("d", ["tech"], 6.0, "C"), ("e", ["history"], 5.0, "E"), ("f", ["nowhere"], 12.0, "F"), ("g", [], 3.0, "G"), ("h", ["ai"], 1.0, "A")]
    got = [tuple(r) for r in catalogue.assignments(scored(spark, rows), None, 6).orderBy("turn", "pos").collect()]
    assert got == [
        (0, "chronicle", "history", "Title a", True, "a", 0),
        (0, "chronicle", "history", "Title a", True, "e", 1),
        (1, "teardown", "tech", "Title c", False, "c", 0),
        (1, "teardown", "tech", "Title c", False, "d", 1),
        (2, "field-notes", "nowhere", "Title f", False, "f", 0),
    ]
    liked = spark.createDataFrame([("theater", 0.5), ("chronicle", 0.5), ("field-notes", 0.9)], "format string, v double")
    got = {(r["format"], r["title"]) for r in catalogue.assignments(scored(spark, rows), liked, 1).collect()}
    assert got == {("field-notes", "Title c"), ("field-notes", "Title f"), ("chronicle", "Title a")}
    assert [tuple(r)[:6] for r in catalogue.assignments(scored(spark, []), None, 6).collect()] == [(0, "chronicle", "history", "chronicle column", True, None)]


def test_rerank_by_own_weights(spark):
    rows = [item(1, minutes=8, published_s=v.NOW, trust=0.0), item(2, minutes=8, published_s=v.NOW - 30 * DAY, trust=1.0), item(3, minutes=2), item(4, minutes=9, topics=["finance"]), item(5, minutes=9, topics=[])]
    df = feed.story_clusters(spark.createDataFrame(rows, ITEM))
    nobody = spark.createDataFrame([], "kind string, term string, v double")
    ids = lambda **k: [r["id"] for r in feed.rerank(df, nobody, v.NOW, **k).orderBy("place").collect()]
    assert ids(least_minutes=3, channels=["ai"], weights={"recency": 5.0}) == ["i01", "i02"]
    assert ids(least_minutes=3, channels=["ai"], weights={"recency": 0.0, "trust": 5.0}) == ["i02", "i01"]
    assert ids(group="data") == ["i04"] and ids(least_minutes=100) == []
    assert sorted(ids()) == ["i01", "i02", "i03", "i04", "i05"]
    assert ids(channels=["ai"], weights={t: 0.0 for t in v.WEIGHTS} | {"read_time": 1.0}, peak=2.0, sigma=1.0)[0] == "i03"


def test_front_page(spark):
    rows = [(f"i{k:03d}", f"t{k}", "https://youtu.be/abcdefghijk" if k % 10 == 1 else "https://e.com", ["link", "video", "audio"][k % 3], f"s{k % 4}", ["ai"] if k < 60 else ["iot"], 100.0 - k, 8, 9000, k) for k in range(63)]
    rows += [("short", "x", "https://www.youtube.com/shorts/1", "video", "s", ["ai"], 500.0, 9, 9000, 100), ("raw", "Pool Testing Video", "https://youtu.be/abcdefghijk", "video", "s", ["ai"], 500.0, 9, 9000, 101), ("brief", "x", "u", "link", "s", ["ai"], 500.0, 4, 900, 102), ("bare", "x", None, "link", "s", ["ai"], 0.0, 0, 0, 103)]
    df = spark.createDataFrame(rows, "id string, title string, url string, kind string, source string, topics array<string>, total double, minutes int, n_plain int, place bigint")
    got = feed.front_page(df).collect()
    part = lambda s: [r["id"] for r in sorted((r for r in got if r["section"] == s), key=lambda r: (r["rail"] or "", r["pos"]))]
    assert len(part("featured")) == 30 and part("featured")[0] == "i000" and {"i060", "i061", "i062"} <= set(part("featured"))
    rest = [r[0] for r in rows if r[0] not in {*part("featured"), "short", "raw", "brief"}]
    assert part("register") == rest and part("category") == [i for i in rest if i != "bare"]
    kept = {r[0]: r for r in rows}
    assert all(kept[i][3] == "video" and "youtu.be" in kept[i][2] for i in part("watch")) and len({kept[i][4] for i in part("listen")}) == len(part("listen")) == 4
    assert feed.front_page(df.limit(0)).collect() == []


def test_verified_drafts(spark):
    words = "word " * 1600
    texts = [(1, "<title>x</title> <figure> some text"), (2, "<p> no title <marquee>"), (3, f"<title>x</title> {words}"), (4, "<title>x</title>"), (5, None)]
    ledger = spark.createDataFrame([("u1", "high", "x.com", "curated"), ("u2", "low", "y.com", "researched")], "url string, tier string, domain string, origin string")
    cites = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "made-up"), (4, "u1")], "draft int, url string")
    claims = spark.createDataFrame([(1, 1, True, True), (4, 2, True, True)], "draft int, claim int, load_bearing boolean, high_stakes boolean")
    claimed = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u1")], "claim int, url string")
    out = drafts.verified(spark.createDataFrame(texts, "id int, html string"), cites, ledger, claims, claimed, ["title", "figure", "p"], ["figure", "table"])
    got = {r["id"]: r for r in out.collect()}
    assert {k: r["errors"] for k, r in got.items()} == {1: [], 2: ["no title", "not grounded", "unknown component marquee"], 3: ["too few components"], 4: ["claims do not hold"], 5: ["no title"]}
    assert [got[k]["ok"] for k in range(1, 6)] == [True, False, False, False, False]
    assert (got[1]["n_cited"], got[1]["grounded"], got[1]["independent"], got[1]["coverage"]) == (2, 1.0, 2, 1.0) and got[3]["coverage"] is None
    assert got[2]["grounded"] == pytest.approx(0.0) and got[5]["n_cited"] == 0
