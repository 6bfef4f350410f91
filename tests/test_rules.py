"""Rules of the feed, of sources and of drafts, against rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions import maker, sources, text
from feedloom.operators import feed, ground, health

DAY = v.DAY
ITEM = "id string, ord bigint, source string, title string, url string, published_s bigint, topics array<string>, entities array<string>, trust double, kind string, source_type string, score int, comments int, n_plain int, minutes bigint"


def item(k, title=None, minutes=10, n_plain=None, **own):
    row = {"id": f"i{k:02d}", "ord": k, "source": "src", "title": title or f"Wholly other title number {k} {'abcdefghijklmnopqrstuvwxyz'[k % 26] * 6}", "url": f"https://e.com/{k}", "published_s": v.NOW - DAY, "topics": ["ai"], "entities": [], "trust": None, "kind": "link", "source_type": "rss", "score": 0, "comments": 0, "n_plain": minutes * 225 * 6 if n_plain is None else n_plain, "minutes": minutes}
    return tuple((row | own)[c.split()[0]] for c in ITEM.split(", "))


def curated(spark, rows, events=()):
    ev = spark.createDataFrame(list(events), "event_id int, item_id string, type string, at_s bigint, dwell_ms double, device int")
    return {r["id"]: r for r in feed.curate(spark.createDataFrame(rows, ITEM), ev, v.NOW).collect()}


def test_curated_feed(spark):
    """Mirrors are one, stories are told, and only full reads that are long enough stay; makers may be shorter."""
    rows = [
        item(1, "Big lab releases model five with agentic tool use"),
        item(2, "Big lab releases model five featuring agentic tool use"),
        item(3, "Spring gardening tips for beginners", topics=["diy"]),
        item(4, "A mirrored article", source="one", score=3, entities=["p"], n_plain=9000),
        item(5, "A  Mirrored Article!", source="two", topics=["tech"], comments=9, entities=["q"], n_plain=8000),
        item(6, minutes=0, n_plain=0),  # a bare link
        item(7, minutes=4),
        item(8, minutes=5),
        item(9, minutes=3, source="hackaday"),
        item(10, minutes=3, topics=["embedded"]),
        item(11, minutes=3, topics=["ai-projects"]),
        item(12, minutes=2, source="hackaday"),
        item(13, minutes=9, n_plain=800),  # no full text
        item(14, minutes=0, n_plain=0, kind="video"),
        item(15, minutes=12, kind="video"),
        item(16, minutes=6, n_plain=700, kind="audio"),
    ]
    got = curated(spark, rows)
    assert set(got) == {f"i{k:02d}" for k in (1, 2, 3, 4, 8, 9, 10, 15)}
    assert got["i01"]["cluster_id"] == got["i02"]["cluster_id"] != got["i03"]["cluster_id"] and got["i01"]["cluster_size"] == 2
    one = got["i04"]
    assert one["topics"] == ["ai", "tech"] and one["entities"] == ["p", "q"] and (one["score"], one["comments"]) == (3, 9) and one["cluster_size"] == 1
    assert sorted(r["place"] for r in got.values()) == list(range(8))
    assert all(r["affinity"] == 0 for r in got.values())


def test_curated_sizes_and_taste_are_those_of_what_is_left(spark):
    """A story's dropped members don't lift it, and liking of dropped items tells nothing."""
    rows = [item(1, "Quantum chip breaks record again", topics=["quantum"]), item(2, "Quantum chip breaks record", minutes=1, topics=["finance"]), item(3, topics=["iot"]), item(4, minutes=1, topics=["iot", "tech"])]
    events = [(k, ["i04", "i03", "i02"][k % 3], "read", v.NOW - (k % 8) * DAY, None, 1) for k in range(30)]
    got = curated(spark, rows, events)
    assert set(got) == {"i01", "i03"} and got["i01"]["cluster_size"] == 1
    assert got["i03"]["affinity"] == pytest.approx(6.0) and got["i01"]["affinity"] == 0 and got["i03"]["place"] == 0


def test_curated_feed_has_video_near_the_top(spark):
    rows = [item(k, trust=1.0) for k in range(70)] + [item(k, trust=0.0, kind="video") for k in range(70, 73)]
    got = curated(spark, rows)
    assert sum(r["place"] < 60 for r in got.values() if r["kind"] == "video") == 2 and len(got) == 73
    assert curated(spark, []) == {}


def test_featured_needs_seven_minutes(spark):
    rows = [(f"i{k}", float(k), k, 5) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, total double, minutes int, n_plain int")
    assert {r["id"] for r in feed.featured(df, 50).collect()} == {f"i{k}" for k in range(7, 20)}


@pytest.mark.parametrize(("n_sources", "limit", "want"), [(3, 10, 3), (8, 10, 10), (9, 10, 10), (12, 10, 10), (7, 10, 7), (1, 2, 2)])
def test_one_per_source_fills_up_only_what_is_nearly_full(spark, n_sources, limit, want):
    rows = [(f"i{k:03d}", f"s{k % n_sources}", 100.0 - k) for k in range(n_sources * 3)]
    got = [r["id"] for r in feed.one_per_source(spark.createDataFrame(rows, "id string, source string, total double"), limit).collect()]
    assert len(got) == want and got[: min(n_sources, limit)] == [f"i{k:03d}" for k in range(min(n_sources, limit))]


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame([(k, *r) if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)], f"k int, {ddl}").orderBy("k").select(column).collect()]


def test_hardware_words(spark):
    titles = ["Home automation on a budget", "home-assistant tips", "self-hosted photos", "Selfhosting mail", "An ESP32 node", "homeopathy", "Marketing assistant"]
    assert values(spark, titles, "title string", F.col("title").rlike("(?i)" + maker.HARDWARE)) == [True, True, True, True, True, False, False]


def test_permanent_failures(spark):
    rows = [(False, "dns", None), (False, "not-a-feed", None), (False, "http-4xx", 404), (False, "http-4xx", 410), (False, "http-4xx", 403), (False, "http-5xx", 500), (False, "timeout", None), (True, "dns", 404), (None, None, None)]
    assert values(spark, rows, "ok boolean, error_kind string, http_status int", health.permanent()) == [True] * 4 + [False] * 5


def test_sources_without_a_status_are_off_where_they_are_not_enabled(spark):
    registry = spark.createDataFrame([("a", None, False, 4, None, None), ("b", "active", False, 4, None, None), ("c", None, True, 0, None, None)], "id string, status string, enabled boolean, strikes int, disabled_s bigint, last_ok_s bigint")
    assert {r["id"] for r in health.reprobe_eligible(registry, v.NOW).collect()} == {"a"}
    out = spark.createDataFrame([(i, True, 200, "ok", 3) for i in "abc"], "id string, ok boolean, http_status int, error_kind string, item_count int")
    assert {(r["id"], r["enabled"]) for r in health.reconcile(registry, out, v.NOW).collect()} == {("a", True), ("b", False), ("c", True)}


def test_junk_videos_and_ignored_domains(spark):
    rows = [("video", "Pool Testing Video 1 (No Audio)"), ("video", "River testing video"), ("link", "River testing video"), ("video", "Protesting videos of a pool test")]
    assert values(spark, rows, "kind string, title string", sources.is_junk_video(F.col("kind"), F.col("title"))) == [True, True, False, False]
    hosts = ["github.com", "gist.github.com", "notgithub.com", "en.wikipedia.org", "example.org", None, "com"]
    assert values(spark, hosts, "h string", sources.is_ignored(F.col("h"))) == [True, True, False, True, False, False, False]


def test_degenerate_chunks(spark):
    chunks = ["", "  \n", None, "we will go to the river and then we come home", "you you you you you you you", "aaaaaaaa bbbbbbbb", "ab cd ef gh ij", "ha " * 3 + "one two"]
    assert values(spark, chunks, "t string", text.is_degenerate(F.col("t"))) == [True, True, True, False, True, True, False, False]


def test_match_scores(spark):
    rows = [("Atlas", "at"), ("The atlas", "ATL"), ("a t l", "atl"), ("lta", "atl"), ("anything", "  "), (None, "a"), ("aXbXa", "aa"), ("a.c", ".")]
    assert values(spark, rows, "t string, x string", text.match_score(F.col("t"), F.col("x"))) == [0.0, 1.04, 2.0, None, 0.0, None, 2.0, 1.01]


def test_transcript_formats(spark):
    kinds = ["text/vtt", "application/x-subrip", "application/json", "text/plain", "text/html", "audio/x"]
    assert values(spark, kinds, "t string", sources.transcript_rank(F.col("t"))) == [3, 3, 3, 2, 1, 2]


def test_verdicts_in_their_order(spark):
    rows = [("a.example", "https://a.example/feed", ["ai"], 0.9), ("b.example", None, ["ai"], 0.9), ("c.example", "https://c.example/f", ["ai"], 0.9), ("d.example", "https://known.example/f", ["ai"], 0.9), ("e.example", "https://e.example/f", ["none"], 0.9), ("f.example", "https://f.example/f", ["x", "tech"], 0.5), ("g.example", "https://g.example/f", ["ai"], 0.39), ("h.example", None, [], 0.1), ("i.example", "https://i.example/f", None, 0.9)]
    df = spark.createDataFrame(rows, "domain string, feed_url string, channels array<string>, trust double")
    known = spark.createDataFrame([("c.example",), ("known.example",), (None,), ("c.example",)], "domain string")
    got = {r["domain"][0]: (r["decision"], r["reason"]) for r in ground.verdicts(df, known).collect()}
    no = lambda why: ("reject", why)
    assert got == {"a": ("add", "auto-add"), "b": no("no-feed"), "c": no("duplicate"), "d": no("duplicate"), "e": no("no-valid-channels"), "f": ("queue", "queue-review"), "g": no("low-trust"), "h": no("no-feed"), "i": no("no-valid-channels")}


def test_claims_against_the_ledger(spark):
    ledger = spark.createDataFrame([("u1", "x.com", "curated"), ("u2", "x.com", "curated"), ("u3", "y.com", "researched"), ("u4", "x.com", "researched"), ("u1", "x.com", "curated")], "url string, domain string, origin string")
    claims = [(1, 1, True, True), (1, 2, False, False), (2, 3, True, True), (3, 4, True, False), (3, 5, True, False), (4, 6, False, True), (5, 7, False, False), (6, 8, True, False), (6, 9, True, False), (6, 10, True, False)]
    cites = [(1, "u1"), (1, "u3"), (2, "u2"), (3, "u1"), (3, "u2"), (4, "u1"), (4, "u4"), (5, "u1"), (6, "u1"), (7, "u1"), (7, "made-up"), (8, "u1"), (8, "u3"), (9, "u1"), (9, "u3"), (10, "u2")]
    frames = (spark.createDataFrame(claims, "draft int, claim int, load_bearing boolean, high_stakes boolean"), spark.createDataFrame(cites, "claim int, url string"), ledger, spark.createDataFrame([(k,) for k in range(1, 9)], "draft int"))
    got = {r["draft"]: (r["n"], round(r["coverage"], 3), round(r["corroboration"], 3), r["unknown"], r["risky"], r["passed"]) for r in ground.claim_verdicts(*frames).collect()}
    assert got[1] == (2, 1.0, 1.0, 0, 0, True)
    assert got[2] == (1, 1.0, 0.0, 0, 1, False)  # one site and origin twice is one source
    assert got[3] == (2, 1.0, 0.5, 0, 0, False)
    assert got[4] == (1, 1.0, 1.0, 0, 0, True)  # high stakes count only where the argument leans on the claim
    assert got[5] == (1, 1.0, 1.0, 1, 0, False)
    assert got[6] == (3, 1.0, 0.667, 0, 0, True)
    assert got[7] == got[8] == (0, 0.0, 0.0, 0, 0, False)


def test_domains_to_follow(spark):
    rows = [(1, "https://www.new.example/a", "hn"), (2, "https://new.example/b", "reddit"), (3, "http://NEW.example/c", "hn"), (4, "https://new.example/d", "rss"), (5, "https://two.example/", "hn"), (6, "https://two.example/", "hn"), *[(k, "https://gist.github.com/x", "hn") for k in range(7, 12)], *[(k, "https://have.example/x", "hn") for k in range(12, 16)], (16, "nonsense", "hn"), (17, None, "hn")]
    known = spark.createDataFrame([("have.example",), (None,)], "domain string")
    assert {tuple(r) for r in ground.frequent_domains(spark.createDataFrame(rows, "id int, url string, source_type string"), known).collect()} == {("new.example", 3)}
    body = '<a href="https://a.example/1">x</a> <A HREF = \'http://a.example/2\'> <a href="/relative"> <a href="https://self.example/y"> <a href="https://t.co/z"> <a href="https://have.example">'
    rows = [(1, "https://self.example/p", body, 3.0), (2, "https://other.example/p", '<a href="https://a.example">', 3.0), (3, "https://other.example/q", '<a href="https://b.example">', 0.5), (4, None, None, 9.0)]
    got = {tuple(r) for r in ground.mined_domains(spark.createDataFrame(rows, "id int, url string, body string, total double"), known, 1.0).collect()}
    assert got == {("a.example", 2)}
