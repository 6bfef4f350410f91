"""Functions on sources, channels and videos: types, ids, credibility, trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import vocab as v
from feedloom.functions import text


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def source_type(url: Column) -> Column:
    """arxiv, reddit and engineering blogs by host or path; else rss."""
    host = F.coalesce(text.host(url), F.lit(""))
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    blog = host.rlike(r"(^|\.)blog\.") | path.rlike(r"/blog(/|$)") | host.contains("eng")
    return F.when(host.contains("arxiv.org"), "arxiv").when(host.contains("reddit.com"), "reddit").when(blog, "eng-blog").otherwise("rss")


def video_id(url: Column) -> Column:
    """The eleven characters of a video's id in its usual places; null elsewhere."""
    places = [r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/(?:embed|live)/([A-Za-z0-9_-]{11})"]
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in places))


def is_short(url: Column) -> Column:
    return F.lower(url).rlike(r"^https?://((www|m)\.)?youtube\.com/shorts/")


def is_junk_video(kind: Column, title: Column) -> Column:
    """Raw clips among the videos, by their titles; other kinds are never junk."""
    # fixed values: what such titles say
    return (kind == "video") & (title.rlike(r"(?i)\(no audio\)") | title.rlike(r"(?i)\btesting video\b"))


def is_ignored(host: Column) -> Column:
    """Is the host, or a domain above it, a platform or infrastructure?"""
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.coalesce(F.arrays_overlap(above, F.array(*map(F.lit, v.IGNORED_DOMAINS))), F.lit(False))


def credibility(subscribers: Column, views: Column, likes: Column, age_days: Column, seconds: Column) -> Column:
    """Weighted sum of audience size (log, 10^3 to 10^7), likes per view (8 % is full), reach and recency (two years);
    videos under a minute get 85 % of it."""
    # fixed values: bounds and weights of the parts
    known = lambda x: F.coalesce(x, F.lit(0)) > 0
    size = F.when(known(subscribers), clamp01((F.log10(subscribers.cast("double")) - 3) / 4)).otherwise(0.0)
    liked = F.when(known(likes) & known(views), clamp01(likes / views / 0.08)).otherwise(0.0)
    reach = F.when(~known(views), 0.0).when(~known(subscribers), 0.5).otherwise(clamp01(views / subscribers))
    recent = F.when(age_days.isNull(), 0.5).otherwise(clamp01(1 - age_days / 730.0))
    total = 0.35 * size + 0.3 * liked + 0.2 * reach + 0.15 * recent
    return F.when(F.coalesce(seconds, F.lit(60)) < 60, total * 0.85).otherwise(total)


def transcript_rank(kind: Column) -> Column:
    """How good a transcript's format is: those for machines, then plain text, then pages."""
    # fixed values: the ranks
    k = F.lower(kind)
    return F.when(k.contains("vtt") | k.contains("subrip") | k.contains("srt") | k.contains("json"), 3).when(k.contains("html"), 1).otherwise(2)


def candidate_trust(url: Column, claimed: Column) -> Column:
    # fixed values: what counts without a claim, and what an encrypted address adds
    return clamp01(clamp01(F.coalesce(claimed, F.lit(0.5))) + F.when(url.startswith("https:"), 0.05).otherwise(0.0))


def feed_link(html: Column) -> Column:
    """The address in the first link tag of a feed's type."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), 1), lambda t: t.rlike(r"(?i)type=[\"']application/(rss|atom)\+xml"))
    return F.regexp_extract(F.get(tags, 0), r"(?i)href=[\"']([^\"']+)", 1)


def trust_band(trust: Column) -> Column:
    # fixed values: where the bands begin
    return F.when(trust >= 0.8, "high-trust").when(trust >= 0.6, "trusted").when(trust >= 0.4, "mid-trust").otherwise("provisional")


def trust_factors() -> Column:
    """(label, polarity) of what speaks for and against a source: url, trust, added_by, failures, n_items."""
    failing = F.col("failures") > 0
    rows = [("provenance", F.when(F.col("added_by") == "seed", "positive").otherwise("neutral")), ("transport", F.when(F.col("url").startswith("https:"), "positive").otherwise("caution")), ("reliability", F.when(failing, "caution").otherwise("positive")), ("track record", F.when(F.col("n_items") > 0, "positive").otherwise("neutral")), ("needs review", F.when((F.col("trust") >= 0.75) & failing, "caution"))]
    return F.filter(F.array(*(F.struct(F.lit(k).alias("label"), p.alias("polarity")) for k, p in rows)), lambda x: x["polarity"].isNotNull())
