"""Vocabularies and constants of the content model."""

from __future__ import annotations

# fixed values: channels, source types, item kinds
CHANNELS = ["history", "geopolitics", "politics", "geography", "science", "tech", "ai", "quantum", "data-science", "ds-sports", "data-strategy", "finance", "ideas", "diy", "3d-printing", "iot", "embedded", "ai-projects"]
SOURCE_TYPES = ["reddit", "hn", "rss", "eng-blog", "arxiv", "x", "news", "youtube", "podcast"]
ITEM_KINDS = ["link", "discussion", "paper", "idea", "video", "audio"]
# fixed values: channel groups of the dashboard; other channels count as science
GROUPS = {
    "world": ["history", "geopolitics", "politics", "geography"],
    "science": ["science", "tech", "quantum"],
    "data": ["data-science", "ds-sports", "data-strategy", "finance"],
    "make": ["ideas", "diy", "3d-printing", "iot", "embedded", "ai-projects"],
    "ai": ["ai"],
}
# fixed values: which channels a format serves
FORMATS = {
    "chronicle": ["history", "geopolitics", "geography"],
    "dispatch": ["data-science", "ds-sports", "finance", "science", "ai", "quantum"],
    "field-notes": ["geopolitics", "politics", "tech", "ai", "finance"],
    "teardown": ["tech", "ai", "quantum", "embedded", "data-science"],
    "primer": ["science", "ai", "quantum", "finance", "data-science"],
    "build-log": ["diy", "3d-printing", "iot", "embedded", "ai-projects"],
    "theater": ["history", "geopolitics", "politics", "geography"],
}
# fixed values: formats that are short, and those that recur, with their weekday (Monday is 0; None: each day)
BRIEF_FORMATS = ["field-notes"]
SERIES = {"chronicle": 6}
# fixed values: the format of channels that none serves, the channel of stories without one
OTHER_FORMAT, OTHER_CHANNEL = "field-notes", "ideas"
# fixed values: sizes of the front page's parts, how many a channel's row has at least
FRONT_FEATURED, WATCH, LISTEN, ROW_LEAST = 30, 12, 10, 3
# fixed values: words that say nothing about a title
STOPWORDS = ["the", "a", "an", "of", "to", "and", "or", "for", "in", "on", "with", "at", "by", "from", "as", "is", "are", "be", "this", "that", "new"]
# fixed values: weights of the score's terms, the preferred reading time, decay, gates
WEIGHTS = {"recency": 1.0, "trust": 1.0, "metrics": 1.0, "cluster": 0.5, "affinity": 6.0, "full_text": 1.25, "media": 0.9, "read_time": 2.0}
PEAK_MINUTES, SIGMA_MINUTES, HALF_LIFE_DAYS = 15.0, 10.0, 7.0
WORDS_PER_MINUTE, FULL_TEXT_CHARS, MIN_READ_MINUTES, MAKER_READ_MINUTES, FEATURE_MINUTES = 225, 800, 5, 3, 7
MIN_EVENTS, MIN_DAYS, DWELL_MS_PER_POINT, DWELL_CAP = 20, 5, 30_000, 5.0
SAME_TITLE_HOURS, TITLE_JACCARD, SHARED_ENTITIES, ARCHIVE_DAYS = 36, 0.6, 2, 14
FEATURED, LIST_WINDOW, MIN_PER_MEDIUM = 10, 50, 2
STRIKES, REPROBE_DAYS, SUMMARY_CHARS = 3, 7, 280
# fixed values: channels of makers, those that are hardware for sure, those of thought
HARD_CHANNELS = ["diy", "3d-printing", "iot", "embedded"]
THINK_CHANNELS = ["politics", "history", "geopolitics", "finance", "ideas"]
MAKER_CHANNELS = ["diy", "3d-printing", "iot", "embedded", "ai-projects"]
#: The clock is always a parameter; this one fits the tables' range (2024-01-31 00:00 UTC, in seconds).
NOW = 1_706_659_200
DAY = 86_400
# fixed values: sources that are makers' by themselves
MAKER_SOURCES = [
    "hackaday", "hackaday-io", "hackaday-home-automation", "adafruit-blog", "adafruit-blog-2", "sparkfun-blog", "make-magazine", "hackster-io-blog", "instructables-3d-printing", "prusa-blog", "prusa-blog-2",
    "arduino-blog", "arduino-blog-2", "raspberry-pi-blog", "random-nerd-tutorials", "espressif-blog", "pimoroni-blog", "bambulab-blog", "tindie-blog", "bald-engineer", "big-mess-o-wires", "voltlog",
    "notes-and-volts", "jeff-geerling-blog", "recantha-pi-pod", "bantam-tools-blog", "partsnotincluded", "diy-photography", "predictable-designs", "electronics-lab", "opensource-ecology", "r-3dprinting",
    "r-functionalprint", "r-diyelectronics", "r-raspberry-pi", "r-homeautomation", "r-iot", "r-embedded", "cnx-software-blog", "linuxgizmos-blog", "3dprintingindustry", "3dprintingmedia", "voxelmatters",
    "all3dp", "digikey-tech-forum", "low-tech-magazine", "hardwarebee", "ieee-spectrum-diy", "toms-hardware-all", "makezine-maker-news", "raspberrypi-news", "magpi-magazine", "robohub",
]
# fixed values: hosts of platforms, archives and infrastructure, which are no sources to follow
IGNORED_DOMAINS = [
    "github.com", "gitlab.com", "bitbucket.org", "raw.githubusercontent.com", "githubusercontent.com", "npmjs.com", "pypi.org", "wikipedia.org", "wikimedia.org", "archive.org", "web.archive.org", "doi.org",
    "arxiv.org", "ssrn.com", "semanticscholar.org", "scholar.google.com", "x.com", "twitter.com", "t.co", "facebook.com", "linkedin.com", "instagram.com", "reddit.com", "news.ycombinator.com", "youtube.com",
    "youtu.be", "bsky.app", "mastodon.social", "threads.net", "substackcdn.com", "cloudfront.net", "amazonaws.com", "googleusercontent.com", "gstatic.com", "gravatar.com", "imgur.com", "bit.ly", "google.com",
    "docs.google.com",
]
# fixed values: types of sources whose items lead to other sites
AGGREGATORS = ["hn", "reddit"]
