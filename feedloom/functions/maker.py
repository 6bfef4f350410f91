"""Signals of things that are built, and the points they give an item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import vocab as v

# fixed values: words that tell of hardware, and weaker ones that tell of building
HARDWARE = r"\b(?:DIY|3D[- ]?print(?:ed|ing|er)?s?|PCB|solder(?:ing|ed)?|breadboard|Arduino|Raspberry[- ]?Pi|ESP32|ESP8266|STM32|microcontroller|firmware|enclosure|schematic|servo|teardown|laser[- ]?cut|CNC|filament|gcode|breakout[- ]?board|GPIO|I2C|SPI|home[- ]?(?:automation|assistant)|self[- ]?host(?:ed|ing)?)\b"
BUILD = r"\b(?:build|built|builds|building|makes?|making|made|CAD|wiring|sensor|robot|how[- ]?to|tutorial|project|kit|hack|mod|flash(?:ing)?|retrofit)\b"
# fixed value: points from which an item is something to build
THRESHOLD = 3


def _any(channels: list[str]) -> Column:
    return F.arrays_overlap("topics", F.array(*map(F.lit, channels)))


def build_signal() -> Column:
    """Of items with pure and hard (is the source a maker's, or of maker channels): does the title tell of a build?"""
    context = _any([*v.HARD_CHANNELS, "ai-projects"]) | F.col("pure") | F.col("hard")
    return F.col("title").rlike("(?i)" + HARDWARE) | F.col("title").rlike("(?i)" + BUILD) & context


def points() -> Column:
    """Source, title, summary and kind add points; excluded sources and think pieces lose some."""
    thinks = F.size(F.filter("topics", lambda t: t.isin(v.THINK_CHANNELS))) > F.size("topics") / 2
    piece = thinks & ~_any(v.HARD_CHANNELS) & ~build_signal()
    parts = [(F.col("pure"), 3), (F.col("hard"), 1), (build_signal(), 2), (F.coalesce(F.col("summary").rlike("(?i)" + HARDWARE), F.lit(False)), 1), (F.col("kind") == "idea", 3), (F.col("excluded"), -5), (piece, -3)]
    return sum((F.when(cond, n).otherwise(0) for cond, n in parts), F.lit(0))
