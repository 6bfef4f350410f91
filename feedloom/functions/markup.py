"""Attributes of components in a draft: quotes that would break them, with line and column."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = re.compile(r"\A---\n.*?\n---\n", re.S)
_FENCE = re.compile(r"^([ \t]*)(`{3,}|~{3,})[^\n]*\n.*?^\1?\2[^\n]*$", re.M | re.S)
_CODE = re.compile(r"`[^`\n]*`")
_TAG = re.compile(r"<([A-Z][A-Za-z0-9]*)")
_SKIP = re.compile(r"(?:\s|/(?!>))*")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_:-]*\s*(=\s*)?")
_VALUE = {q: re.compile(rf"{q}(?:[^{q}\n\\]|\\(?![\"']))*") for q in "\"'"}
_BRACE = re.compile("[{}]")
ISSUE = "array<struct<line: int, column: int, tag: string, rule: string>>"


def masked(text: str) -> str:
    """The text with its head, fenced code and code in lines blanked; every place stays where it is."""
    for pattern in (_HEAD, _FENCE, _CODE):
        text = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return text


def _past_braces(text: str, at: int) -> int:
    depth = 0
    for m in _BRACE.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _fault(text: str, at: int) -> tuple[int, str] | None:
    """The first fault among the attributes from a place on, up to the tag's end."""
    while True:
        at = _SKIP.match(text, at).end()
        if at == len(text) or text[at] in "/>":
            return None
        name = _NAME.match(text, at)
        if not name:
            return at, "quote in value" if text[at] == '"' else "unexpected character"
        at = name.end()
        if not name[1] or at == len(text):
            continue
        if text[at] == "{":
            at = _past_braces(text, at)
        elif text[at] in _VALUE:
            end = _VALUE[text[at]].match(text, at).end()
            if text[end : end + 1] == "\\":
                return end, "escaped quote"
            if text[end : end + 1] != text[at]:
                return at, "unterminated value"
            at = end + 1


def faults(text: str | None) -> list[dict]:
    """(line, column, tag, rule) for each component with a fault, at most one a tag; both are counted from 1, in code points."""
    text = masked(text or "")
    found = ((m[1], _fault(text, m.end())) for m in _TAG.finditer(text))
    return [{"line": text.count("\n", 0, f[0]) + 1, "column": f[0] - text.rfind("\n", 0, f[0]), "tag": tag, "rule": f[1]} for tag, f in found if f]


def _each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(faults)


def lint(text: Column) -> Column:
    """Faults of each text, an empty list for null; regular expressions of Spark can't balance braces, hence Python."""
    return F.pandas_udf(_each, ISSUE)(text)
