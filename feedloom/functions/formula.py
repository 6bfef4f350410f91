"""Formulas that users write, compiled to Spark columns.

A formula has numbers, names of columns, pi and e, + - * / ^, brackets and a few functions. It is read once, on the
driver, into a column expression, so rows are computed in the JVM; nothing that is not named here can be reached.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>[-+*/^(),]))")
_NAN, _INFINITE = float("nan"), float("inf")


class FormulaError(ValueError):
    """What is wrong with a formula, in words."""


def _divided(a: Column, b: Column) -> Column:
    """Division of floating-point numbers: by zero it is infinite, or no number."""
    zero = F.when(F.isnan(a) | (a == 0), _NAN).when(a > 0, _INFINITE).otherwise(-_INFINITE)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _log(base: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, -_INFINITE).when(F.isnan(x) | (x < 0), _NAN).otherwise(base(F.when(x > 0, x)))


def _extreme(pick: Callable[..., Column]) -> Callable[..., Column]:
    def of(*xs: Column) -> Column:
        anything = xs[0] + sum(xs[1:], F.lit(0.0))
        lacks = F.lit(False)
        for x in xs:
            lacks |= F.isnan(x)
        return F.when(anything.isNull(), None).when(lacks, _NAN).otherwise(pick(*xs) if len(xs) > 1 else xs[0])

    return of


# fixed values: the functions, how many arguments they take (None: one or more), and the constants
_FUNCTIONS: dict[str, tuple[int | None, Callable[..., Column]]] = {
    "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan), "exp": (1, F.exp), "log": (1, _log(F.log10)), "ln": (1, _log(F.log)), "sqrt": (1, F.sqrt), "abs": (1, F.abs),
    "min": (None, _extreme(F.least)), "max": (None, _extreme(F.greatest)), "pow": (2, F.pow), "floor": (1, lambda x: _whole(F.floor, x)), "ceil": (1, lambda x: _whole(F.ceil, x)), "round": (1, lambda x: _whole(lambda y: F.floor(y + 0.5), x)),
}
_CONSTANTS = {"pi": math.pi, "e": math.e}
#: Numbers from here on are whole anyway, and some no longer fit a long.
_LARGE = 2.0**52


def _whole(rounded: Callable[[Column], Column], x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= _LARGE), x).otherwise(rounded(F.when(F.abs(x) < _LARGE, x)).cast("double"))


def _tokens(formula: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while formula[at:].strip():
        m = _TOKEN.match(formula, at)
        if not m:
            at += len(formula[at:]) - len(formula[at:].lstrip())
            raise FormulaError(f"unexpected character {formula[at]!r} at position {at}")
        found.append((m.lastgroup or "", m[m.lastgroup]))
        at = m.end()
    return found


class _Parser:
    """Sums of products of powers of signed values; a sign binds more tightly than a power, so -2^2 is 4."""

    def __init__(self, tokens: list[tuple[str, str]], columns: dict[str, Column]):
        self.tokens, self.columns, self.at, self.read = tokens, columns, 0, set()

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise FormulaError("the formula ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, sign: str) -> None:
        if self.peek() != sign:
            raise FormulaError(f"{sign!r} expected, not {self.peek() or 'the end'!r}")
        self.at += 1

    def total(self) -> Column:
        x = self.product()
        while self.peek() in ("+", "-"):
            x = x + self.product() if self.take()[1] == "+" else x - self.product()
        return x

    def product(self) -> Column:
        x = self.power()
        while self.peek() in ("*", "/"):
            x = x * self.power() if self.take()[1] == "*" else _divided(x, self.power())
        return x

    def power(self) -> Column:
        x = self.signed()
        if self.peek() == "^":
            self.at += 1
            return F.pow(x, self.power())
        return x

    def signed(self) -> Column:
        if self.peek() in ("+", "-"):
            return self.signed() if self.take()[1] == "+" else -self.signed()
        return self.value()

    def value(self) -> Column:
        kind, x = self.take()
        if kind == "number":
            if not math.isfinite(float(x)):
                raise FormulaError(f"invalid number {x!r}")
            return F.lit(float(x))
        if x == "(":
            inner = self.total()
            self.expect(")")
            return inner
        if kind != "name":
            raise FormulaError(f"a value expected, not {x!r}")
        if self.peek() == "(":
            return self.call(x)
        if x in _CONSTANTS:
            return F.lit(_CONSTANTS[x])
        if x in self.columns:
            self.read.add(x)
            return self.columns[x].cast("double")
        raise FormulaError(f"function {x!r} used without arguments" if x in _FUNCTIONS else f"unknown name {x!r}")

    def call(self, name: str) -> Column:
        if name not in _FUNCTIONS:
            raise FormulaError(f"unknown function {name!r}")
        self.expect("(")
        arguments = [] if self.peek() == ")" else [self.total()]
        while arguments and self.peek() == ",":
            self.at += 1
            arguments.append(self.total())
        self.expect(")")
        wanted, f = _FUNCTIONS[name]
        if wanted is None and not arguments or wanted is not None and len(arguments) != wanted:
            raise FormulaError(f"{name!r} takes {wanted or 'at least 1'} argument(s), not {len(arguments)}")
        return f(*arguments)


def compiled(formula: str, columns: dict[str, Column]) -> tuple[Column, set[str]]:
    """The formula as a column over the named columns, and the names that it reads. FormulaError says what isn't allowed.

    Values are doubles; a null in a column that is read makes the result null. Division by zero and logarithms of zero
    are infinite, what has no value is NaN.
    """
    parser = _Parser(_tokens(formula), columns)
    if not parser.tokens:
        raise FormulaError("empty formula")
    out = parser.total()
    if parser.at < len(parser.tokens):
        raise FormulaError(f"unexpected {parser.peek()!r} behind the end of the formula")
    return out, parser.read


def evaluated(formula: str, columns: dict[str, Column]) -> Column:
    """The formula's value where it is a finite number, else null."""
    x = compiled(formula, columns)[0]
    return F.when(~F.isnan(x) & (F.abs(x) < _INFINITE), x)
