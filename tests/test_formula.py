"""Formulas against Python's arithmetic, and what they must not say."""

import math
import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions.formula import FormulaError, compiled, evaluated

FORMULAS = {
    "1 + 2 * 3": lambda x, y: 7.0,
    "2 ^ 3 ^ 2": lambda x, y: 512.0,
    "-2 ^ 2": lambda x, y: 4.0,
    "-(2 ^ 2)": lambda x, y: -4.0,
    "2 ^ -1": lambda x, y: 0.5,
    "8 / 4 / 2": lambda x, y: 1.0,
    "10 - 4 - 3": lambda x, y: 3.0,
    "+ - + x": lambda x, y: -x,
    "x*y - 1e3*.5 + 2.": lambda x, y: x * y - 498.0,
    "min(x, y, 1) + max(x) * pow(y, 2)": lambda x, y: min(x, y, 1) + x * y**2,
    "sin(pi / 2) + cos(0) + ln(e) + log(1000)": lambda x, y: 6.0,
    "sqrt(abs(x)) + exp(-abs(y))": lambda x, y: math.sqrt(abs(x)) + math.exp(-abs(y)),
    "floor(x) + ceil(y) + round(2.5) + round(-2.5)": lambda x, y: math.floor(x) + math.ceil(y) + 3 - 2,
    "tan(x) / (1 + y^2)": lambda x, y: math.tan(x) / (1 + y * y),
    "round(1e300)": lambda x, y: 1e300,
}


def test_values(spark):
    rng = random.Random(3)
    rows = [(k, rng.uniform(-5, 5), rng.uniform(-5, 5)) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    out = df.select("k", *(compiled(f, {"x": F.col("x"), "y": F.col("y")})[0].alias(str(n)) for n, f in enumerate(FORMULAS))).collect()
    for r in out:
        for n, f in enumerate(FORMULAS.values()):
            assert r[str(n)] == pytest.approx(f(*rows[r["k"]][1:])), list(FORMULAS)[n]


def test_what_has_no_number(spark):
    df = spark.createDataFrame([(0.0, None)], "x double, y double")
    columns = {c: F.col(c) for c in "xy"}
    raw = lambda f: df.select(compiled(f, columns)[0]).first()[0]
    assert raw("1 / x") == math.inf and raw("-1 / x") == -math.inf and math.isnan(raw("x / x")) and raw("ln(x)") == -math.inf and math.isnan(raw("log(x - 1)")) and math.isnan(raw("sqrt(x - 1)"))
    assert math.isnan(raw("max(1, x / x)")) and raw("y + 1") is None and raw("min(x, y)") is None
    assert all(df.select(evaluated(f, columns)).first()[0] is None for f in ("1 / x", "x / x", "y", "exp(1000)"))
    assert compiled("x + pi", columns)[1] == {"x"}


@pytest.mark.parametrize(
    ("formula", "says"),
    [("", "empty"), ("  ", "empty"), ("1 2", "unexpected '2'"), ("1 +", "ends too early"), ("* 2", "a value expected"), ("(1", "expected"), ("1)", "unexpected ')'"), ("z", "unknown name"), ("sin", "without arguments"), ("eval(1)", "unknown function"), ("sin()", "takes 1"), ("sin(1, 2)", "takes 1"), ("pow(1)", "takes 2"), ("min()", "at least 1"), ("x.y", "unexpected character '.'"), ("x; y", "unexpected character ';'"), ("1, 2", "unexpected ','"), ("__class__", "unknown name"), ("1e999", "invalid number"), ("sin(1,)", "a value expected"), ("x[0]", "unexpected character '['")],
)
def test_what_is_not_allowed(spark, formula, says):
    with pytest.raises(FormulaError, match=".*" + "".join("\\" + c if c in "()[]." else c for c in says)):
        compiled(formula, {"x": F.col("x"), "y": F.col("y")})
