import math

import pytest
from pyspark.sql import types as T

from tallyrun.functions import ExprError, cast, col, isnull, lit, parse, quadkey
from tallyrun.functions.expr import I64_MAX, I64_MIN, compile_expr

ROWS = [
    (1, 2, 1.5, 0.0, "a", True),
    (I64_MAX, 1, math.nan, 2.0, "true", False),
    (I64_MIN, -1, math.inf, -0.5, "12", None),
    (-7, 2, 1e-7, 3.0, "x'y", True),
    (5, 0, -2.0, 0.0, "1.5", False),
    (None, 3, None, 1.0, None, None),
]
SCHEMA = {"i": "i64", "j": "i64", "x": "f64", "y": "f64", "s": "str", "b": "bool"}
SPARK = T.StructType([T.StructField(n, {"i64": T.LongType(), "f64": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType()}[k]) for n, k in SCHEMA.items()])


@pytest.fixture(scope="module")
def values(spark):
    df = spark.createDataFrame(ROWS, SPARK).coalesce(1)

    def run(e):
        return [r[0] for r in df.select(compile_expr(parse(e) if isinstance(e, str) else e, SCHEMA)[0]).collect()]

    return run


def same(a, b):
    return len(a) == len(b) and all(x == y and type(x) is type(y) or isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(
    "text, want",
    [
        ("i + j", [3, I64_MAX, I64_MIN, -5, 5, None]),
        ("i - 1", [0, I64_MAX - 1, I64_MIN, -8, 4, None]),
        ("i * 2", [2, I64_MAX, I64_MIN, -14, 10, None]),
        ("i / j", [0, I64_MAX, I64_MAX, -3, None, None]),
        ("x / y", [math.inf, math.nan, -math.inf, 1e-7 / 3, -math.inf, None]),
        ("x == x", [True, False, True, True, True, None]),
        ("x != x", [False, False, False, False, False, None]),
        ("x > 0", [True, False, True, True, False, None]),
        ("s == null", [False, False, False, False, False, True]),
        ("null != s", [True, True, True, True, True, False]),
        ("b and i > 0", [True, False, False, False, False, None]),
        ("b or i > 0", [True, True, None, True, True, None]),
        ("not b", [False, True, None, False, True, None]),
        ("isnull(x)", [False, False, False, False, False, True]),
        ("cast(x, int)", [1, 0, I64_MAX, 0, -2, None]),
        ("cast(s, int)", [None, None, 12, None, None, None]),
        ("cast(s, float)", [None, None, 12.0, None, 1.5, None]),
        ("cast(s, bool)", [None, True, None, None, None, None]),
        ("cast(x, str)", ["1.5", "NaN", "inf", "0.0000001", "-2", None]),
        ("cast(x, bool)", [True, False, True, True, True, None]),
        ("cast(b, int)", [1, 0, None, 1, 0, None]),
        ("s == 'x\\'y'", [False, False, False, True, False, None]),
        ("1 + 2 * 3 - 4 / 2", [5] * 6),
        ("quadkey(0, 0, 1)", [3] * 6),
        ("quadkey(0, 0, 25)", [None] * 6),
    ],
)
def test_values(values, text, want):
    got = values(text)
    assert same(got, want), got


def test_operators_and_text_agree(values):
    for e, text in ((100 < col("i"), "i > 100"), (1 - col("x"), "1 - x"), (~(col("b") | (col("i") >= 5)), "not (b or i >= 5)"), (col("s") == None, "isnull(s)"), (cast(col("i"), "str"), "cast(i, str)")):  # noqa: E711
        assert same(values(e), values(text))
        assert same(values(e), values(str(e)))


def test_quadkey_clamps(values):
    assert values(quadkey(95.0, 0.0, 3)) == values(quadkey(85.06, 0.0, 3))


@pytest.mark.parametrize("text", ["", "i +", "i + 's'", "nope > 1", "b and 1", "i == s", "f(i)", "cast(i, date)", "not 3", "i ! j", "cast(i)", "(i", "9223372036854775808 > i"])
def test_errors(text):
    with pytest.raises(ExprError):
        compile_expr(parse(text), SCHEMA)


def test_literals_are_checked():
    with pytest.raises(TypeError):
        lit([1])
    with pytest.raises(ValueError):
        cast(col("i"), "date")
    with pytest.raises(TypeError):
        bool(col("i") > 1)
    assert str(isnull(col("i"))) == "isnull(i)"
