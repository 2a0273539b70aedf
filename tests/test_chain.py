import pytest
from pyspark.sql import functions as F

from tallyrun.errors import RegistrationError
from tallyrun.functions import col
from tallyrun.functions.types import schema_of
from tallyrun.model import EventSource
from tallyrun.operators import chain

E = EventSource("E", {"a": "i64", "b": "i64", "s": "str", "x": "f64"})


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 10, "p", 0.5), (2, None, "q", None), (None, 30, None, 2.0)], "a long, b long, s string, x double").withColumn("_tr_t", F.lit(1))


def run(df, d):
    out, schema = chain.apply(df, d.steps, {k: v for k, v in schema_of(df.schema).items() if not k.startswith("_tr_")})
    assert out.columns[-1] == "_tr_t" or "_tr_t" in out.columns
    return sorted(map(tuple, out.select(*schema).collect()), key=str), schema


def test_filter_drops_false_and_null(df):
    assert run(df, E.filter(col("a") > 1).select("a"))[0] == [(2,)]


def test_rename_is_atomic(df):
    rows, schema = run(df, E.select("a", "b").rename(a="b", b="a"))
    assert list(schema) == ["b", "a"] and (1, 10) in rows


def test_with_columns_in_order_of_names(df):
    rows, schema = run(df, E.select("a").with_columns(a=col("a") + 1, c=col("a") * 10, b=col("a") * 100))
    assert (2, 200, 20) in rows and schema == {"a": "i64", "b": "i64", "c": "i64"}


def test_cast_and_fillna(df):
    rows, schema = run(df, E.cast(x="int", a="str").fillna(b=0, s="none", x=9))
    assert schema == {"a": "str", "b": "i64", "s": "str", "x": "i64"}
    assert ("1", 10, "p", 0) in rows and ("2", 0, "q", 9) in rows and (None, 30, "none", 2) in rows


def test_select_and_drop_keep_order(df):
    assert list(run(df, E.select("x", "a"))[1]) == ["x", "a"]
    assert list(run(df, E.drop("b"))[1]) == ["a", "s", "x"]


@pytest.mark.parametrize("bad", [E.select("nope"), E.drop("nope"), E.rename(a="b"), E.rename(nope="c"), E.filter(col("a") + 1), E.filter(col("s") > 1), E.with_columns(y=col("nope")), E.cast(nope="int"), E.fillna(nope=1)])
def test_bad_chains(df, bad):
    with pytest.raises(RegistrationError) as e:
        run(df, bad)
    assert e.value.code == "invalid_expression"


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("a"), F.lit("s").alias("s"), F.lit(1.0).alias("x"), F.lit(1).cast("long").alias("b")).write.parquet(str(tmp_path / "e"))
    out, _ = chain.apply(spark.read.parquet(str(tmp_path / "e")), E.filter(col("a") > 90).select("a").steps, E.schema)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,90)" in plan and "ReadSchema: struct<a:bigint>" in plan
