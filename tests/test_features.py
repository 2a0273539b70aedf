"""Every aggregate: the Spark plan against the event-by-event fold, on streams with ties, nulls, NaN and idle keys."""

import json
import math
import random

import pytest
from pyspark.sql import types as T

from tallyrun.functions import col
from tallyrun.functions.expr import parse
from tallyrun.model import EventSource
from tallyrun.operators import features as f
from tallyrun.operators.compile import OPS
from tallyrun.operators.features import OPERATORS
from tallyrun.plans.planner import Stream, feature_table
from tallyrun.streaming.folds import fold_of, input_of

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("t", T.LongType()), ("seq", T.LongType()), ("key", T.StringType()), ("x", T.DoubleType()), ("i", T.LongType()), ("s", T.StringType()), ("b", T.BooleanType()), ("lat", T.DoubleType()), ("lon", T.DoubleType()))])
HIT = col("s") == "a"
NUMERIC = "sum mean min max var std first last rate_of_change twa delta_from_prev trend trend_residual outlier_count value_change_count z_score seasonal_deviation".split()


def features(where):
    w = {"where": where}
    out = {op: getattr(f, op)("x", **w) for op in NUMERIC}
    out |= {f"{op}_i": getattr(f, op)("i", **w) for op in ("sum", "min", "max", "last", "value_change_count")}
    out |= {f"{op}_win": getattr(f, op)("x", window="1h", **w) for op in ("sum", "mean", "min", "max", "var", "std")}
    out |= {op: getattr(f, op)(**w) for op in "first_seen last_seen age has_seen time_since streak max_streak negative_streak inter_arrival_stats hour_of_day_histogram dow_hour_histogram count ratio".split()}
    out |= {"count_win": f.count(window="1h", **w), "ratio_win": f.ratio(window="50m", **w), "min_b": f.min("b", **w), "max_s": f.max("s", **w)}
    out |= {"unique": f.n_unique("s", **w), "unique_win": f.n_unique("i", window="2h", **w), "q": f.quantile("x", q=0.3, **w), "q_win": f.quantile("i", q=0.5, window="3h", **w)}
    out |= {"top": f.top_k("s", k=2, **w), "top_win": f.top_k("i", k=3, window="3h", **w), "bloom": f.bloom_member("s", **w), "entropy": f.entropy("s", **w), "entropy_win": f.entropy("i", window="2h", **w)}
    out |= {"first_n": f.first_n("x", n=3, **w), "last_n": f.last_n("i", n=4, **w), "recent": f.most_recent_n("s", n=2, **w), "lag": f.lag("i", n=2, **w), "since_n": f.time_since_last_n(n=2, **w), "near": f.first_seen_in_window(window="30m", **w)}
    for op in ("ewma", "ema", "ewvar", "ew_zscore", "decayed_sum"):
        out[op] = getattr(f, op)("x", half_life="10m", **w)
    out |= {"short": f.ewvar("x", half_life="1s", **w), "decayed": f.decayed_count(half_life="10m", **w), "burst": f.burst_count(sub_window="10m", **w)}
    out |= {"hist": f.histogram("x", buckets=[-1.0, 0.5, 2.0], **w), "mix": f.event_type_mix("s", **w), "mix_some": f.event_type_mix("s", categories=["a", "c"], **w), "mix_cap": f.event_type_mix("i", max_categories=2, **w), "sample": f.reservoir_sample("i", samples=3, **w)}
    at = {"lat": "lat", "lon": "lon"}
    out |= {"speed": f.geo_velocity(**at, **w), "path": f.geo_distance(**at, **w), "area": f.geo_spread(**at, **w), "home": f.distance_from_home(**at, samples=3, **w)}
    return out


def stream(seed, n=240):
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000_000
    for seq in range(n):
        t += rng.choice([0, 0, 500, 20_000, 90_000, 700_000])
        key = rng.choice(["k1", "k1", "k2", "k3", None])
        x = rng.choice([None, round(rng.gauss(0, 2), 3), round(rng.gauss(0, 2), 3), 1.5, 1.5])
        rows.append((t, seq, key, x, rng.choice([None, 1, 2, 3, 7]), rng.choice(["a", "b", "c", None]), rng.choice([True, False, None]), rng.choice([None, rng.uniform(-80, 80)]), rng.uniform(-180, 180)))
    rows.append((t, n, "lonely", None, None, "z", None, None, None))
    return rows


def folded(rows, feats):
    now, states = max(r[0] for r in rows), {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        row = dict(zip((c.name for c in SCHEMA), r, strict=True))
        if row["key"] is None:
            continue
        own = states.setdefault(row["key"], {n: fold_of(x) for n, x in feats.items()})
        for n, x in feats.items():
            own[n].update(row["t"], input_of(x, row), x.where is None or row["s"] == "a")
    return {k: {n: s.value(now) for n, s in own.items()} for k, own in states.items()}


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-8) or math.isnan(a) and math.isnan(b))
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


@pytest.mark.parametrize("where", [None, HIT], ids=["all", "where"])
@pytest.mark.parametrize("seed", [1, 2])
def test_plan_matches_fold(spark, seed, where):
    compare(spark, seed, where, None)


def test_parts_match_fold(spark):
    compare(spark, 1, HIT, 7)


def compare(spark, seed, where, parts):
    rows, feats = stream(seed), features(where)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["key"]: r.asDict(recursive=True) for r in feature_table(Stream(df, "t", ("seq",)), ("key",), feats, parts=parts).collect()}
    want = folded(rows, feats)
    assert got.keys() == want.keys()
    wrong = [(k, n, got[k][n], v) for k, own in want.items() for n, v in own.items() if not close(got[k][n], v)]
    assert not wrong, wrong[:5]


def test_every_operator_has_a_plan_and_a_test():
    assert set(OPS) == OPERATORS
    assert {x.op for x in features(None).values()} | {"ema"} == OPERATORS


def test_nan_values(spark):
    rows = [(i * 1000, i, "k", v, i, "a", None, None, None) for i, v in enumerate([1.0, math.nan, 3.0, math.nan, math.nan, 2.0])]
    feats = {"min": f.min("x"), "max": f.max("x"), "changes": f.value_change_count("x"), "hist": f.histogram("x", buckets=[2.0]), "q": f.quantile("x", q=0.5)}
    r = feature_table(Stream(spark.createDataFrame(rows, SCHEMA), "t", ("seq",)), ("key",), feats).first()
    assert (r["min"], r["max"], r["changes"], r["hist"], r["q"]) == (1.0, 3.0, 5, {"<2": 1, ">=2": 5}, 2.0)


def test_haversine_of_two_cities(spark):
    rows = [(0, 0, "k", 1.0, 1, "a", None, 40.7128, -74.0060), (3_600_000, 1, "k", 1.0, 1, "a", None, 51.5074, -0.1278)]
    r = feature_table(Stream(spark.createDataFrame(rows, SCHEMA), "t", ("seq",)), ("key",), {"km": f.geo_distance(lat="lat", lon="lon"), "kmh": f.geo_velocity(lat="lat", lon="lon")}).first()
    assert abs(r["km"] - 5570) < 20 and math.isclose(r["km"], r["kmh"])


def test_windows_go_by_buckets(spark):
    rows = [(t, t, "k", 1.0, 1, "a", None, None, None) for t in (0, 999, 1000, 64_500)]
    r = feature_table(Stream(spark.createDataFrame(rows, SCHEMA), "t", ("seq",)), ("key",), {"n": f.count(window="64s")}).first()
    assert r["n"] == 2  # the bucket that starts at 0 is 64 s and more behind 64.5 s


def test_global_and_empty_tables(spark):
    df = spark.createDataFrame(stream(3), SCHEMA)
    feats = {"n": f.count(), "kinds": f.n_unique("s"), "last": f.last("i"), "top": f.top_k("s", k=1)}
    assert len(feature_table(Stream(df, "t", ("seq",)), (), feats).collect()) == 1
    assert feature_table(Stream(df.limit(0), "t", ("seq",)), (), feats).collect() == []
    assert feature_table(Stream(df.limit(0), "t", ("seq",)), ("key",), feats).collect() == []


def test_cold_entities_start_again(spark):
    rows = [(t, t, "k", 1.0, 1, "a", None, None, None) for t in (0, 1000, 12_000, 22_000, 32_001)]
    src = EventSource("E", {"x": "f64"}, cold_after="10s")
    for parts in (None, 3):
        assert feature_table(Stream(spark.createDataFrame(rows, SCHEMA), "t", ("seq",)), ("key",), {"n": f.count()}, source=src, parts=parts).first()["n"] == 1


def test_dedupe_does_not_extend(spark):
    rows = [(t, i, "k", 1.0, 1, s, None, None, None) for i, (t, s) in enumerate([(0, "a"), (5000, "a"), (9999, "a"), (10_000, "a"), (12_000, "b"), (12_001, None), (12_002, None)])]
    src = EventSource("E", {"s": "str"}, dedupe_key="s", dedupe_window="10s")
    assert feature_table(Stream(spark.createDataFrame(rows, SCHEMA).repartition(3), "t", ("seq",)), ("key",), {"n": f.count()}, source=src).first()["n"] == 5


def test_one_shuffle_for_ordered_features(spark):
    feats = {"ewma": f.ewma("x", half_life="1m"), "lag": f.lag("x", n=1), "twa": f.twa("x"), "run": f.streak(where=HIT), "path": f.geo_distance(lat="lat", lon="lon"), "n": f.count()}
    df = spark.createDataFrame(stream(4), SCHEMA)
    plan = feature_table(Stream(df, "t", ("seq",)), ("key",), feats, query_time=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_values_are_json(spark):
    rows = folded(stream(5), features(parse("s == 'a'")))
    assert json.dumps(rows["lonely"])


@pytest.mark.parametrize("bad", [lambda: f.sum("x", window="0s"), lambda: f.sum("x", window="5 min"), lambda: f.quantile("x", q=1.0), lambda: f.top_k("x", k=0), lambda: f.first_n("x", n=0), lambda: f.histogram("x", buckets=[2, 1]), lambda: f.histogram("x", buckets=[]), lambda: f.ewma("x", half_life="forever"), lambda: f.outlier_count("x", sigma=0)])
def test_bad_arguments(bad):
    with pytest.raises(ValueError):
        bad()


def test_old_names_warn():
    with pytest.warns(DeprecationWarning):
        assert f.percentile("x", p=0.5).params["q"] == 0.5
    with pytest.warns(DeprecationWarning):
        assert f.count_distinct("x").op == "n_unique"
