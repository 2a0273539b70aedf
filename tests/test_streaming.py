"""The streaming table against the batch plan, over a restart from its checkpoint."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tallyrun.functions import col
from tallyrun.model import EventSource, Table
from tallyrun.operators import features as f
from tallyrun.plans.planner import Stream, feature_table
from tallyrun.streaming import stream_table
from tallyrun.streaming.tables import plain

from .test_features import SCHEMA, close, features, stream

E = EventSource("E", {"t": "i64", "seq": "i64", "key": "str", "x": "f64"})
FEATURES = {"n": f.count(), "big": f.count(where=col("x") > 0), "total": f.sum("x"), "mean": f.mean("x"), "ewma": f.ewma("x", half_life="1m"), "run": f.streak(where=col("x") > 0), "last": f.last("x"), "q": f.quantile("x", q=0.5), "back": f.last_n("x", n=2)}


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i * 7000, i, f"k{i % 3}", math.sin(i) if i % 5 else None) for i in range(60)]
    schema = "t long, seq long, key string, x double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = Table("T", ("key",), E, (), FEATURES)

    def turn(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        done = stream_table(spark.readStream.schema(schema).parquet(src), table, "t", ("seq",))
        q = done.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).start()
        q.awaitTermination()

    turn(rows[:25])
    turn(rows[25:])  # a new query goes on from the checkpoint
    got = spark.read.parquet(out)
    latest = {r.key: r for r in got.groupBy("key").agg(F.max_by(F.struct("events", "features", "as_of"), "events").alias("r")).select("key", "r.*").collect()}
    for key, r in latest.items():
        own = [x for x in rows if x[2] == key]
        want = feature_table(Stream(spark.createDataFrame(own, schema), "t", ("seq",)), ("key",), FEATURES).first().asDict()
        have = json.loads(r.features)
        assert r.events == len(own) and r.as_of == own[-1][0]
        for name, v in want.items():
            if name != "key":
                assert have[name] == v or (isinstance(v, list) and len(v) == len(have[name])) or math.isclose(have[name], v, rel_tol=1e-9), name


@pytest.mark.parametrize("window", ["1m", None, "forever"])
def test_stream_drops_resent_events(spark, tmp_path, window):
    """Resent events, in one micro-batch and over several, count as in the batch plan; events without a key all count."""
    source = EventSource("E", E.schema | {"id": "str"}, dedupe_key="id", dedupe_window=window)
    features = {"n": f.count(), "last": f.last("seq")}
    rows = [(i * 5000, i, f"k{i % 2}", [None, math.nan, 1.5][i % 3] if i > 30 else float(i), None if i % 7 == 0 else f"e{i % 9}") for i in range(50)]
    rows += [(t, seq + 100, k, x, e) for t, seq, k, x, e in rows[45:]]
    schema = "t long, seq long, key string, x double, id string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = Table("T", ("key",), source, (), features)
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        done = stream_table(spark.readStream.schema(schema).parquet(src), table, "t", ("seq",))
        done.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).start().awaitTermination()
    latest = spark.read.parquet(out).groupBy("key").agg(F.max_by("features", "events").alias("features")).collect()
    want = {r.key: r.asDict() for r in feature_table(Stream(spark.createDataFrame(rows, schema), "t", ("seq",)), ("key",), features, source=source).collect()}
    assert {r.key: json.loads(r.features)["n"] for r in latest} == {k: r["n"] for k, r in want.items()}
    assert {r.key: json.loads(r.features)["last"] for r in latest} == {k: r["last"] for k, r in want.items()}


def run_stream(spark, tmp_path, parts, schema, make):
    """Each part in a query of its own from one checkpoint; returns the folder of all output rows and the last progress."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        done = make(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src))
        q = done.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).start()
        q.awaitTermination()
    return out, q.lastProgress


def test_all_operators_with_both_rules(spark, tmp_path):
    """Every operator, with deduplication and cold entities, over two micro-batches, equals the batch plan as of each entity's last event."""
    kinds = {"t": "i64", "seq": "i64", "key": "str", "x": "f64", "i": "i64", "s": "str", "b": "bool", "lat": "f64", "lon": "f64"}
    source = EventSource("E", kinds, dedupe_key="i", dedupe_window="1m", cold_after="25m")
    feats = features(None)
    rows = stream(7)
    out, _ = run_stream(spark, tmp_path, (rows[:100], rows[100:]), SCHEMA, lambda df: stream_table(df, Table("T", ("key",), source, (), feats), "t", ("seq",)))
    latest = spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("as_of", "features"), "as_of").alias("r")).collect()
    assert {r.key for r in latest} == {"k1", "k2", "k3", "lonely"}
    events = spark.createDataFrame(rows, SCHEMA)
    for key, (as_of, text) in latest:
        want = feature_table(Stream(events, "t", ("seq",)), ("key",), feats, source=source, query_time=as_of, only=F.col("key") == key).first().asDict(recursive=True)
        have = json.loads(text)
        wrong = [(key, n, have[n], v) for n, v in want.items() if n != "key" and not close(plain(v), have[n])]
        assert not wrong, wrong[:5]


def test_order_of_ties_and_keys_that_are_none(spark, tmp_path):
    schema = "t long, a long, b string, key double, x double"
    rows = [(0, 10, "y", 1.0, 1.0), (0, 9, "z", 1.0, 2.0), (0, 10, "x", 1.0, 3.0), (0, None, "x", 1.0, 4.0), (0, 1, "x", math.nan, 5.0), (0, 1, "x", None, 6.0)]
    table = Table("T", ("key",), EventSource("E", {"t": "i64", "a": "i64", "b": "str", "key": "f64", "x": "f64"}), (), {"all": f.last_n("x", n=9)})
    out, _ = run_stream(spark, tmp_path, (rows,), schema, lambda df: stream_table(df, table, "t", ("a", "b")))
    got = spark.read.parquet(out).collect()
    want = feature_table(Stream(spark.createDataFrame(rows, schema), "t", ("a", "b")), ("key",), table.features).collect()
    assert [(r.key, json.loads(r.features)["all"]) for r in got] == [(r.key, r["all"]) for r in want] == [(1.0, [4.0, 2.0, 3.0, 1.0])]


def test_silent_entities_leave_the_state(spark, tmp_path):
    """With a watermark the state of an entity that went cold is removed, and its next event starts anew either way."""
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "ts timestamp, key string"
    table = Table("T", ("key",), EventSource("E", {"ts": "datetime", "key": "str"}, cold_after="10s"), (), {"n": f.count()})
    parts = ([(at(0), f"k{i}") for i in range(20)], [(at(5), "k0"), (at(100), "new")], [(at(101), "new"), (at(102), "k1")])
    out, progress = run_stream(spark, tmp_path, parts, schema, lambda df: stream_table(df.withWatermark("ts", "1 second"), table, "ts"))
    assert progress["stateOperators"][0]["numRowsTotal"] == 2
    latest = {r.key: json.loads(r.features)["n"] for r in spark.read.parquet(out).groupBy("key").agg(F.max_by("features", "as_of").alias("features")).collect()}
    assert latest["k0"] == 2 and latest["new"] == 2 and latest["k1"] == 1 and latest["k5"] == 1
