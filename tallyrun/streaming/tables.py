"""A feature table over a stream of events.

The chain and the `where` conditions run as Spark columns; each entity's folds are kept in the state store
under its key, which the checkpoint makes durable. Each micro-batch gives the touched entities' rows. A source with
a dedupe key gets a step of its own before them, which keeps the expiry of each key's last accepted event. Where the
time column has a watermark, the state of an entity that is silent for longer than `cold_after` is removed; without
one no time tells that nothing older is still to come, so it stays, and the entity's next event starts it anew.
"""

from __future__ import annotations

import json
import math
import pickle
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.expr import condition
from ..functions.types import millis, schema_of
from ..model import DEDUPE_WINDOW, Table, duration_ms
from ..operators import chain
from ..operators.compile import SEQ, T
from .folds import fold_of, input_of


def plain(v):
    """A value as JSON has it: no NaN, times in milliseconds, bytes as null."""
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, datetime):
        return round(v.timestamp() * 1000)
    if isinstance(v, (bytes, bytearray)):
        return None
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.item() if hasattr(v, "item") else v


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: the time column with its watermark; the prefix lets row operators pass it on
_MARK = "_tr_wm"


def in_order(seq) -> tuple:
    """A tie breaker, of one or several values, as Spark orders it: field by field, nulls first."""
    values = tuple(seq) if isinstance(seq, tuple) else (seq,)
    return tuple((v is not None, 0 if v is None else v) for v in values)


class Dedupe(StatefulProcessor):
    """Events whose key was not accepted less than `window` ago, as planner.dedupe() has it; without a window, once."""

    def __init__(self, window: int | None):
        self.window = window

    def init(self, handle) -> None:
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            yield from rows
            return
        until = self.until.get()[0] if self.until.exists() else None
        before = until
        for r in sorted(rows, key=lambda r: (r[T], in_order(r[SEQ]))):
            if until is None or self.window is not None and r[T] >= until:
                until = r[T] + (self.window or 0)
                yield r
        if until != before:
            self.until.update((until,))

    def close(self) -> None:
        pass


def dedupe(df: DataFrame, key: str, window: int | None) -> DataFrame:
    """planner.dedupe() for a stream. Spark chains it with the folds only on RocksDB state, which is set for the session."""
    df.sparkSession.conf.set(_PROVIDER, _ROCKS)
    # events without a key all stay and need no state, so they are spread
    spread = df.withColumn("_tr_spread", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(T, SEQ), F.lit(1024))))
    return spread.groupBy(key, "_tr_spread").transformWithState(Dedupe(window), spread.schema, "Update", "None").drop("_tr_spread")


def stream_table(events: DataFrame, table: Table, time: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Streaming rows: the keys, `as_of` (time of the entity's last event, ms), `events` and `features` (JSON as of then).

    Use with writeStream in update mode. Within a micro-batch an entity's events are taken in order of (time, ties). As
    in the batch plan, events whose key is null or NaN belong to no entity.
    """
    t = F.col(time) if dict(events.dtypes)[time] == "bigint" else millis(F.col(time))
    seq = F.struct(*ties) if len(ties) > 1 else F.col(ties[0]) if ties else F.lit(0)
    known = schema_of(events.schema)
    timed = events.withColumn(T, t).withColumn(SEQ, seq)
    # the dedupe step's rows carry no watermark
    marked = "spark.watermarkDelayMs" in (events.schema[time].metadata or {}) and not table.root.dedupe_key
    if marked:
        timed = timed.withColumn(_MARK, F.col(time))
    if table.root.dedupe_key:
        timed = dedupe(timed, table.root.dedupe_key, duration_ms(table.root.dedupe_window or DEDUPE_WINDOW))
    df, schema = chain.apply(timed, table.steps, known)
    keys = list(table.keys) or ["_tr_all"]
    if not table.keys:
        df = df.withColumn("_tr_all", F.lit(1))
    for k in table.keys:
        df = df.filter(F.col(k).isNotNull() & ~F.isnan(k) if schema[k] == "f64" else F.col(k).isNotNull())
    wheres = sorted({str(f.where): f.where for f in table.features.values() if f.where is not None}.items())
    hits = {text: f"_tr_w{i}" for i, (text, _) in enumerate(wheres)}
    df = df.withColumns({hits[text]: condition(e, schema) for text, e in wheres}) if wheres else df
    features, cold = table.features, duration_ms(table.root.cold_after)
    fields = sorted({n for f in features.values() for n in (f.field, f.params.get("lat"), f.params.get("lon")) if n})
    # pandas has one NaN for a missing number and for a number that is none, so nulls get flags
    nulls = [F.col(n).isNull().alias(f"_tr_n_{n}") for n in fields]
    order = {f"_tr_q{i}": F.col(SEQ)[c] if len(ties) > 1 else F.col(SEQ) for i, c in enumerate(ties or (SEQ,))}
    by = [T, *order]
    evict = marked and cold is not None
    df = df.select(*keys, T, *[c.alias(n) for n, c in order.items()], *([_MARK] if evict else []), *[F.col(n).alias(f"_tr_f_{n}") for n in fields], *nulls, *hits.values())
    kinds = {n: schema[n] for n in fields}

    def value(n, r):
        v = r[f"_tr_f_{n}"]
        if r[f"_tr_n_{n}"]:
            return None
        return {"i64": int, "f64": float, "bool": bool}.get(kinds[n], lambda x: x)(v)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(by, kind="stable", na_position="first")
        folds, last, seen = pickle.loads(state.get[0]) if state.exists else (None, None, 0)
        for r in rows.to_dict("records"):
            now = int(r[T])
            if folds is None or cold is not None and last is not None and now - last > cold:
                folds, seen = {n: fold_of(f) for n, f in features.items()}, 0
            row = {n: value(n, r) for n in fields}
            for n, f in features.items():
                folds[n].update(now, input_of(f, row), f.where is None or bool(r[hits[str(f.where)]]))
            last, seen = now, seen + 1
        state.update((pickle.dumps((folds, last, seen)),))
        if evict:  # what comes after the watermark has passed this starts anew in any case
            state.setTimeoutTimestamp(max(last + cold, state.getCurrentWatermarkMs()) + 1)
        values = {n: plain(x.value(last)) for n, x in folds.items()}
        yield pd.DataFrame([[*key, last, seen, json.dumps(values)]], columns=[*keys, "as_of", "events", "features"])

    kind_of = {f.name: f.dataType for f in df.schema.fields}
    out = T_.StructType([*[T_.StructField(k, kind_of[k]) for k in keys], T_.StructField("as_of", T_.LongType()), T_.StructField("events", T_.LongType()), T_.StructField("features", T_.StringType())])
    kept = T_.StructType([T_.StructField("folds", T_.BinaryType())])
    timeout = GroupStateTimeout.EventTimeTimeout if evict else GroupStateTimeout.NoTimeout
    done = df.groupBy(*keys).applyInPandasWithState(run, out, kept, "update", timeout)
    return done.drop("_tr_all")


__all__ = ["plain", "stream_table"]
