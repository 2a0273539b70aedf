"""From a source DataFrame and a table's declaration to the table's rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import millis, schema_of
from ..model import DEDUPE_WINDOW, EventSource, Feature, Table, duration_ms
from ..operators import chain
from ..operators.compile import NOW, OPS, SEQ, Ordered, Plan, T
from . import ordered

ALL = "_tr_all"


@dataclass(frozen=True)
class Stream:
    """A bound source: its rows, the column of their arrival time and what breaks ties."""

    df: DataFrame
    time: str
    ties: tuple[str, ...] = ()

    def timed(self) -> DataFrame:
        kind = dict(self.df.dtypes)[self.time]
        t = F.col(self.time) if kind == "bigint" else millis(F.col(self.time))
        seq = F.struct(*self.ties) if len(self.ties) > 1 else F.col(self.ties[0]) if self.ties else F.monotonically_increasing_id()
        return self.df.withColumn(T, t).withColumn(SEQ, seq)


def prepare(stream: Stream, source: EventSource | None) -> DataFrame:
    """Arrival time, order and (for a source that asks for it) deduplication."""
    df = stream.timed()
    if source is not None and source.dedupe_key:
        df = dedupe(df, source.dedupe_key, duration_ms(source.dedupe_window or DEDUPE_WINDOW))
    return df


def dedupe(df: DataFrame, key: str, window: int | None) -> DataFrame:
    """Drop an event whose key was accepted less than `window` ago. A dropped event does not extend the window.

    Rows are dealt by key and sorted by arrival; each task goes through its rows once and remembers one time, so
    a key of any size takes constant memory. Rows without a key all stay.
    """
    ordered = df.filter(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, T, SEQ)
    at = ordered.columns.index(key)

    def run(batches):
        last, until = None, 0
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(T)).to_pylist(), strict=True):
                fresh = k != last or (window is not None and t >= until)
                if fresh:
                    last, until = k, t + (window or 0)
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema).unionByName(df.filter(F.col(key).isNull()))


def last_session(df: DataFrame, keys: Sequence[str], cold_after: int, parts: bool = False) -> DataFrame:
    """Only the events after an entity's last silence of more than `cold_after`."""
    df = ordered.add(df, keys, {"_tr_late": Ordered("last_before", F.col(T))}, parts)
    df = ordered.add(df, keys, {"_tr_from": Ordered("max_all", F.when(F.col(T) - F.col("_tr_late") > cold_after, F.col(T)))}, parts)
    return df.filter(F.col("_tr_from").isNull() | (F.col(T) >= F.col("_tr_from"))).drop("_tr_late", "_tr_from")


def feature_table(stream: Stream, keys: Sequence[str], features: dict[str, Feature], *, steps: Sequence = (), source: EventSource | None = None, query_time: int | Column | None = None, schema: dict[str, str] | None = None, only: Column | None = None, parts: int | None = None) -> DataFrame:
    """One row per entity, its keys and features, as of `query_time` (default: the last event's time).

    `parts` spreads the events of each entity over so many parts of time for the features that need order: for
    tables in which a single entity (or a table without keys) holds more events than one task should sort. `only` narrows the entities (a condition on the keys) before anything is shuffled. Events whose key is null
    or NaN belong to no entity. A table without keys has one row once there is an event.
    """
    df = prepare(stream, source)
    now = F.lit(query_time).cast("long") if isinstance(query_time, int) else query_time
    if now is None:
        now = df.agg(F.max(T)).scalar()
    known = schema or {k: v for k, v in schema_of(stream.df.schema).items()}
    df, known = chain.apply(df, steps, known)
    own = list(keys)
    if not own:
        df, own = df.withColumn(ALL, F.lit(1)), [ALL]
    for k in keys:
        ok = F.col(f"`{k}`").isNotNull()
        df = df.filter(ok & ~F.isnan(f"`{k}`") if known[k] == "f64" else ok)
    if only is not None:
        df = df.filter(only)
    if source is not None and source.cold_after and (cold := duration_ms(source.cold_after)):
        df = last_session(ordered.add_parts(df, parts) if parts else df, own, cold, bool(parts))
    p = Plan(own, known, {c.name: c.dataType for c in df.schema.fields})
    results = {name: OPS[f.op](p, f) for name, f in features.items()}
    made = [c.value if isinstance(c, Ordered) else c for level in p.levels for c in level.values()]
    df = df.withColumn(NOW, now) if any(NOW in str(c) for c in [*p.aggs.values(), *made]) else df
    if parts and ordered.PART not in df.columns and any(isinstance(c, Ordered) for level in p.levels for c in level.values()):
        df = ordered.add_parts(df, parts)
    for level in p.levels:
        if plain := {n: c for n, c in level.items() if not isinstance(c, Ordered)}:
            df = df.withColumns(plain)
        if windows := {n: c for n, c in level.items() if isinstance(c, Ordered)}:
            df = ordered.add(df, own, windows, bool(parts))
    base = df.groupBy(*own).agg(*[c.alias(n) for n, c in p.aggs.items()]) if p.aggs else df.select(*own).distinct()
    if p.counts.kinds:
        base = base.join(p.counts.table(df, arrival_of(df)), own, "left")
    for _, make in p.sides:
        base = base.join(make(df), own, "left")
    return base.select(*[F.col(f"`{k}`") for k in keys], *[c.alias(n) for n, c in results.items()])


def arrival_of(df: DataFrame) -> Column:
    """An event's place in order of arrival as one value; a number, which aggregates keep by hash, where the tie breaker is one."""
    if dict(df.dtypes)[SEQ] != "bigint":
        return F.struct(T, SEQ)
    wide = F.col(T).cast("decimal(20,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
    return (wide + F.coalesce(F.col(SEQ), F.lit(-(1 << 63)).cast("long")).cast("decimal(20,0)")).cast("decimal(38,0)")


def table_rows(table: Table, stream: Stream, **how) -> DataFrame:
    return feature_table(stream, table.keys, table.features, steps=table.steps, source=table.root, **how)
