"""Results over an entity's events in order, by one window or over parts of time.

With a window, an entity's events are sorted in one task. With parts, they are dealt by entity and part, so that
an entity with any share of all events is spread; each part's summary is a row, and a small window over an
entity's parts gives what earlier parts carry over.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.compile import SEQ, Ordered, T

PART = "_tr_part"
#: below this share of n mean^2, merged squared deviations are rounding errors of equal values
NOISE = 1e-13


def add_parts(df: DataFrame, parts: int) -> DataFrame:
    """The part of each event: `parts` equal stretches of the whole time."""
    span = df.agg(F.struct(F.min(T).alias("low"), F.max(T).alias("high"))).scalar()
    low, high = span["low"], span["high"]
    return df.withColumn(PART, F.floor((F.col(T) - low) * parts / (high - low + 1)).cast("int"))


def add(df: DataFrame, keys: Sequence[str], columns: dict[str, Ordered], parts: bool) -> DataFrame:
    if not parts:
        return df.withColumns({name: _window(o, keys) for name, o in columns.items()})
    df = settle(df)  # each result joins the events with their own summary, so the plan must not hold them twice
    groups: dict[tuple, dict[str, Ordered]] = {}
    for name, o in columns.items():
        groups.setdefault((o.group, o.kind == "max_earlier"), {})[name] = o
    for (group, earlier), own in groups.items():
        before, df = df, settle(_earlier(df, keys, group, own) if earlier else _carried(df, keys, group, own))
        drop(before)
    return df


def drop(df: DataFrame) -> None:
    """Remove a table that settle() wrote, once a later one stands on its own."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._settled)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: a short plan, which lost executors do not undo."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="tallyrun-")
    path = f"{folder.rstrip('/')}/tallyrun/ordered-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled = path
    return back


def _window(o: Ordered, keys: Sequence[str]) -> Column:
    what, _, span = o.kind.rpartition("_")
    if span == "earlier":
        return F.max(o.value).over(Window.partitionBy(*keys).orderBy(*o.group).rangeBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys, *o.group)
    over = whole if span == "all" else whole.orderBy(T, SEQ).rowsBetween(Window.unboundedPreceding, 0 if span == "upto" else -1)
    if what == "moments":
        return F.struct(F.count(o.value).over(over).alias("n"), F.avg(o.value).over(over).alias("mean"), F.var_samp(o.value).over(over).alias("var"))
    if what == "last":
        return F.last(o.value, ignorenulls=True).over(over)
    return getattr(F, what)(o.value).over(over)


def _merged(n: Column, mean: Column, m2: Column, n_b: Column, mean_b: Column, m2_b: Column) -> Column:
    """Moments of two sets of values together."""
    n, n_b = F.coalesce(n, F.lit(0)), F.coalesce(n_b, F.lit(0))
    both = F.when(n + n_b > 0, n + n_b)
    zero = F.lit(0.0)
    grand = (n * F.coalesce(mean, zero) + n_b * F.coalesce(mean_b, zero)) / both
    apart = F.when((n > 0) & (n_b > 0), (mean - mean_b) * (mean - mean_b) * n * n_b / both).otherwise(zero)
    m2 = F.coalesce(m2, zero) + F.coalesce(m2_b, zero) + apart
    m2 = F.when(m2 > NOISE * both * grand * grand, m2).otherwise(zero)
    return F.struct((n + n_b).alias("n"), grand.alias("mean"), F.when(n + n_b > 1, m2 / (n + n_b - 1)).alias("var"))


def _carried(df: DataFrame, keys: Sequence[str], group: tuple[str, ...], columns: dict[str, Ordered]) -> DataFrame:
    by = [*keys, *group, PART]
    inner = Window.partitionBy(*by).orderBy(T, SEQ)
    entity = Window.partitionBy(*keys, *group)
    earlier = entity.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    within: dict[str, Column] = {}
    sums: dict[str, Column] = {}
    for name, o in columns.items():
        what, _, span = o.kind.rpartition("_")
        v = o.value
        if what == "moments":
            sums |= {f"{name}_n": F.count(v), f"{name}_m": F.avg(v), f"{name}_q": F.var_pop(v) * F.count(v)}
        else:
            sums[name] = F.max_by(v, F.when(v.isNotNull(), F.struct(T, SEQ))) if what == "last" else getattr(F, what)(v)
        if span != "all":
            over = inner.rowsBetween(Window.unboundedPreceding, 0 if span == "upto" else -1)
            if what == "moments":
                within |= {f"{name}_in": F.struct(F.count(v).over(over).alias("n"), F.avg(v).over(over).alias("m"), (F.var_pop(v).over(over) * F.count(v).over(over)).alias("q"))}
            else:
                within[f"{name}_in"] = F.last(v, ignorenulls=True).over(over) if what == "last" else getattr(F, what)(v).over(over)
    summary = df.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    carried: list[Column] = []
    centres: dict[str, Column] = {}
    for name, o in columns.items():
        what, _, span = o.kind.rpartition("_")
        over = entity if span == "all" else earlier
        c = F.col(name) if what != "moments" else None
        if what == "moments":
            n, m = F.col(f"{name}_n"), F.col(f"{name}_m")
            centres[f"{name}_g"] = F.sum(n * m).over(over) / F.when(F.sum(n).over(over) > 0, F.sum(n).over(over))
            # squared deviations about the mean of the same parts: their own, and those of their means
            total = F.sum(n).over(over)
            spread = F.sum(F.col(f"{name}_q") + n * (m - F.col(f"{name}_c")) * (m - F.col(f"{name}_c"))).over(over)
            off = F.col(f"{name}_g") - F.col(f"{name}_c")
            carried.append(F.struct(total.alias("n"), F.col(f"{name}_g").alias("m"), F.greatest(spread - total * off * off, F.lit(0.0)).alias("q")).alias(f"{name}_by"))
        elif what == "last":
            carried.append(F.last(c, ignorenulls=True).over(over).alias(f"{name}_by"))
        else:
            carried.append((F.sum if what in ("sum", "count") else getattr(F, what))(c).over(over).alias(f"{name}_by"))
    if centres:  # deviations are taken about the entity's overall mean, which keeps them small
        overall = {n[:-1] + "c": F.sum(F.col(f"{n[:-2]}_n") * F.col(f"{n[:-2]}_m")).over(entity) / F.when(F.sum(f"{n[:-2]}_n").over(entity) > 0, F.sum(f"{n[:-2]}_n").over(entity)) for n in centres}
        summary = summary.withColumns(overall).withColumns(centres)
    summary = summary.select(*by, *carried)
    out = df.withColumns(within).join(summary, by, "left")
    done: dict[str, Column] = {}
    for name, o in columns.items():
        what, _, span = o.kind.rpartition("_")
        carry, own = F.col(f"{name}_by"), F.col(f"{name}_in")
        if what == "moments":
            zero = F.lit(None).cast("double")
            a = (own["n"], own["m"], own["q"]) if span != "all" else (F.lit(0), zero, zero)
            done[name] = _merged(*a, carry["n"], carry["m"], carry["q"])
        elif span == "all":
            done[name] = F.coalesce(carry, F.lit(0)) if what == "count" else carry
        elif what in ("last", "max", "min"):
            done[name] = F.coalesce(own, carry) if what == "last" else F.greatest(own, carry) if what == "max" else F.least(own, carry)
        else:
            done[name] = F.coalesce(own + F.coalesce(carry, F.lit(0)), carry)
    return out.withColumns(done).drop(*within, *[f"{n}_by" for n in columns])


def _earlier(df: DataFrame, keys: Sequence[str], group: tuple[str, ...], columns: dict[str, Ordered]) -> DataFrame:
    by = [*keys, *group]
    over = Window.partitionBy(*keys).orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*by).agg(*[F.max(o.value).alias(n) for n, o in columns.items()])
    return df.join(summary.select(*by, *[F.max(n).over(over).alias(n) for n in columns]), by, "left")
