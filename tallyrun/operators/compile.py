"""Features compiled to Spark plans.

All features of a table share one plan: masked input columns, then window columns over one
(keys, arrival) order, then one aggregation. Features that first count per value or per time bucket share a second
reading: an event gives a row for each kind of value that is counted, rows are counted per (keys, kind, value), and one
aggregation of the counts, joined on the keys, gives all of them. A feature's `where` is a mask, never a filter, so that
every entity with an event has a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.expr import condition
from ..functions.types import field_type
from ..model import Feature, duration_ms
from . import hyperloglog

T, SEQ, NOW = "_tr_t", "_tr_seq", "_tr_now"
BUCKETS = 64
MAX_CATEGORIES = 1024
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32
#: fixed values of the sampling generator: golden ratio, salt and the seed that stands in for zero
GOLDEN, SALT, ZERO_SEED = 0x9E3779B97F4A7C15, 0xA0B1C2D3E4F50617, 0xD2B74E4572D7C2B0
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@dataclass(frozen=True)
class Ordered:
    """A result over an entity's events: up to this one, before it, or all of them; `group` narrows the entity.

    The planner computes it with a window, or, where entities are split into parts of time, from windows within
    parts and what earlier parts carry over.
    """

    kind: str  # last_before, sum_upto, count_upto, max_upto, moments_before, max_earlier, and sum_, count_, min_, max_, moments_ with _all
    value: Column
    group: tuple[str, ...] = ()


class Counts:
    """Counts per (keys, kind, value), and the aggregates over them that give features.

    A kind is a column of values that are counted where it is not null; equal columns share one. Values of a
    type lie in a column of their own. What a feature needs beside counts is made only if asked for: `rank_first` is a
    value's place in order of its first event, `rank_count` by count, `below` how many smaller or equal ones there are, and
    `total` how many in all. A kind may have a weight, an int of its events, of which each value keeps the greatest.
    """

    KIND, N, FIRST, MOST = "_tr_kind", "_tr_n", "_tr_f", "_tr_m"

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.kinds: dict[str, Column] = {}
        self.weights: dict[str, Column] = {}
        self.wanted: dict[str, Callable[[], Column]] = {}
        self.needs: set[str] = set()
        self.slots: dict[str, str] = {}

    def kind(self, x: Column, weight: Column | None = None) -> str:
        found = next((k for k, c in self.kinds.items() if str(c) == str(x)), f"k{len(self.kinds)}")
        self.kinds.setdefault(found, x)
        if weight is not None:
            self.weights[found] = weight
        return found

    def on(self, kind: str) -> Column:
        return F.col(self.KIND) == int(kind[1:])

    def value(self, kind: str) -> Column:
        return F.col(self.slots[kind])

    def need(self, what: str) -> Column:
        self.needs.add(what)
        return F.col(f"_tr_{what}")

    def put(self, make: Callable[[], Column]) -> Column:
        """An aggregate over the counts; it is made once all kinds are known."""
        name = f"_tr_s{len(self.wanted)}"
        self.wanted[name] = make
        return F.col(name)

    def table(self, df: DataFrame, arrival: Column) -> DataFrame:
        kinds = list(self.kinds.items())
        types = [f.dataType for f in df.select(*[x.alias(k) for k, x in kinds]).schema.fields]
        names = {t.simpleString(): f"_tr_v{i}" for i, t in enumerate(types)}
        self.slots = {k: names[t.simpleString()] for (k, _), t in zip(kinds, types, strict=True)}
        values = list(dict.fromkeys(names.values()))
        of = {names[t.simpleString()]: t for t in types}

        def row(k: str, x: Column) -> Column:
            own = [(x if v == self.slots[k] else F.lit(None).cast(of[v])).alias(v) for v in values]
            return F.struct(F.lit(int(k[1:])).alias(self.KIND), *own, *weight(k))

        def weight(k: str) -> list[Column]:
            return [self.weights.get(k, F.lit(None)).cast("int").alias("_tr_weight")] if self.weights else []

        aggs = {name: make() for name, make in self.wanted.items()}
        first = [arrival.alias("_tr_arrival")] if "rank_first" in self.needs else []
        if len(kinds) == 1:
            (k, x), own = kinds[0], [F.col(f"`{c}`") for c in self.keys]
            rows = df.filter(x.isNotNull()).select(*own, F.lit(0).alias(self.KIND), x.alias(self.slots[k]), *first, *weight(k))
        else:
            each = F.filter(F.array(*[F.when(x.isNotNull(), row(k, x)) for k, x in kinds]), lambda e: e.isNotNull())
            rows = df.select(*[F.col(f"`{c}`") for c in self.keys], *first, F.explode(each).alias("_tr_e"))
            rows = rows.select(*[F.col(f"`{c}`") for c in self.keys], "_tr_e.*", *(["_tr_arrival"] if first else []))
        most = [F.max("_tr_weight").alias(self.MOST)] if self.weights else []
        counts = rows.groupBy(*self.keys, self.KIND, *values).agg(F.count("*").alias(self.N), *([F.min("_tr_arrival").alias(self.FIRST)] if first else []), *most)
        whole = Window.partitionBy(*self.keys, self.KIND)
        made = {
            "rank_first": lambda: F.row_number().over(whole.orderBy(self.FIRST)),
            "rank_count": lambda: F.row_number().over(whole.orderBy(F.desc(self.N), *values)),
            "below": lambda: F.sum(self.N).over(whole.orderBy(*values)),
            "total": lambda: F.sum(self.N).over(whole),
        }
        for need in sorted(self.needs):
            counts = counts.withColumn(f"_tr_{need}", made[need]())
        return counts.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])


class Plan:
    """Columns by level, aggregates, results and side plans of one table."""

    def __init__(self, keys: list[str], schema: dict[str, str], types: dict[str, DataType]):
        self.keys, self.schema, self.types = keys, schema, types
        self.levels: list[dict[str, Column | Ordered]] = [{} for _ in range(9)]
        self.names: dict[tuple, str] = {}
        self.aggs: dict[str, Column] = {}
        self.counts = Counts(keys)
        self.sides: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        self.results: dict[str, Column] = {}
        self.arrival = F.struct(T, SEQ)

    def column(self, level: int, key: tuple, make: Callable[[], Column | Ordered]) -> Column:
        """A column of a level, made from columns of lower ones; equal keys share one."""
        if key not in self.names:
            self.names[key] = f"_tr_c{len(self.names)}"
            self.levels[level][self.names[key]] = make()
        return F.col(self.names[key])

    def named(self, c: Column) -> str:
        """The name of a column that column() gave."""
        return next(n for n in self.names.values() if str(F.col(n)) == str(c))

    def total(self, key: tuple, make: Callable[[], Column]) -> Column:
        """An aggregate; equal keys share one."""
        key = ("agg", *key)
        if key not in self.names:
            self.names[key] = f"_tr_a{len(self.names)}"
            self.aggs[self.names[key]] = make()
        return F.col(self.names[key])

    def side(self, make: Callable[[DataFrame, str], DataFrame]) -> Column:
        name = f"_tr_p{len(self.sides)}"
        self.sides.append((name, lambda df: make(df, name)))
        return F.col(name)

    def now(self) -> Column:
        return self.total(("now",), lambda: F.max(NOW))

    # masks

    def where(self, f: Feature) -> Column:
        if f.where is None:
            return F.lit(True)
        return self.column(0, ("where", str(f.where)), lambda: condition(f.where, self.schema))

    def active(self, f: Feature) -> Column:
        """Whether the event's bucket is still in the window at query time."""
        span = duration_ms(f.window)
        if span is None:
            return F.lit(True)
        size = -(-span // BUCKETS)
        age = F.col(NOW) - F.floor(F.col(T) / size).cast("long") * size
        return self.column(0, ("active", span), lambda: (age >= 0) & (age < span))

    def shown(self, f: Feature) -> Column:
        """where and window together."""
        if duration_ms(f.window) is None:
            return self.where(f)
        return self.where(f) & self.active(f)

    def kind(self, name: str) -> str:
        return self.schema[name]

    def raw(self, f: Feature, windowed: bool = False) -> Column:
        """The field where the event counts, else null."""
        mask = self.shown(f) if windowed else self.where(f)
        c = F.col(f"`{f.field}`")
        kind = self.kind(f.field)
        c = c.cast("double") if kind == "f64" else c.cast("long") if kind == "i64" else c
        key = ("raw", f.field, str(f.where), f.window if windowed else None)
        return self.column(1, key, lambda: F.when(mask, c))

    def number(self, f: Feature, windowed: bool = False, name: str | None = None) -> Column:
        """The same as a double; fields that are no numbers never count."""
        name = name or f.field
        mask = self.shown(f) if windowed else self.where(f)
        key = ("number", name, str(f.where), f.window if windowed else None)
        numeric = self.kind(name) in ("i64", "f64")
        return self.column(1, key, lambda: F.when(mask, F.col(f"`{name}`").cast("double")) if numeric else F.lit(None).cast("double"))

    def text(self, f: Feature, windowed: bool = False, kinds: tuple = ("str", "i64", "bool")) -> Column:
        """The field as a category; other kinds never count."""
        key = ("text", f.field, str(f.where), f.window if windowed else None, kinds)
        mask = self.shown(f) if windowed else self.where(f)
        known = self.kind(f.field) in kinds
        return self.column(1, key, lambda: F.when(mask, F.col(f"`{f.field}`").cast("string")) if known else F.lit(None).cast("string"))

    # order

    def previous(self, x: Column, what: str = "t") -> Column:
        """Time or value of the last event before this one where x is not null (null if x is null here)."""
        value = F.col(T) if what == "t" else x
        return F.when(x.isNotNull(), self.column(2, ("previous", str(x), what), lambda: Ordered("last_before", F.when(x.isNotNull(), value))))

    def rank(self, x: Column) -> Column:
        """1 for the first event where x is not null, and so on."""
        return F.when(x.isNotNull(), self.column(2, ("rank", str(x)), lambda: Ordered("count_upto", x)))

    def rank_back(self, x: Column) -> Column:
        """1 for the latest event where x is not null, and so on."""
        all_of = self.column(2, ("size", str(x)), lambda: Ordered("count_all", x))
        return all_of - self.rank(x) + 1

    def latest(self, x: Column, given: Column | None = None) -> Column:
        given = x if given is None else given
        return self.total(("latest", str(x), str(given)), lambda: F.max_by(x, F.when(given.isNotNull(), self.arrival)))

    def listed(self, x: Column, place: Column, n: int) -> Column:
        """Values in order of place where place <= n."""
        got = self.total(("listed", str(x), str(place), n), lambda: F.collect_list(F.when(x.isNotNull() & (place <= n), F.struct(place.alias("p"), x.alias("v")))))
        return F.transform(F.array_sort(got), lambda s: s["v"])


OPS: dict[str, Callable[[Plan, Feature], Column]] = {}


def op(*names: str):
    def put(f):
        for n in names:
            OPS[n] = f
        return f

    return put


# core ---------------------------------------------------------------------------------------------


@op("count")
def _count(p, f):
    return p.total(("count", str(f.where), f.window), lambda: F.count(F.when(p.shown(f), 1)))


@op("sum")
def _sum(p, f):
    x = p.number(f, True)
    return p.total(("sum", str(x)), lambda: F.sum(x))


@op("mean")
def _mean(p, f):
    x = p.number(f, True)
    return p.total(("mean", str(x)), lambda: F.avg(x))


def _extreme(p, f, best):
    x = p.raw(f, True)
    kind = p.kind(f.field)
    if kind in ("bool", "bytes", "json"):
        return p.total(("first", str(x)), lambda: F.min_by(x, F.when(x.isNotNull(), p.arrival)))
    if kind == "f64":  # NaN is neither less nor more
        return p.total((best.__name__, str(x)), lambda: F.coalesce(best(F.when(~F.isnan(x), x)), best(x)))
    return p.total((best.__name__, str(x)), lambda: best(x))


@op("min")
def _min(p, f):
    return _extreme(p, f, F.min)


@op("max")
def _max(p, f):
    return _extreme(p, f, F.max)


@op("var")
def _var(p, f):
    x = p.number(f, True)
    return p.total(("var", str(x)), lambda: F.var_samp(x))


@op("std")
def _std(p, f):
    x = p.number(f, True)
    return p.total(("std", str(x)), lambda: F.stddev_samp(x))


@op("ratio")
def _ratio(p, f):
    rows = p.total(("rows", f.window), lambda: F.count(F.when(p.active(f), 1)))
    return F.when(rows > 0, _count(p, f) / rows)


# distinct values, quantiles, frequencies -------------------------------------------------------------


@op("n_unique")
def _n_unique(p, f):
    x, c = p.raw(f, True), p.counts
    if f.params.get("approx"):  # registers in use as rows, so no task holds all registers of many entities
        h = p.column(2, ("hash", str(x)), lambda: hyperloglog.hashed(x, p.types.get(f.field)))
        register = p.column(3, ("register", str(x)), lambda: F.when(x.isNotNull(), hyperloglog.register(h)))
        kind = c.kind(register, p.column(3, ("height", str(x)), lambda: hyperloglog.height(h)))
        used = c.put(lambda: F.count(F.when(c.on(kind), 1)))
        total = c.put(lambda: F.sum(F.when(c.on(kind), hyperloglog.share(F.col(Counts.MOST)))))
        return hyperloglog.estimate(F.coalesce(used, F.lit(0).cast("long")), F.coalesce(total, F.lit(0.0)))

    kind = c.kind(x)
    return F.coalesce(c.put(lambda: F.count(F.when(c.on(kind), 1))), F.lit(0).cast("long"))


@op("quantile")
def _quantile(p, f):
    x = p.number(f, True)
    finite = F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)
    if f.params.get("approx"):
        return p.total(("approx_quantile", str(x), f.params["q"]), lambda: F.percentile_approx(finite, f.params["q"], 10_000))
    # the value that the place q (n - 1) falls on, or between: counts and running sums of values, which spill to disk
    c, q = p.counts, f.params["q"]
    kind = c.kind(finite)
    below, total = c.need("below"), c.need("total")
    place = q * (total - 1)
    n = c.put(lambda: F.max(F.when(c.on(kind), total)))
    low = c.put(lambda: F.min(F.when(c.on(kind) & (below > F.floor(place)), c.value(kind))))
    high = c.put(lambda: F.min(F.when(c.on(kind) & (below > F.ceil(place)), c.value(kind))))
    at = q * (n - 1)
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


@op("top_k")
def _top_k(p, f):
    kind = p.kind(f.field)
    if kind in ("bytes", "json"):
        return F.array().cast("array<struct<value:string,count:bigint>>")
    x = p.raw(f, True)

    if f.params.get("approx"):  # a sketch of bounded size, combined on the map side
        found = p.total(("approx_top", str(x), f.params.get("k", 10)), lambda: F.call_function("approx_top_k", x, F.lit(f.params.get("k", 10)), F.lit(max(10_000, 4 * f.params.get("k", 10)))))
        known = F.filter(found, lambda s: s["item"].isNotNull())
        return F.coalesce(F.transform(known, lambda s: F.struct(s["item"].alias("value"), s["count"].alias("count"))), F.array().cast(f"array<struct<value:{_sql_type(kind)},count:bigint>>"))
    counts, k = p.counts, p.counts.kind(x)
    rank, n = counts.need("rank_count"), F.col(Counts.N)
    best = counts.put(lambda: F.array_sort(F.collect_list(F.when(counts.on(k) & (rank <= f.params.get("k", 10)), F.struct(rank.alias("r"), counts.value(k).alias("v"), n.alias("n"))))))
    c = F.transform(best, lambda s: F.struct(s["v"].alias("value"), s["n"].alias("count")))
    return F.coalesce(c, F.filter(c, lambda s: F.lit(False)), F.array().cast(f"array<struct<value:{_sql_type(kind)},count:bigint>>"))


def _sql_type(kind: str) -> str:
    return {"str": "string", "i64": "bigint", "f64": "double", "bool": "boolean", "datetime": "timestamp"}[kind]


@op("bloom_member")
def _bloom_member(p, f):
    if p.kind(f.field) in ("bytes", "json"):
        return F.lit(False)
    x = p.raw(f)
    return p.total(("any", str(x)), lambda: F.count(x)) > 0


@op("entropy")
def _entropy(p, f):
    if p.kind(f.field) in ("bytes", "json"):
        return F.lit(0.0)
    c, kind = p.counts, p.counts.kind(p.raw(f, True))
    kept = c.need("rank_first") <= MAX_CATEGORIES
    n = F.col(Counts.N)
    total = c.put(lambda: F.sum(F.when(c.on(kind) & kept, n)))
    logs = c.put(lambda: F.sum(F.when(c.on(kind) & kept, n * F.log2(n.cast("double")))))
    # -sum c/n log2 c/n = log2 n - sum c log2 c / n
    return F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total.cast("double")) - logs / total)).otherwise(F.lit(0.0))


@op("event_type_mix")
def _event_type_mix(p, f):
    c, kind = p.counts, p.counts.kind(p.text(f))
    allowed = f.params.get("categories")
    n = F.col(Counts.N)
    if allowed is None:
        rank = c.need("rank_first")
        kept = lambda: rank <= f.params.get("max_categories", 256)
    else:
        kept = lambda: c.value(kind).isin(*allowed) if allowed else F.lit(False)
    total = c.put(lambda: F.sum(F.when(c.on(kind), n)))
    held = c.put(lambda: F.array_sort(F.collect_list(F.when(c.on(kind) & kept(), F.struct(c.value(kind).alias("v"), n.alias("n"))))))
    shares = F.map_from_entries(F.transform(held, lambda s: F.struct(s["v"], s["n"] / total)))
    return F.coalesce(shares, F.create_map().cast("map<string,double>"))


# points and lists -------------------------------------------------------------------------------------


@op("first")
def _first(p, f):
    x = p.raw(f)
    return p.total(("first", str(x)), lambda: F.min_by(x, F.when(x.isNotNull(), p.arrival)))


@op("last")
def _last(p, f):
    return p.latest(p.raw(f))


@op("first_n")
def _first_n(p, f):
    x = p.raw(f)
    return p.listed(x, p.rank(x), f.params["n"])


@op("last_n", "most_recent_n")
def _last_n(p, f):
    x = p.raw(f)
    back = p.column(3, ("back", str(x)), lambda: p.rank_back(x))
    return F.reverse(p.listed(x, back, f.params["n"]))


@op("lag")
def _lag(p, f):
    x = p.raw(f)
    back = p.column(3, ("back", str(x)), lambda: p.rank_back(x))
    return p.total(("lag", str(x), f.params["n"]), lambda: F.max_by(x, F.when(x.isNotNull() & (back == f.params["n"] + 1), p.arrival)))


# recency and streaks ------------------------------------------------------------------------------------


def _at(p, f) -> Column:
    """Time of the event where it counts."""
    return p.column(1, ("at", str(f.where)), lambda: F.when(p.where(f), F.col(T)))


@op("first_seen")
def _first_seen(p, f):
    t = _at(p, f)
    return p.total(("min", str(t)), lambda: F.min(t))


@op("last_seen")
def _last_seen(p, f):
    t = _at(p, f)
    return p.total(("max", str(t)), lambda: F.max(t))


def _since(p, t: Column) -> Column:
    return F.when(t.isNotNull(), F.greatest(p.now() - t, F.lit(0).cast("long")))


@op("age")
def _age(p, f):
    return _since(p, _first_seen(p, f))


@op("time_since")
def _time_since(p, f):
    return _since(p, _last_seen(p, f))


@op("has_seen")
def _has_seen(p, f):
    return _last_seen(p, f).isNotNull()


@op("time_since_last_n")
def _time_since_last_n(p, f):
    t = _at(p, f)
    back = p.column(3, ("back", str(t)), lambda: p.rank_back(t))
    return _since(p, p.total(("nth_back", str(t), f.params["n"]), lambda: F.max(F.when(back == f.params["n"], t))))


@op("first_seen_in_window")
def _first_seen_in_window(p, f):
    gap = p.now() - _last_seen(p, f)
    span = duration_ms(f.window)
    return F.coalesce((gap >= 0) & (gap < span), F.lit(False)) if span is not None else _has_seen(p, f)


def _run(p, f, of: bool) -> Column:
    """Length of the run of (non-)matches that ends at this event."""
    hit = p.where(f) if of else ~p.where(f)
    place = p.column(2, ("place",), lambda: Ordered("count_upto", F.lit(1)))
    broken = p.column(3, ("broken", str(f.where), of), lambda: Ordered("max_upto", F.when(~hit, place)))
    return p.column(4, ("run", str(f.where), of), lambda: F.when(hit, place - F.coalesce(broken, F.lit(0))).otherwise(F.lit(0)))


@op("streak")
def _streak(p, f):
    return p.latest(_run(p, f, True), F.lit(1))


@op("max_streak")
def _max_streak(p, f):
    run = _run(p, f, True)
    return p.total(("max", str(run)), lambda: F.max(run))


@op("negative_streak")
def _negative_streak(p, f):
    return p.latest(_run(p, f, False), F.lit(1))


# decay ------------------------------------------------------------------------------------------------


def _rate(f: Feature) -> float:
    return math.log(2) / duration_ms(f.half_life)


@op("ewma", "ema")
def _ewma(p, f):
    """Unrolled: each value keeps its weight times the product of what later events leave of it."""
    x, rate = p.number(f), _rate(f)
    gap = F.col(T) - p.previous(x)
    key = (str(x), rate)
    left = p.column(3, ("ewma_left", *key), lambda: F.when(x.isNotNull(), F.when(gap.isNull(), 0.0).when(gap > 0, -rate * gap).otherwise(math.log(0.5))))
    weight = p.column(3, ("ewma_weight", *key), lambda: F.when(gap.isNull(), 1.0).when(gap > 0, -F.expm1(-rate * gap)).otherwise(0.5))
    sofar = p.column(4, ("ewma_sofar", *key), lambda: Ordered("sum_upto", left))
    all_of = p.column(4, ("ewma_all", *key), lambda: Ordered("sum_all", left))
    return p.total(("ewma", *key), lambda: F.sum(weight * x * F.exp(all_of - sofar)))


def _last_time(p, x: Column) -> Column:
    return p.column(2, ("last_time", str(x)), lambda: Ordered("max_all", F.when(x.isNotNull(), F.col(T))))


def _ew_moments(p, f) -> tuple[Column, Column]:
    """Exponentially weighted mean and second moment.

    The running mean at an event needs sums of e^(rate t), which overflow on long spans; so time is cut
    into stretches of 400 time constants, sums are anchored at a stretch's start, and of what came before only
    the stretch before can weigh more than e^-400.
    """
    x, rate = p.number(f), _rate(f)
    key = (str(x), rate)
    span = 400.0 / rate
    gap = F.col(T) - p.previous(x)
    weight = p.column(3, ("ew_weight", *key), lambda: F.when(x.isNotNull(), F.when(gap.isNull(), 1.0).when(gap > 0, -F.expm1(-rate * gap)).otherwise(0.0)))
    first = p.column(2, ("first_time", str(x)), lambda: Ordered("min_all", F.when(x.isNotNull(), F.col(T))))
    part = p.column(3, ("ew_part", *key), lambda: F.when(x.isNotNull(), F.floor((F.col(T) - first) / span).cast("long")))
    inside = p.column(3, ("ew_inside", *key), lambda: rate * (F.col(T) - first) - 400.0 * F.floor((F.col(T) - first) / span))
    stretch = (p.named(part),)
    grown = p.column(4, ("ew_grown", *key), lambda: Ordered("sum_upto", weight * x * F.exp(inside), stretch))
    own = p.column(5, ("ew_own", *key), lambda: F.when(x.isNotNull(), grown * F.exp(-inside)))
    ended = p.column(6, ("ew_ended", *key), lambda: Ordered("max_earlier", F.when(x.isNotNull(), F.struct(F.col(T).alias("t"), F.col(SEQ).alias("s"), own.alias("v"))), stretch))
    mean = p.column(7, ("ew_mean", *key), lambda: F.when(x.isNotNull(), own + F.coalesce(ended["v"] * F.exp(-rate * (F.col(T) - ended["t"])), F.lit(0.0))))
    before = p.column(8, ("ew_before", *key), lambda: Ordered("last_before", mean))
    late = _last_time(p, x)
    gap_of_mean = x - F.coalesce(before, x)
    second = p.total(("ew_second", *key), lambda: F.sum(weight * (1 - weight) * gap_of_mean * gap_of_mean * F.exp(-rate * (late - F.col(T)))))
    return p.latest(mean), F.when(second.isNotNull(), F.greatest(second, F.lit(0.0)))


@op("ewvar")
def _ewvar(p, f):
    return _ew_moments(p, f)[1]


@op("ew_zscore")
def _ew_zscore(p, f):
    mean, second = _ew_moments(p, f)
    return F.when(second > 0, (p.latest(p.number(f)) - mean) / F.sqrt(F.when(second > 0, second)))


def _decayed(p, x: Column, amount: Column, rate: float) -> Column:
    late = _last_time(p, x)
    return p.total(("decayed", str(x), str(amount), rate), lambda: F.sum(F.when(x.isNotNull(), amount * F.exp(-rate * (late - F.col(T))))))


@op("decayed_sum")
def _decayed_sum(p, f):
    x = p.number(f)
    return _decayed(p, x, x, _rate(f))


@op("decayed_count")
def _decayed_count(p, f):
    return F.coalesce(_decayed(p, _at(p, f), F.lit(1.0), _rate(f)), F.lit(0.0))


@op("twa")
def _twa(p, f):
    x = p.number(f)
    gap = F.col(T) - p.previous(x)
    area = p.total(("twa_area", str(x)), lambda: F.sum(p.previous(x, "v") * gap))
    time = p.total(("twa_time", str(x)), lambda: F.sum(gap))
    return F.when(time > 0, area / F.when(time > 0, time)).otherwise(p.latest(x))


# velocity ---------------------------------------------------------------------------------------------


@op("rate_of_change")
def _rate_of_change(p, f):
    x = p.number(f)
    gap = F.col(T) - p.previous(x)
    rate = p.column(3, ("rate", str(x)), lambda: F.when(gap > 0, (x - p.previous(x, "v")) / F.when(gap > 0, gap)))
    return p.latest(rate)


@op("inter_arrival_stats")
def _inter_arrival_stats(p, f):
    t = _at(p, f)
    n = p.total(("any", str(t)), lambda: F.count(t))
    return F.when(n > 1, (_last_seen(p, f) - _first_seen(p, f)) / F.when(n > 1, n - 1))


@op("burst_count")
def _burst_count(p, f):
    t, size = _at(p, f), duration_ms(f.params["sub_window"])

    c, kind = p.counts, p.counts.kind(F.floor(t / size).cast("long"))
    return F.coalesce(c.put(lambda: F.max(F.when(c.on(kind), F.col(Counts.N)))), F.lit(0).cast("long"))


@op("delta_from_prev")
def _delta_from_prev(p, f):
    x = p.number(f)
    return p.latest(p.column(3, ("delta", str(x)), lambda: x - p.previous(x, "v")), x)


def _line(p, f) -> tuple[Column, Column, Column]:
    """Slope and intercept over time, counted from the query time so that squares stay exact, and the number of values."""
    x = p.number(f)
    t = p.column(2, ("centred", str(x)), lambda: (F.col(T) - F.col(NOW)).cast("double"))
    slope = p.total(("slope", str(x)), lambda: F.regr_slope(x, t))
    intercept = p.total(("intercept", str(x)), lambda: F.regr_intercept(x, t))
    n = p.total(("any", str(x)), lambda: F.count(x))
    return F.when(n > 1, slope), intercept, p.latest(t, x)


@op("trend")
def _trend(p, f):
    return _line(p, f)[0]


@op("trend_residual")
def _trend_residual(p, f):
    slope, intercept, t = _line(p, f)
    return p.latest(p.number(f)) - (slope * t + intercept)


@op("outlier_count")
def _outlier_count(p, f):
    x = p.number(f)
    prior = p.column(2, ("prior", str(x)), lambda: Ordered("moments_before", x))
    far = (prior["n"] >= 5) & (prior["var"] > 0) & (F.abs(x - prior["mean"]) > f.params.get("sigma", 3.0) * F.sqrt(F.when(prior["var"] > 0, prior["var"])))
    return p.total(("outliers", str(x), f.params.get("sigma", 3.0)), lambda: F.count(F.when(far, 1)))


@op("value_change_count")
def _value_change_count(p, f):
    x = p.raw(f)
    old = p.previous(x, "v")
    differs = x != old
    if p.kind(f.field) == "f64":
        differs = differs | F.isnan(x) | F.isnan(old)
    return p.total(("changes", str(x)), lambda: F.count(F.when(old.isNotNull() & differs, 1)))


@op("z_score")
def _z_score(p, f):
    x = p.number(f)
    var = p.total(("var", str(x)), lambda: F.var_samp(x))
    mean = p.total(("mean", str(x)), lambda: F.avg(x))
    return F.when(var > 0, (p.latest(x) - mean) / F.sqrt(F.when(var > 0, var)))


# buffers ----------------------------------------------------------------------------------------------


def edge_text(v: float) -> str:
    if v == math.floor(v) and abs(v) != math.inf:
        return str(int(v))
    return repr(v) if abs(v) != math.inf else "inf" if v > 0 else "-inf"


def bucket_labels(edges: list[float]) -> list[str]:
    names = [edge_text(v) for v in edges]
    return [f"<{names[0]}", *(f"{a}-{b}" for a, b in zip(names, names[1:], strict=False)), f">={names[-1]}"]


@op("histogram")
def _histogram(p, f):
    x, edges = p.number(f), list(f.params["buckets"])
    cell = F.when(x.isNotNull(), sum(((F.isnan(x) | (x >= e)).cast("int") for e in edges), F.lit(0)))
    at = p.column(2, ("cell", str(x), tuple(edges)), lambda: cell)
    counts = {label: p.total(("cell", str(x), tuple(edges), i), lambda i=i: F.count(F.when(at == i, 1))) for i, label in enumerate(bucket_labels(edges))}
    return F.create_map(*[c for label in sorted(counts, key=str.encode) for c in (F.lit(label), counts[label])])


def _hour(t: Column) -> Column:
    return F.pmod(F.floor(t / 3_600_000), F.lit(24).cast("long"))


@op("hour_of_day_histogram")
def _hour_of_day_histogram(p, f):
    t = _at(p, f)
    hour = p.column(2, ("hour", str(t)), lambda: _hour(t))
    return F.array(*[p.total(("hour", str(t), h), lambda h=h: F.count(F.when(hour == h, 1))) for h in range(24)])


@op("dow_hour_histogram")
def _dow_hour_histogram(p, f):
    t = _at(p, f)

    day = F.pmod(F.floor(t / 86_400_000) + 3, F.lit(7).cast("long"))
    c, kind = p.counts, p.counts.kind((day * 24 + _hour(t)).cast("long"))
    # 168 entries at most
    got = F.map_from_entries(c.put(lambda: F.collect_list(F.when(c.on(kind), F.struct(c.value(kind).alias("h"), F.col(Counts.N).alias("n"))))))
    names = F.array(*[F.lit(f"{d}-{h:02d}") for d in DAYS for h in range(24)])
    n = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(167).cast("long")), lambda i: F.coalesce(F.element_at(got, i), F.lit(0).cast("long")))
    entries = F.array_sort(F.arrays_zip(names.alias("k"), n.alias("v")))
    return F.map_from_entries(entries)


@op("seasonal_deviation")
def _seasonal_deviation(p, f):
    x = p.number(f)
    hour = p.column(2, ("season", str(x)), lambda: F.when(x.isNotNull(), _hour(F.col(T))))
    own = p.column(3, ("season_moments", str(x)), lambda: Ordered("moments_all", x, (p.named(hour),)))
    z = p.column(4, ("season_z", str(x)), lambda: F.when(own["var"] > 0, (x - own["mean"]) / F.sqrt(F.when(own["var"] > 0, own["var"]))))
    return p.latest(z, x)


@op("reservoir_sample")
def _reservoir_sample(p, f):
    """Slots as the deterministic generator deals them; a slot holds the last value dealt to it."""
    x, k = p.raw(f), f.params["samples"]
    i = p.rank(x)
    s0 = i.bitwiseXOR(F.lit(signed(SALT)).cast("long")).bitwiseXOR(F.lit(signed(GOLDEN)).cast("long"))
    s1 = F.when(s0 == 0, F.lit(signed(ZERO_SEED)).cast("long")).otherwise(s0)
    a = p.column(3, ("draw_a", str(x)), lambda: s1.bitwiseXOR(F.shiftleft(s1, 13)))
    b = p.column(4, ("draw_b", str(x)), lambda: a.bitwiseXOR(F.shiftrightunsigned(a, 7)))
    c = p.column(5, ("draw_c", str(x)), lambda: b.bitwiseXOR(F.shiftleft(b, 17)))
    half = F.shiftrightunsigned(c, 1) % i  # unsigned remainder by way of the upper 63 bits
    j = (half * 2 + c.bitwiseAND(F.lit(1).cast("long"))) % i
    slot = p.column(6, ("slot", str(x), k), lambda: F.when(i <= k, i - 1).when(j < k, j))

    def make(df, name):
        held = df.filter(slot.isNotNull()).groupBy(*p.keys, slot.alias("_tr_j")).agg(F.max_by(x, i).alias("_tr_v"))
        return held.groupBy(*p.keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_tr_j", "_tr_v"))), lambda s: s["_tr_v"]).alias(name))

    got = p.side(make)
    return F.coalesce(got, F.array().cast(f"array<{_sql_type(p.kind(f.field))}>")) if p.kind(f.field) not in ("bytes", "json") else got


# places ------------------------------------------------------------------------------------------------


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    a = F.when(a.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))  # least and greatest pass over nulls
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _point(p, f) -> Column:
    """(lat, lon) where both are numbers and the event counts."""
    lat, lon = p.number(f, name=f.params["lat"]), p.number(f, name=f.params["lon"])
    return p.column(2, ("point", str(lat), str(lon)), lambda: F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"), F.col(T).alias("t"))))


def _hop(p, f) -> tuple[Column, Column]:
    """Distance and time from the point before."""
    at = _point(p, f)
    old = F.when(at.isNotNull(), p.column(3, ("point_before", str(at)), lambda: Ordered("last_before", at)))
    km = p.column(4, ("hop", str(at)), lambda: distance_km(old["lat"], old["lon"], at["lat"], at["lon"]))
    return km, F.col(T) - old["t"]


@op("geo_velocity")
def _geo_velocity(p, f):
    km, gap = _hop(p, f)
    at = _point(p, f)
    fastest = p.total(("fastest", str(at)), lambda: F.max(F.when(gap > 0, km / (F.when(gap > 0, gap) / 3_600_000.0))))
    n = p.total(("any", str(at)), lambda: F.count(at))
    return F.when(n > 0, F.coalesce(fastest, F.lit(0.0)))


@op("geo_distance")
def _geo_distance(p, f):
    km, _ = _hop(p, f)
    return F.coalesce(p.total(("path", str(km)), lambda: F.sum(km)), F.lit(0.0))


@op("geo_spread")
def _geo_spread(p, f):
    at = _point(p, f)
    n = p.total(("any", str(at)), lambda: F.count(at))
    var_lat = p.total(("var_lat", str(at)), lambda: F.var_pop(at["lat"]))
    var_lon = p.total(("var_lon", str(at)), lambda: F.var_pop(at["lon"]))
    lat = p.total(("mean_lat", str(at)), lambda: F.avg(at["lat"]))
    return F.when(n > 1, F.sqrt(var_lat * KM_PER_DEGREE**2 + var_lon * F.pow(KM_PER_DEGREE * F.cos(F.radians(lat)), F.lit(2.0))))


@op("distance_from_home")
def _distance_from_home(p, f):
    at, n = _point(p, f), f.params.get("samples", 100)
    size = p.column(3, ("point_size", str(at)), lambda: Ordered("count_all", at))
    place = p.column(3, ("point_place", str(at)), lambda: Ordered("count_upto", at))
    near = at.isNotNull() & (size - place < n)
    lat = p.total(("home_lat", str(at), n), lambda: F.avg(F.when(near, at["lat"])))
    lon = p.total(("home_lon", str(at), n), lambda: F.avg(F.when(near, at["lon"])))
    last = p.latest(at)
    return distance_km(last["lat"], last["lon"], lat, lon)


def result_type(f: Feature, schema: dict[str, str]) -> str:
    """Field type of a feature's value."""
    if f.op in ("count", "n_unique", "age", "time_since", "time_since_last_n", "streak", "max_streak", "negative_streak", "burst_count", "outlier_count", "value_change_count"):
        return "i64"
    if f.op in ("min", "max", "first", "last", "lag"):
        return schema[f.field]
    if f.op in ("first_seen", "last_seen"):
        return "datetime"
    if f.op in ("bloom_member", "has_seen", "first_seen_in_window"):
        return "bool"
    if f.op in ("top_k", "first_n", "last_n", "most_recent_n", "reservoir_sample", "histogram", "hour_of_day_histogram", "dow_hour_histogram", "event_type_mix"):
        return "json"
    return "f64"


__all__ = ["OPS", "Plan", "field_type"]
