"""Registered queries of the feature engine and the DuckDB SQL that checks them.

One query per aggregate over `events` keyed by user, windowed variants, row operators, expressions, global and
composite-key tables, lifecycle rules, reads and the benchmark packs. Lists and maps come out as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import col, isnull, lit, parse, quadkey
from ..functions.types import schema_of
from ..model import EventSource, Feature
from ..operators import chain
from ..operators import features as f
from .planner import Stream, feature_table

DIGITS, SHIFT = 6, 1e-9
WEEK = 7 * 86_400_000
HOUR = 3_600_000
#: latitude and longitude made from the events, the same way in both engines
LAT_SQL = "(CAST(props->>'$.k' AS DOUBLE) - 50) * 1.5"
LON_SQL = "value - 180 * floor(value / 180)"
#: events with time, order, category, place and the query time
EVENTS_SQL = f"""e AS (SELECT *, epoch_us(ts) // 1000 AS t, {LAT_SQL} AS lat, {LON_SQL} AS lon, props->>'$.k' AS k,
 event_type = 'click' AS hit, (SELECT max(epoch_us(ts) // 1000) FROM events) AS now FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> Stream:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return Stream(df.withColumn("k", k).withColumn("lat", (k.cast("double") - 50) * 1.5).withColumn("lon", F.col("value") - 180 * F.floor(F.col("value") / 180)), "ts", ("event_id",))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded as both engines must: a small shift takes ties and -0.0 out of the way."""
    return df.select(*[F.round(F.col(c) + SHIFT, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CLICK = col("event_type") == "click"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def per_user(name: str, feature: Feature, sql: str, shape: Callable | None = None, keys: tuple[str, ...] = ("user_id",)) -> None:
    """A query of one feature per user. `sql` is an aggregate over e, or a whole query if it says FROM."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = feature_table(events(spark, sf_dir), keys, {"feature": feature})
        if shape is not None:
            out = out.withColumn("feature", shape(F.col("feature")))
        return rounded(out)

    _QUERIES[name] = query
    if sql:
        by = ", ".join(keys)
        _SQL[name] = f"WITH {EVENTS_SQL} {sql}" if " FROM " in sql else f"WITH {EVENTS_SQL} SELECT {by}, {sql} AS feature FROM e GROUP BY {by}"


def r6(x: str) -> str:
    return f"round(({x}) + {SHIFT}, {DIGITS})"


def active(span: int) -> str:
    size = -(-span // 64)
    return f"now - (t // {size}) * {size} BETWEEN 0 AND {span - 1}"


def masked(where: str) -> str:
    return f" FILTER (WHERE {where})"


#: window over an entity's events in order of arrival
W = "PARTITION BY user_id ORDER BY t, event_id"
W7 = active(WEEK)


def _core() -> None:
    for kind, window, where, cond in (("", None, None, "true"), ("_where", None, CLICK, "hit"), ("_win", "7d", None, W7), ("_win_where", "7d", CLICK, f"hit AND {W7}")):
        a = {"window": window, "where": where}
        m = masked(cond)
        per_user(f"agg_count{kind}", f.count(**a), f"count(*){m}")
        per_user(f"agg_sum{kind}", f.sum("value", **a), r6(f"sum(value){m}"))
        per_user(f"agg_mean{kind}", f.mean("value", **a), r6(f"avg(value){m}"))
        per_user(f"agg_min{kind}", f.min("value", **a), f"min(value){m}")
        per_user(f"agg_max{kind}", f.max("value", **a), f"max(value){m}")
        per_user(f"agg_var{kind}", f.var("value", **a), r6(f"var_samp(value){m}"))
        per_user(f"agg_std{kind}", f.std("value", **a), r6(f"stddev_samp(value){m}"))
        per_user(f"agg_n_unique{kind}", f.n_unique("event_type", **a), f"count(DISTINCT event_type){m}")
        per_user(f"agg_quantile{kind}", f.quantile("value", q=0.9, **a), r6(f"quantile_cont(value, 0.9){m}"))
        best = f"""c AS (SELECT user_id, event_type AS v, count(*) AS n FROM e WHERE {cond} GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS r FROM c)
 SELECT u.user_id, coalesce(string_agg(b.v || ':' || b.n, ',' ORDER BY b.r), '') AS feature
 FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN b ON u.user_id = b.user_id AND b.r <= 3 GROUP BY u.user_id"""
        per_user(f"agg_top_k{kind}", f.top_k("event_type", k=3, **a), "", _top_text)
        _SQL[f"agg_top_k{kind}"] = f"WITH {EVENTS_SQL}, {best}"
        entropy = f"""c AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE {cond} GROUP BY ALL),
 p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
 h AS (SELECT user_id, -sum(p * log2(p)) AS h FROM p GROUP BY user_id)
 SELECT u.user_id, {r6('coalesce(greatest(h.h, 0.0), 0.0)')} AS feature FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN h USING (user_id)"""
        per_user(f"agg_entropy{kind}", f.entropy("event_type", **a), "")
        _SQL[f"agg_entropy{kind}"] = f"WITH {EVENTS_SQL}, {entropy}"
    per_user("agg_ratio", f.ratio(where=CLICK), r6("count(*) FILTER (WHERE hit) / nullif(count(*), 0)"))
    per_user("agg_ratio_win", f.ratio(where=CLICK, window="7d"), r6(f"count(*) FILTER (WHERE hit AND {W7}) / nullif(count(*) FILTER (WHERE {W7}), 0)"))
    per_user("agg_min_str", f.min("event_type"), "min(event_type)")
    per_user("agg_max_str", f.max("event_type"), "max(event_type)")
    per_user("agg_bloom_member", f.bloom_member("event_type", where=CLICK), "count(*) FILTER (WHERE hit) > 0")


def _top_text(c):
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["value"], s["count"].cast("string"))), ",")


def _list_text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def _ranked(cond: str) -> str:
    return f"""m AS (SELECT *, row_number() OVER ({W}) AS r, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS b FROM e WHERE {cond}),
 u AS (SELECT DISTINCT user_id FROM e)"""


def _points() -> None:
    per_user("agg_first", f.first("value", where=CLICK), "arg_min(value, (t, event_id)) FILTER (WHERE hit)")
    per_user("agg_last", f.last("event_type"), "arg_max(event_type, (t, event_id))")
    for name, feature, cond, pick, order in (
        ("agg_first_n", f.first_n("event_type", n=3), "true", "m.r <= 3", "r"),
        ("agg_last_n", f.last_n("event_type", n=3, where=CLICK | (col("event_type") == "view")), "event_type IN ('click', 'view')", "m.b <= 3", "r"),
        ("agg_most_recent_n", f.most_recent_n("event_id", n=4, where=CLICK), "hit", "m.b <= 4", "r"),
    ):
        per_user(name, feature, "", _list_text)
        v = feature.field
        _SQL[name] = f"WITH {EVENTS_SQL}, {_ranked(cond)} SELECT u.user_id, coalesce(string_agg(CAST(m.{v} AS VARCHAR), ',' ORDER BY m.{order}), '') AS feature FROM u LEFT JOIN m ON u.user_id = m.user_id AND {pick} GROUP BY u.user_id"
    per_user("agg_lag", f.lag("value", n=2, where=CLICK), "")
    _SQL["agg_lag"] = f"WITH {EVENTS_SQL}, {_ranked('hit')} SELECT u.user_id, max(m.value) AS feature FROM u LEFT JOIN m ON u.user_id = m.user_id AND m.b = 3 GROUP BY u.user_id"
    m = masked("hit")
    per_user("agg_first_seen", f.first_seen(where=CLICK), f"min(t){m}")
    per_user("agg_last_seen", f.last_seen(where=CLICK), f"max(t){m}")
    per_user("agg_age", f.age(where=CLICK), f"max(now) - min(t){m}")
    per_user("agg_has_seen", f.has_seen(where=CLICK & (col("value") > 150)), "coalesce(bool_or(hit AND value > 150), false)")
    per_user("agg_time_since", f.time_since(where=CLICK), f"max(now) - max(t){m}")
    per_user("agg_time_since_last_n", f.time_since_last_n(n=3, where=CLICK), "")
    _SQL["agg_time_since_last_n"] = f"WITH {EVENTS_SQL}, {_ranked('hit')} SELECT u.user_id, max(m.now - m.t) AS feature FROM u LEFT JOIN m ON u.user_id = m.user_id AND m.b = 3 GROUP BY u.user_id"
    per_user("agg_first_seen_in_window", f.first_seen_in_window(window="1d", where=CLICK), "coalesce(max(now) - max(t) FILTER (WHERE hit) BETWEEN 0 AND 86399999, false)")
    islands = f"s AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER ({W}) AS g, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER ({W}) AS h FROM e)"
    ends = "z AS (SELECT user_id, max(g) AS g, max(h) AS h FROM s GROUP BY user_id)"
    per_user("agg_streak", f.streak(where=CLICK), "")
    _SQL["agg_streak"] = f"WITH {EVENTS_SQL}, {islands}, {ends} SELECT s.user_id, count(*) FILTER (WHERE s.hit AND s.g = z.g) AS feature FROM s JOIN z USING (user_id) GROUP BY s.user_id"
    per_user("agg_max_streak", f.max_streak(where=CLICK), "")
    _SQL["agg_max_streak"] = f"WITH {EVENTS_SQL}, {islands}, l AS (SELECT user_id, g, count(*) FILTER (WHERE hit) AS n FROM s GROUP BY ALL) SELECT user_id, max(n) AS feature FROM l GROUP BY user_id"
    per_user("agg_negative_streak", f.negative_streak(where=CLICK), "")
    _SQL["agg_negative_streak"] = f"WITH {EVENTS_SQL}, {islands}, {ends} SELECT s.user_id, count(*) FILTER (WHERE NOT s.hit AND s.h = z.h) AS feature FROM s JOIN z USING (user_id) GROUP BY s.user_id"


def _decay() -> None:
    rate = f"(ln(2.0) / {HOUR * 24}.0)"
    gaps = f"g AS (SELECT *, lag(t) OVER ({W}) AS pt, lag(value) OVER ({W}) AS pv, max(t) OVER (PARTITION BY user_id) AS tl FROM e)"
    ewma = f"""{gaps}, a AS (SELECT *, CASE WHEN pt IS NULL THEN 1.0 WHEN t > pt THEN 1 - exp(-{rate} * (t - pt)) ELSE 0.5 END AS al,
 CASE WHEN pt IS NULL THEN 0.0 WHEN t > pt THEN -{rate} * (t - pt) ELSE ln(0.5) END AS lw FROM g),
 c AS (SELECT *, sum(lw) OVER ({W}) AS cl, sum(lw) OVER (PARTITION BY user_id) AS ca FROM a)
 SELECT user_id, {r6("sum(al * value * exp(ca - cl))")} AS feature FROM c GROUP BY user_id"""
    for name, make in (("agg_ewma", f.ewma), ("agg_ema", f.ema)):
        per_user(name, make("value", half_life="24h"), "")
        _SQL[name] = f"WITH {EVENTS_SQL}, {ewma}"
    # a recursive fold: the plain recurrence, event by event
    fold = f"""o AS (SELECT *, row_number() OVER ({W}) AS r FROM e),
 x(user_id, r, t, mean, m2, value) AS (SELECT user_id, r, t, value, CAST(0.0 AS DOUBLE), value FROM o WHERE r = 1
 UNION ALL SELECT o.user_id, o.r, greatest(x.t, o.t), x.mean + a.al * (o.value - x.mean), (1 - a.al) * x.m2 + a.al * (o.value - x.mean) * (o.value - (x.mean + a.al * (o.value - x.mean))), o.value
 FROM x JOIN o ON o.user_id = x.user_id AND o.r = x.r + 1, LATERAL (SELECT CASE WHEN o.t > x.t THEN 1 - exp(-{rate} * (o.t - x.t)) ELSE 0.0 END AS al) a),
 l AS (SELECT user_id, arg_max(m2, r) AS m2, arg_max(mean, r) AS mean, arg_max(value, r) AS v FROM x GROUP BY user_id)"""
    recursive = EVENTS_SQL
    per_user("agg_ewvar", f.ewvar("value", half_life="24h"), "")
    _SQL["agg_ewvar"] = f"WITH RECURSIVE {recursive}, {fold} SELECT user_id, {r6('greatest(m2, 0.0)')} AS feature FROM l"
    per_user("agg_ew_zscore", f.ew_zscore("value", half_life="24h"), "")
    _SQL["agg_ew_zscore"] = f"WITH RECURSIVE {recursive}, {fold} SELECT user_id, {r6('CASE WHEN m2 > 0 THEN (v - mean) / sqrt(m2) END')} AS feature FROM l"
    per_user("agg_decayed_sum", f.decayed_sum("value", half_life="24h"), "")
    _SQL["agg_decayed_sum"] = f"WITH {EVENTS_SQL}, {gaps} SELECT user_id, {r6(f'sum(value * exp(-{rate} * (tl - t)))')} AS feature FROM g GROUP BY user_id"
    per_user("agg_decayed_count", f.decayed_count(half_life="24h"), "")
    _SQL["agg_decayed_count"] = f"WITH {EVENTS_SQL}, {gaps} SELECT user_id, {r6(f'sum(exp(-{rate} * (tl - t)))')} AS feature FROM g GROUP BY user_id"
    per_user("agg_twa", f.twa("value", window="7d"), "")
    _SQL["agg_twa"] = f"WITH {EVENTS_SQL}, {gaps} SELECT user_id, {r6('CASE WHEN sum(t - pt) > 0 THEN sum(pv * (t - pt)) / sum(t - pt) ELSE arg_max(value, (t, event_id)) END')} AS feature FROM g GROUP BY user_id"
    # velocity on the same gaps
    per_user("agg_rate_of_change", f.rate_of_change("value"), "", lambda c: c * 1e6)
    _SQL["agg_rate_of_change"] = f"WITH {EVENTS_SQL}, {gaps} SELECT user_id, {r6('arg_max((value - pv) / (t - pt) * 1e6, (t, event_id)) FILTER (WHERE t > pt)')} AS feature FROM g GROUP BY user_id"
    per_user("agg_delta_from_prev", f.delta_from_prev("value"), "")
    _SQL["agg_delta_from_prev"] = f"WITH {EVENTS_SQL}, {gaps} SELECT user_id, {r6('arg_max(value - pv, (t, event_id))')} AS feature FROM g WHERE pt IS NOT NULL OR user_id IS NOT NULL GROUP BY user_id"
    per_user("agg_inter_arrival_stats", f.inter_arrival_stats(window="7d"), r6("CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END"))
    per_user("agg_burst_count", f.burst_count(sub_window="6h", where=CLICK), "")
    _SQL["agg_burst_count"] = f"WITH {EVENTS_SQL}, c AS (SELECT user_id, t // {6 * HOUR} AS b, count(*) FILTER (WHERE hit) AS n FROM e GROUP BY ALL) SELECT user_id, max(n) AS feature FROM c GROUP BY user_id"
    days = "((t - now) / 86400000.0)"
    per_user("agg_trend", f.trend("value"), r6(f"regr_slope(value, {days})"), lambda c: c * 86_400_000)
    per_user("agg_trend_residual", f.trend_residual("value"), r6(f"arg_max(value, (t, event_id)) - (regr_slope(value, {days}) * arg_max({days}, (t, event_id)) + regr_intercept(value, {days}))"))
    prior = f"p AS (SELECT *, avg(value) OVER w AS m, var_samp(value) OVER w AS v, count(*) OVER w AS n FROM e WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    per_user("agg_outlier_count", f.outlier_count("value", sigma=2.0), "")
    _SQL["agg_outlier_count"] = f"WITH {EVENTS_SQL}, {prior} SELECT user_id, count(*) FILTER (WHERE n >= 5 AND v > 0 AND abs(value - m) > 2.0 * sqrt(v)) AS feature FROM p GROUP BY user_id"
    per_user("agg_value_change_count", f.value_change_count("event_type"), "")
    _SQL["agg_value_change_count"] = f"WITH {EVENTS_SQL}, c AS (SELECT *, lag(event_type) OVER ({W}) AS pe FROM e) SELECT user_id, count(*) FILTER (WHERE pe IS NOT NULL AND pe <> event_type) AS feature FROM c GROUP BY user_id"
    per_user("agg_z_score", f.z_score("value", baseline_window="30d"), r6("CASE WHEN var_samp(value) > 0 THEN (arg_max(value, (t, event_id)) - avg(value)) / stddev_samp(value) END"))


def _buffers() -> None:
    edges = [10.0, 25.5, 50.0, 100.0]
    labels = ["<10", "10-25.5", "25.5-50", "50-100", ">=100"]
    conds = ["value < 10", "value >= 10 AND value < 25.5", "value >= 25.5 AND value < 50", "value >= 50 AND value < 100", "value >= 100"]

    def cells(c):
        return F.concat_ws(",", *[F.concat(F.lit(x + "="), F.element_at(c, F.lit(x)).cast("string")) for x in labels])

    per_user("agg_histogram", f.histogram("value", buckets=edges, where=CLICK), " || ',' || ".join(f"'{x}=' || count(*) FILTER (WHERE hit AND {q})" for x, q in zip(labels, conds, strict=True)), cells)
    per_user("agg_hour_of_day_histogram", f.hour_of_day_histogram(), " || ',' || ".join(f"count(*) FILTER (WHERE (t // {HOUR}) % 24 = {h})" for h in range(24)), _list_text)
    per_user("agg_dow_hour_histogram", f.dow_hour_histogram(where=CLICK), "", lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(c, lambda k, v: v > 0))), lambda s: F.concat_ws("=", s["key"], s["value"].cast("string"))), ","))
    day = "CASE (t // 86400000 + 3) % 7 WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wed' WHEN 3 THEN 'Thu' WHEN 4 THEN 'Fri' WHEN 5 THEN 'Sat' ELSE 'Sun' END"
    _SQL["agg_dow_hour_histogram"] = f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, {day} || '-' || lpad(CAST((t // {HOUR}) % 24 AS VARCHAR), 2, '0') AS k2, count(*) AS n FROM e WHERE hit GROUP BY ALL)
 SELECT u.user_id, coalesce(string_agg(k2 || '=' || n, ',' ORDER BY k2), '') AS feature FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN c USING (user_id) GROUP BY u.user_id"""
    per_user("agg_seasonal_deviation", f.seasonal_deviation("value"), "")
    _SQL["agg_seasonal_deviation"] = f"""WITH {EVENTS_SQL}, s AS (SELECT *, var_samp(value) OVER h AS v, avg(value) OVER h AS m, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS b FROM e WINDOW h AS (PARTITION BY user_id, (t // {HOUR}) % 24))
 SELECT user_id, {r6('CASE WHEN v > 0 THEN (value - m) / sqrt(v) END')} AS feature FROM s WHERE b = 1"""
    shares = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda s: F.concat(s["key"], F.lit("="), F.format_string("%.4f", s["value"] + SHIFT))), ",")
    per_user("agg_event_type_mix", f.event_type_mix("event_type"), "", shares)
    per_user("agg_event_type_mix_categories", f.event_type_mix("event_type", categories=["click", "view"]), "", shares)
    for name, cond in (("agg_event_type_mix", "true"), ("agg_event_type_mix_categories", "event_type IN ('click', 'view')")):
        _SQL[name] = f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, event_type AS k2, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
 SELECT u.user_id, coalesce(string_agg(k2 || '=' || printf('%.4f', p + 1e-9), ',' ORDER BY k2), '') AS feature FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN s ON u.user_id = s.user_id AND {cond.replace("event_type", "k2")} GROUP BY u.user_id"""
    per_user("agg_reservoir_sample", f.reservoir_sample("event_id", samples=5), "", _list_text)
    u64 = "18446744073709551615::HUGEINT"
    mul = lambda x, n: f"(({x})::HUGEINT * {1 << n}) & {u64}"
    _SQL["agg_reservoir_sample"] = f"""WITH {EVENTS_SQL}, o AS (SELECT *, row_number() OVER ({W}) AS i FROM e),
 s AS (SELECT *, xor(xor(i::HUGEINT, {0xA0B1C2D3E4F50617}::HUGEINT), {0x9E3779B97F4A7C15}::HUGEINT) AS s0 FROM o),
 a AS (SELECT *, xor(s0, {mul("s0", 13)}) AS s1 FROM s), b AS (SELECT *, xor(s1, s1 // 128) AS s2 FROM a), c AS (SELECT *, xor(s2, {mul("s2", 17)}) AS s3 FROM b),
 d AS (SELECT *, CASE WHEN i <= 5 THEN i - 1 ELSE s3 % i END AS slot FROM c), x AS (SELECT user_id, slot, arg_max(event_id, i) AS v FROM d WHERE slot < 5 GROUP BY ALL)
 SELECT user_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY slot) AS feature FROM x GROUP BY user_id"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"least(1.0, greatest(0.0, pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))"
    return f"(6371.0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _places() -> None:
    at = {"lat": "lat", "lon": "lon"}
    hops = f"g AS (SELECT *, lag(lat) OVER ({W}) AS pa, lag(lon) OVER ({W}) AS po, lag(t) OVER ({W}) AS pt FROM e), h AS (SELECT *, {_hav('pa', 'po', 'lat', 'lon')} AS km FROM g)"
    # lat and lon come from doubles, so six digits of kilometres are kept, three of velocities that divide by small gaps
    per_user("agg_geo_velocity", f.geo_velocity(**at), "", lambda c: F.round(c + SHIFT, 3))
    _SQL["agg_geo_velocity"] = f"WITH {EVENTS_SQL}, {hops} SELECT user_id, round(coalesce(max(km / ((t - pt) / 3600000.0)) FILTER (WHERE t > pt), 0.0) + 1e-9, 3) AS feature FROM h GROUP BY user_id"
    per_user("agg_geo_distance", f.geo_distance(**at), "", lambda c: F.round(c + SHIFT, 3))
    _SQL["agg_geo_distance"] = f"WITH {EVENTS_SQL}, {hops} SELECT user_id, round(coalesce(sum(km), 0.0) + 1e-9, 3) AS feature FROM h GROUP BY user_id"
    per_user("agg_geo_spread", f.geo_spread(**at), r6("CASE WHEN count(*) > 1 THEN sqrt(var_pop(lat) * 111.32 * 111.32 + var_pop(lon) * pow(111.32 * cos(radians(avg(lat))), 2)) END"))
    per_user("agg_distance_from_home", f.distance_from_home(**at, samples=10), "")
    _SQL["agg_distance_from_home"] = f"""WITH {EVENTS_SQL}, {_ranked('true')}, z AS (SELECT user_id, avg(lat) FILTER (WHERE b <= 10) AS a, avg(lon) FILTER (WHERE b <= 10) AS o, max(lat) FILTER (WHERE b = 1) AS x, max(lon) FILTER (WHERE b = 1) AS y FROM m GROUP BY user_id)
 SELECT user_id, {r6(_hav('x', 'y', 'a', 'o'))} AS feature FROM z"""


def _approximate() -> None:
    """Sketches: no exact SQL, rows only."""
    per_user("agg_n_unique_approx", f.n_unique("value", approx=True), "")
    per_user("agg_quantile_approx", f.quantile("value", q=0.5, approx=True), "")


# row operators and expressions ------------------------------------------------------------------------

EVENT = EventSource("Event", {"event_id": "i64", "user_id": "i64", "event_type": "str", "value": "f64", "k": "str"})


def _rows(name: str, steps, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir).df.select("event_id", "user_id", "event_type", "value", "k")
        return rounded(chain.apply(df, steps, schema_of(df.schema))[0])

    _QUERIES[name] = query
    _SQL[name] = sql.replace("FROM e", "FROM (SELECT event_id, user_id, event_type, value, props->>'$.k' AS k FROM events) e")


def _row_operators() -> None:
    c = EVENT
    _rows("row_filter", c.filter((col("value") > 50) & (col("event_type") != "view")).steps, "SELECT event_id, user_id, event_type, value, k FROM e WHERE value > 50 AND event_type <> 'view'")
    _rows("row_select", c.select("value", "event_id").steps, "SELECT value, event_id FROM e")
    _rows("row_drop", c.drop("k", "event_type").steps, "SELECT event_id, user_id, value FROM e")
    _rows("row_rename", c.rename(event_id="user_id", user_id="event_id", value="amount").steps, "SELECT event_id AS user_id, user_id AS event_id, event_type, value AS amount, k FROM e")
    _rows("row_with_columns", c.with_columns(a=col("event_id") + 1, b=col("a") * 10, event_id=col("b") - col("a")).steps, "SELECT event_id * 9 + 9 AS event_id, user_id, event_type, value, k, event_id + 1 AS a, (event_id + 1) * 10 AS b FROM e")
    _rows("row_map", c.map(double=col("value") * 2).steps, f"SELECT event_id, user_id, event_type, value, k, {r6('value * 2')} AS double FROM e")
    _rows("row_cast", c.cast(value="int", k="int", user_id="str").steps, "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(trunc(value) AS BIGINT) AS value, TRY_CAST(k AS BIGINT) AS k FROM e")
    nulls = c.with_columns(half=parse("cast(k, int) / (cast(k, int) - 50)")).fillna(half=-1)
    _rows("row_fillna", nulls.steps, "SELECT event_id, user_id, event_type, value, k, coalesce(CAST(k AS BIGINT) // nullif(CAST(k AS BIGINT) - 50, 0), -1) AS half FROM e".replace("CAST(k AS BIGINT) // nullif(CAST(k AS BIGINT) - 50, 0)", "CAST(trunc(CAST(k AS DOUBLE) / nullif(CAST(k AS DOUBLE) - 50, 0)) AS BIGINT)"))


def _expressions() -> None:
    i, v = col("event_id"), col("value")
    k = col("k").cast("int")

    def one(name: str, e, sql: str) -> None:
        _rows(name, EVENT.with_columns(out=e).select("event_id", "out").steps, f"SELECT event_id, {sql} AS out FROM e")

    one("expr_col_lit", lit("x"), "'x'")
    one("expr_add", i + k, "event_id + CAST(k AS BIGINT)")
    one("expr_add_saturating", i + lit((1 << 63) - 100), "CAST(least(CAST(event_id AS HUGEINT) + 9223372036854775708, 9223372036854775807) AS BIGINT)")
    one("expr_subtract", 100 - v, r6("100 - value"))
    one("expr_multiply_saturating", (i - 500) * lit(1 << 60), f"CAST(greatest(least(CAST(event_id - 500 AS HUGEINT) * {1 << 60}, 9223372036854775807), -9223372036854775808) AS BIGINT)")
    one("expr_divide_int", (i - 500) / (k - 50), "CAST(trunc(CAST(event_id - 500 AS DOUBLE) / nullif(CAST(k AS DOUBLE) - 50, 0)) AS BIGINT)")
    one("expr_divide_float", v / (k - 50) > 1e300, "CASE WHEN CAST(k AS BIGINT) = 50 THEN value > 0 ELSE value / nullif(CAST(k AS BIGINT) - 50, 0) > 1e300 END")
    one("expr_compare", (v >= 50) & (i < 700), "value >= 50 AND event_id < 700")
    one("expr_equal_nan", (v - v) / (v - v) == (v - v) / (v - v), "false")
    one("expr_not_equal", col("event_type") != "click", "event_type <> 'click'")
    one("expr_kleene", (k / (k - 50) > 0) | (i > 500), "(CASE WHEN CAST(k AS BIGINT) = 50 THEN NULL ELSE trunc(CAST(k AS DOUBLE) / (CAST(k AS DOUBLE) - 50 + CASE WHEN CAST(k AS BIGINT) = 50 THEN 1 ELSE 0 END)) > 0 END) OR event_id > 500")
    one("expr_isnull", isnull(k / (k - 50)), "CAST(k AS BIGINT) = 50")
    one("expr_null_test", parse("cast(event_type, int) == null"), "true")
    one("expr_cast_str", (i / 2).cast("str"), "CAST(event_id // 2 AS VARCHAR)")
    one("expr_cast_bool", (v > 50).cast("int"), "CAST(value > 50 AS BIGINT)")
    one("expr_reversed", 100 < i, "event_id > 100")
    one("expr_text", parse("not (value > 50 and event_id <= 900) or event_type == 'click'"), "NOT (value > 50 AND event_id <= 900) OR event_type = 'click'")
    one("expr_quadkey", quadkey(k * 1.0 - 50.0, v - 100.0, 8), "CAST(floor((value - 100.0 + 180.0) / 360.0 * 256) * 256 + greatest(0, least(255, floor((sin(radians(least(85.05112878, greatest(-85.05112878, CAST(k AS DOUBLE) - 50.0)))) + 1) / 2 * 256))) AS BIGINT)")


# tables of several features, lifecycle, reads -----------------------------------------------------------


def _tables() -> None:
    small = {"n": f.count(), "total": f.sum("value")}

    def put(name: str, query, sql: str) -> None:
        _QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
        if sql:
            _SQL[name] = f"WITH {EVENTS_SQL} {sql}" if not sql.startswith(",") else f"WITH {EVENTS_SQL}{sql}"

    put("table_global", lambda s, d: feature_table(events(s, d), (), small | {"kinds": f.n_unique("event_type")}), f"SELECT count(*) AS n, {r6('sum(value)')} AS total, count(DISTINCT event_type) AS kinds FROM e HAVING count(*) > 0")
    put("table_composite_key", lambda s, d: feature_table(events(s, d), ("user_id", "event_type"), small | {"last": f.last("value")}), f"SELECT user_id, event_type, count(*) AS n, {r6('sum(value)')} AS total, arg_max(value, (t, event_id)) AS last FROM e GROUP BY ALL")
    steps = EVENT.filter(col("value") > 20).with_columns(cents=(col("value") * 100).cast("int"), big=col("value") > 100).steps
    put("table_chain", lambda s, d: feature_table(events(s, d), ("big",), {"n": f.count(), "cents": f.sum("cents")}, steps=steps), f"SELECT value > 100 AS big, count(*) AS n, {r6('sum(trunc(value * 100))')} AS cents FROM e WHERE value > 20 GROUP BY ALL")
    put(
        "table_fan_out",
        lambda s, d: feature_table(events(s, d), ("user_id",), small).join(feature_table(events(s, d), ("event_type",), {"n": f.count()}).agg(F.max("n").alias("most")), F.lit(True), "cross"),
        f"SELECT user_id, count(*) AS n, {r6('sum(value)')} AS total, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY event_type)) AS most FROM e GROUP BY user_id",
    )
    cold = EventSource("Event", EVENT.schema, cold_after="1d")
    put("table_cold_after", lambda s, d: feature_table(events(s, d), ("user_id",), small, source=cold), f", g AS (SELECT *, t - lag(t) OVER ({W}) AS gap FROM e), s AS (SELECT *, sum(CASE WHEN gap > 86400000 THEN 1 ELSE 0 END) OVER ({W}) AS s FROM g), m AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS z FROM s) SELECT user_id, count(*) AS n, {r6('sum(value)')} AS total FROM m WHERE s = z GROUP BY user_id")
    once = EventSource("Event", EVENT.schema, dedupe_key="k", dedupe_window="2h")
    accepted = f""", o AS (SELECT event_id, t, k, value, user_id, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS r FROM e WHERE k IS NOT NULL),
 x(k, r, until, ok) AS (SELECT k, r, t + {2 * HOUR}, true FROM o WHERE r = 1 UNION ALL SELECT o.k, o.r, CASE WHEN o.t >= x.until THEN o.t + {2 * HOUR} ELSE x.until END, o.t >= x.until FROM x JOIN o ON o.k = x.k AND o.r = x.r + 1),
 a AS (SELECT o.* FROM o JOIN x USING (k, r) WHERE x.ok) SELECT user_id, count(*) AS n, {r6('sum(value)')} AS total FROM a GROUP BY user_id"""
    put("table_dedupe", lambda s, d: feature_table(events(s, d), ("user_id",), small, source=once), "")
    _SQL["table_dedupe"] = f"WITH RECURSIVE {EVENTS_SQL}{accepted}"
    at = 1_705_000_000_000
    put("table_as_of", lambda s, d: feature_table(Stream(events(s, d).df.filter(F.unix_millis(F.col("ts").cast("timestamp")) <= at), "ts", ("event_id",)), ("user_id",), {"n": f.count(window="7d"), "age": f.age()}, query_time=at), f"SELECT user_id, count(*) FILTER (WHERE {active(WEEK).replace('now', str(at))}) AS n, {at} - min(t) AS age FROM e WHERE t <= {at} GROUP BY user_id")
    put("read_get", lambda s, d: feature_table(events(s, d), ("user_id",), small, only=F.col("user_id") == 7), f"SELECT user_id, count(*) AS n, {r6('sum(value)')} AS total FROM e WHERE user_id = 7 GROUP BY user_id")
    put("read_batch_get", lambda s, d: feature_table(events(s, d), ("user_id",), small, only=F.col("user_id").isin(1, 5, 9, -1)), f"SELECT user_id, count(*) AS n, {r6('sum(value)')} AS total FROM e WHERE user_id IN (1, 5, 9, -1) GROUP BY user_id")
    # other tables as sources
    orders = lambda s, d: Stream(s.read.parquet(f"{d}/orders.parquet"), "o_orderdate", ("o_orderkey",))
    _QUERIES["table_orders"] = lambda s, d: rounded(feature_table(orders(s, d), ("o_custkey",), {"n": f.count(), "spent": f.sum("o_totalprice"), "last": f.last("o_totalprice"), "high": f.max("o_totalprice")}))
    _SQL["table_orders"] = f"SELECT o_custkey, count(*) AS n, {r6('sum(o_totalprice)')} AS spent, {r6('arg_max(o_totalprice, (o_orderdate, o_orderkey))')} AS last, max(o_totalprice) AS high FROM orders GROUP BY o_custkey"
    lines = lambda s, d: Stream(s.read.parquet(f"{d}/lineitem.parquet"), "l_shipdate", ("l_orderkey", "l_linenumber"))
    _QUERIES["table_lineitem"] = lambda s, d: rounded(feature_table(lines(s, d), ("l_suppkey",), {"n": f.count(), "quantity": f.mean("l_quantity"), "discounted": f.ratio(where=col("l_discount") > 0.05), "flags": f.n_unique("l_returnflag")}))
    _SQL["table_lineitem"] = f"SELECT l_suppkey, count(*) AS n, {r6('avg(l_quantity)')} AS quantity, {r6('count(*) FILTER (WHERE l_discount > 0.05) / count(*)')} AS discounted, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey"


def packs() -> dict[str, dict[str, Feature]]:
    """Feature packs of the size classes that the benchmark runs."""
    money = {f"{name}_{op}": getattr(f, op)(field) for name, field in (("value", "value"), ("id", "event_id")) for op in ("sum", "mean", "min", "max")}
    large = {"n": f.count(), **money, "value_var": f.var("value"), "value_std": f.std("value"), "lat_sum": f.sum("lat"), "lat_mean": f.mean("lat"), "lat_min": f.min("lat"), "lat_max": f.max("lat")}
    sketches = {"kinds": f.n_unique("k", window="1h"), "p99": f.quantile("value", q=0.99, window="1h"), "top": f.top_k("k", k=5, window="1h"), "known": f.bloom_member("k"), "spread": f.entropy("event_type", window="1h")}
    return {
        "small": {"n": f.count()},
        "medium": {"n": f.count(), **{op: getattr(f, op)("value") for op in ("sum", "mean", "min", "max")}},
        "large": large,
        "large_with_sketches": large | sketches,
        "ordinal": {"n": f.count(), "total": f.sum("value"), "first": f.first("value"), "last": f.last("value"), "before": f.lag("value", n=1), "recent": f.last_n("value", n=3), "start": f.first_seen(), "end": f.last_seen(), "age": f.age(), "run": f.streak()},
        "velocity": {"ewma": f.ewma("value", half_life="1m"), "ewvar": f.ewvar("value", half_life="1m"), "decayed": f.decayed_sum("value", half_life="1m"), "decayed_n": f.decayed_count(half_life="1m"), "rate": f.rate_of_change("value", window="5m"), "twa": f.twa("value", window="5m"), "delta": f.delta_from_prev("value"), "trend": f.trend("value"), "z": f.z_score("value"), "changes": f.value_change_count("event_type")},
        "geo": {"speed": f.geo_velocity(lat="lat", lon="lon"), "path": f.geo_distance(lat="lat", lon="lon"), "recent": f.most_recent_n("value", n=5)},
    }


def _packs() -> None:
    for name, pack in packs().items():

        def query(spark, sf_dir, pack=pack):
            out = feature_table(events(spark, sf_dir), ("user_id",), pack)
            for c, t in out.dtypes:
                if t.startswith("array<struct"):
                    out = out.withColumn(c, _top_text(F.col(c)))
                elif t.startswith("array"):
                    out = out.withColumn(c, _list_text(F.col(c)))
                elif c in ("speed", "path"):
                    out = out.withColumn(c, F.round(F.col(c) + SHIFT, 3))
            return rounded(out)

        _QUERIES[f"pack_{name}"] = query
    for name, (columns, parts) in _pack_sql().items():
        joins = " ".join(f"LEFT JOIN ({q}) {p} USING (user_id)" for p, q in parts.items())
        _SQL[f"pack_{name}"] = f"WITH {EVENTS_SQL}, b AS (SELECT user_id{columns and ', ' + columns} FROM e GROUP BY user_id) SELECT * FROM b {joins}"


def _pack_sql() -> dict[str, tuple[str, dict[str, str]]]:
    """Per pack: aggregates over e, and queries of (user_id, features) for what a single aggregate cannot give."""
    both = ", ".join(f"{r6(f'{agg}({c})') if op in ('sum', 'mean') else f'{agg}({c})'} AS {name}_{op}" for name, c in (("value", "value"), ("id", "event_id")) for op, agg in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")))
    lat = f"{r6('sum(lat)')} AS lat_sum, {r6('avg(lat)')} AS lat_mean, {r6('min(lat)')} AS lat_min, {r6('max(lat)')} AS lat_max"
    large = f"count(*) AS n, {both}, {r6('var_samp(value)')} AS value_var, {r6('stddev_samp(value)')} AS value_std, {lat}"
    hour = active(HOUR)
    top = f"""SELECT u.user_id, coalesce(string_agg(b.k || ':' || b.n, ',' ORDER BY b.r), '') AS top FROM (SELECT DISTINCT user_id FROM e) u
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) AS r FROM (SELECT user_id, k, count(*) AS n FROM e WHERE {hour} AND k IS NOT NULL GROUP BY ALL)) b ON u.user_id = b.user_id AND b.r <= 5 GROUP BY u.user_id"""
    spread = f"""SELECT u.user_id, {r6('coalesce(greatest(h.h, 0.0), 0.0)')} AS spread FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN (SELECT user_id, -sum(p * log2(p)) AS h FROM
 (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*) AS n FROM e WHERE {hour} GROUP BY ALL)) GROUP BY user_id) h USING (user_id)"""
    seen = f"count(DISTINCT k) FILTER (WHERE {hour}) AS kinds, {r6(f'quantile_cont(value, 0.99) FILTER (WHERE {hour})')} AS p99, count(k) > 0 AS known"
    ranked = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS b FROM e"

    def recent(n: int, more: str = "") -> str:
        return f"SELECT user_id, coalesce(string_agg(CAST(value AS VARCHAR), ',' ORDER BY b DESC) FILTER (WHERE b <= {n}), '') AS recent{more} FROM ({ranked}) GROUP BY user_id"

    rate = "(ln(2.0) / 60000.0)"
    gaps = f"(SELECT *, lag(t) OVER ({W}) AS pt, lag(value) OVER ({W}) AS pv, lag(event_type) OVER ({W}) AS pe, max(t) OVER (PARTITION BY user_id) AS tl FROM e)"
    ewma = f"""SELECT user_id, {r6("sum(al * value * exp(ca - cl))")} AS ewma FROM (SELECT *, sum(lw) OVER ({W}) AS cl, sum(lw) OVER (PARTITION BY user_id) AS ca FROM
 (SELECT *, CASE WHEN pt IS NULL THEN 1.0 WHEN t > pt THEN 1 - exp(-{rate} * (t - pt)) ELSE 0.5 END AS al, CASE WHEN pt IS NULL THEN 0.0 WHEN t > pt THEN -{rate} * (t - pt) ELSE ln(0.5) END AS lw FROM {gaps})) GROUP BY user_id"""
    ewvar = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER ({W}) AS r FROM e),
 x(user_id, r, t, mean, m2) AS (SELECT user_id, r, t, value, CAST(0.0 AS DOUBLE) FROM o WHERE r = 1
 UNION ALL SELECT o.user_id, o.r, greatest(x.t, o.t), x.mean + a.al * (o.value - x.mean), (1 - a.al) * x.m2 + a.al * (o.value - x.mean) * (o.value - (x.mean + a.al * (o.value - x.mean)))
 FROM x JOIN o ON o.user_id = x.user_id AND o.r = x.r + 1, LATERAL (SELECT CASE WHEN o.t > x.t THEN 1 - exp(-{rate} * (o.t - x.t)) ELSE 0.0 END AS al) a)
 SELECT user_id, {r6('greatest(arg_max(m2, r), 0.0)')} AS ewvar FROM x GROUP BY user_id"""
    steps = f"""SELECT user_id, {r6(f'sum(value * exp(-{rate} * (tl - t)))')} AS decayed, {r6(f'sum(exp(-{rate} * (tl - t)))')} AS decayed_n, {r6('arg_max((value - pv) / (t - pt), (t, event_id)) FILTER (WHERE t > pt)')} AS rate,
 {r6('CASE WHEN sum(t - pt) > 0 THEN sum(pv * (t - pt)) / sum(t - pt) ELSE arg_max(value, (t, event_id)) END')} AS twa, {r6('arg_max(value - pv, (t, event_id))')} AS delta, count(*) FILTER (WHERE pe IS NOT NULL AND pe <> event_type) AS changes FROM {gaps} GROUP BY user_id"""
    line = f"{r6('regr_slope(value, (t - now) / 86400000.0) / 86400000.0')} AS trend, {r6('CASE WHEN var_samp(value) > 0 THEN (arg_max(value, (t, event_id)) - avg(value)) / stddev_samp(value) END')} AS z"
    hops = f"(SELECT *, {_hav('pa', 'po', 'lat', 'lon')} AS km FROM (SELECT *, lag(lat) OVER ({W}) AS pa, lag(lon) OVER ({W}) AS po, lag(t) OVER ({W}) AS pt FROM e))"
    # as for the single features, three digits are kept of lengths that come from doubles
    path = f"SELECT user_id, round(coalesce(max(km / ((t - pt) / 3600000.0)) FILTER (WHERE t > pt), 0.0) + {SHIFT}, 3) AS speed, round(coalesce(sum(km), 0.0) + {SHIFT}, 3) AS path FROM {hops} GROUP BY user_id"
    return {
        "small": ("count(*) AS n", {}),
        "medium": (f"count(*) AS n, {r6('sum(value)')} AS sum, {r6('avg(value)')} AS mean, min(value) AS min, max(value) AS max", {}),
        "large": (large, {}),
        "large_with_sketches": (f"{large}, {seen}", {"p": top, "q": spread}),
        "ordinal": (f"count(*) AS n, {r6('sum(value)')} AS total, arg_min(value, (t, event_id)) AS first, arg_max(value, (t, event_id)) AS last, min(t) AS start, max(t) AS end, max(now) - min(t) AS age, count(*) AS run", {"p": recent(3, ", max(value) FILTER (WHERE b = 2) AS before")}),
        "velocity": (line, {"p": ewma, "q": ewvar, "r": steps}),
        "geo": ("", {"p": path, "q": recent(5)}),
    }


for _part in (_core, _points, _decay, _buffers, _places, _approximate, _row_operators, _expressions, _tables, _packs):
    _part()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, derive, group: lifetime and windowed features as of the last event."""
    steps = EVENT.filter(col("value") > 1).with_columns(big=col("value") > 100).steps
    pack = {"n": f.count(), "week": f.count(window="7d"), "total": f.sum("value"), "mean": f.mean("value", window="7d"), "big_share": f.ratio(where=col("big")), "last": f.last("event_type"), "top": f.top_k("event_type", k=1)}
    out = feature_table(events(spark, sf_dir), ("user_id",), pack, steps=steps)
    return rounded(out.withColumn("top", _top_text(F.col("top"))))


FLAGSHIP_SQL = f"""WITH {EVENTS_SQL}, v AS (SELECT * FROM e WHERE value > 1), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM v GROUP BY ALL))
 SELECT v.user_id, count(*) AS n, count(*) FILTER (WHERE {W7}) AS week, {r6('sum(value)')} AS total, {r6(f'avg(value) FILTER (WHERE {W7})')} AS mean, {r6('count(*) FILTER (WHERE value > 100) / count(*)')} AS big_share,
 arg_max(v.event_type, (t, event_id)) AS last, max(b.event_type || ':' || b.n) AS top FROM v JOIN b ON v.user_id = b.user_id AND b.r = 1 GROUP BY v.user_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES) | {"flagship": flagship}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) | {"flagship": FLAGSHIP_SQL}
