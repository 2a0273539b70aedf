"""Constructors of feature aggregates, with the checks that need no schema."""

from __future__ import annotations

import builtins
import math
import warnings
from typing import Any

from ..errors import RegistrationError
from ..functions.expr import Expr, as_expr
from ..model import Feature, duration_ms

#: operators that keep only events of a window
WINDOWED = frozenset("count sum mean min max var std ratio n_unique quantile top_k entropy".split())
#: operators that refuse a window
LIFETIME = frozenset("first last first_n last_n lag first_seen last_seen age has_seen time_since time_since_last_n streak max_streak negative_streak histogram hour_of_day_histogram dow_hour_histogram seasonal_deviation event_type_mix most_recent_n reservoir_sample geo_velocity geo_distance geo_spread distance_from_home".split())
#: operators that take a window and work on the whole life all the same
WINDOW_IGNORED = frozenset("ewma ema ewvar ew_zscore decayed_sum decayed_count twa rate_of_change inter_arrival_stats burst_count delta_from_prev trend trend_residual outlier_count value_change_count z_score".split())
OPERATORS = WINDOWED | LIFETIME | WINDOW_IGNORED | {"bloom_member", "first_seen_in_window"}
#: parameter each operator must have to be bounded
REQUIRED = {"first_n": "n", "last_n": "n", "lag": "n", "time_since_last_n": "n", "most_recent_n": "n", "reservoir_sample": "samples", "histogram": "buckets"}
MAX_N = 1024


def _field(op: str, name: Any) -> str:
    if not isinstance(name, str) or not name:
        raise RegistrationError("schema_mismatch", f"{op} takes the name of a column; derive columns by with_columns", op)
    return name


def _where(e: Any) -> Expr | None:
    if e is None or isinstance(e, Expr):
        return e
    if isinstance(e, str):
        return as_expr(e)
    raise TypeError(f"where must be an expression; got {type(e).__name__}")


def _feature(op: str, field: Any = None, *, where: Any = None, window: str | None = None, half_life: str | None = None, needs_field: bool = True, **params: Any) -> Feature:
    duration_ms(window)
    if half_life is not None and duration_ms(half_life) is None:
        raise ValueError(f"{op}: half_life must be finite")
    return Feature(op, _field(op, field) if needs_field else None, window, half_life, _where(where), params)


def _count_of(op: str, name: str, n: Any) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"{op}: {name} is a whole number from 1 on, not {n!r}")
    return n


def count(*, window=None, where=None):
    return _feature("count", window=window, where=where, needs_field=False)


def sum(field, *, window=None, where=None):  # noqa: A001
    return _feature("sum", field, window=window, where=where)


def mean(field, *, window=None, where=None):
    return _feature("mean", field, window=window, where=where)


def min(field, *, window=None, where=None):  # noqa: A001
    return _feature("min", field, window=window, where=where)


def max(field, *, window=None, where=None):  # noqa: A001
    return _feature("max", field, window=window, where=where)


def var(field, *, window=None, where=None):
    return _feature("var", field, window=window, where=where)


def std(field, *, window=None, where=None):
    return _feature("std", field, window=window, where=where)


def ratio(*, window=None, where=None):
    return _feature("ratio", window=window, where=where, needs_field=False)


def n_unique(field, *, window=None, where=None, approx: bool = False):
    return _feature("n_unique", field, window=window, where=where, **({"approx": True} if approx else {}))


def quantile(field, *, q, window=None, where=None, approx: bool = False):
    if q is None or not 0.0 < q < 1.0:
        raise ValueError(f"quantile q must be in (0, 1); got {q}")
    return _feature("quantile", field, window=window, where=where, q=q, **({"approx": True} if approx else {}))


def top_k(field, *, k, window=None, where=None, approx: bool = False):
    return _feature("top_k", field, window=window, where=where, k=_count_of("top_k", "k", k), **({"approx": True} if approx else {}))


def bloom_member(field, *, window=None, where=None):
    return _feature("bloom_member", field, window=window, where=where)


def entropy(field, *, window=None, where=None):
    return _feature("entropy", field, window=window, where=where)


def first(field, *, where=None):
    return _feature("first", field, where=where)


def last(field, *, where=None):
    return _feature("last", field, where=where)


def first_n(field, *, n, where=None):
    return _feature("first_n", field, where=where, n=_count_of("first_n", "n", n))


def last_n(field, *, n, where=None):
    return _feature("last_n", field, where=where, n=_count_of("last_n", "n", n))


def lag(field, *, n=1, where=None):
    return _feature("lag", field, where=where, n=_count_of("lag", "n", n))


def first_seen(*, where=None):
    return _feature("first_seen", where=where, needs_field=False)


def last_seen(*, where=None):
    return _feature("last_seen", where=where, needs_field=False)


def age(*, where=None):
    return _feature("age", where=where, needs_field=False)


def has_seen(*, where=None):
    return _feature("has_seen", where=where, needs_field=False)


def time_since(*, where=None):
    return _feature("time_since", where=where, needs_field=False)


def time_since_last_n(*, n, where=None):
    return _feature("time_since_last_n", where=where, needs_field=False, n=_count_of("time_since_last_n", "n", n))


def streak(*, where=None):
    return _feature("streak", where=where, needs_field=False)


def max_streak(*, where=None):
    return _feature("max_streak", where=where, needs_field=False)


def negative_streak(*, where=None):
    return _feature("negative_streak", where=where, needs_field=False)


def first_seen_in_window(*, window, where=None):
    return _feature("first_seen_in_window", window=window, where=where, needs_field=False)


def ewma(field, *, half_life, window=None, where=None):
    return _feature("ewma", field, half_life=half_life, window=window, where=where)


ema = ewma


def ewvar(field, *, half_life, window=None, where=None):
    return _feature("ewvar", field, half_life=half_life, window=window, where=where)


def ew_zscore(field, *, half_life, window=None, where=None):
    return _feature("ew_zscore", field, half_life=half_life, window=window, where=where)


def decayed_sum(field, *, half_life, window=None, where=None):
    return _feature("decayed_sum", field, half_life=half_life, window=window, where=where)


def decayed_count(*, half_life, where=None):
    return _feature("decayed_count", half_life=half_life, where=where, needs_field=False)


def twa(field, *, window=None, where=None):
    return _feature("twa", field, window=window, where=where)


def rate_of_change(field, *, window=None, where=None):
    return _feature("rate_of_change", field, window=window, where=where)


def inter_arrival_stats(*, window=None, where=None):
    return _feature("inter_arrival_stats", window=window, where=where, needs_field=False)


def burst_count(*, sub_window, window=None, where=None):
    if duration_ms(sub_window) is None:
        raise ValueError("burst_count sub_window must be finite")
    return _feature("burst_count", window=window, where=where, needs_field=False, sub_window=sub_window)


def delta_from_prev(field, *, where=None):
    return _feature("delta_from_prev", field, where=where)


def trend(field, *, window=None, where=None):
    return _feature("trend", field, window=window, where=where)


def trend_residual(field, *, window=None, where=None):
    return _feature("trend_residual", field, window=window, where=where)


def outlier_count(field, *, sigma=3.0, window=None, where=None):
    if not sigma > 0:
        raise ValueError(f"outlier_count sigma must be > 0; got {sigma}")
    return _feature("outlier_count", field, window=window, where=where, sigma=float(sigma))


def value_change_count(field, *, window=None, where=None):
    return _feature("value_change_count", field, window=window, where=where)


def z_score(field, *, baseline_window=None, where=None):
    duration_ms(baseline_window)
    return _feature("z_score", field, where=where, **({"baseline_window": baseline_window} if baseline_window else {}))


def histogram(field, *, buckets, where=None):
    if not isinstance(buckets, list) or not buckets or any(not isinstance(b, (int, float)) or math.isnan(b) for b in buckets):
        raise ValueError(f"histogram buckets must be a non-empty list of numbers; got {buckets!r}")
    if any(b <= a for a, b in zip(buckets, buckets[1:], strict=False)):
        raise ValueError(f"histogram buckets must increase; got {buckets!r}")
    return _feature("histogram", field, where=where, buckets=[float(b) for b in buckets])


def hour_of_day_histogram(*, where=None):
    return _feature("hour_of_day_histogram", where=where, needs_field=False)


def dow_hour_histogram(*, where=None):
    return _feature("dow_hour_histogram", where=where, needs_field=False)


def seasonal_deviation(field, *, where=None):
    return _feature("seasonal_deviation", field, where=where)


def event_type_mix(field, *, categories=None, max_categories=256, where=None):
    _count_of("event_type_mix", "max_categories", max_categories)
    if categories is not None and (not isinstance(categories, list) or builtins.any(not isinstance(c, str) for c in categories)):
        raise ValueError(f"event_type_mix categories must be a list of str; got {categories!r}")
    return _feature("event_type_mix", field, where=where, max_categories=max_categories, **({"categories": list(categories)} if categories is not None else {}))


def most_recent_n(field, *, n, where=None):
    return _feature("most_recent_n", field, where=where, n=_count_of("most_recent_n", "n", n))


def reservoir_sample(field, *, samples, where=None):
    return _feature("reservoir_sample", field, where=where, samples=_count_of("reservoir_sample", "samples", samples))


def _geo(op: str, lat: str, lon: str, where: Any, **params: Any) -> Feature:
    return _feature(op, where=where, needs_field=False, lat=_field(op, lat), lon=_field(op, lon), **params)


def geo_velocity(*, lat, lon, where=None):
    return _geo("geo_velocity", lat, lon, where)


def geo_distance(*, lat, lon, where=None):
    return _geo("geo_distance", lat, lon, where)


def geo_spread(*, lat, lon, where=None):
    return _geo("geo_spread", lat, lon, where)


def distance_from_home(*, lat, lon, samples=100, where=None):
    return _geo("distance_from_home", lat, lon, where, samples=_count_of("distance_from_home", "samples", samples))


def _old_name(old: str, new):
    def helper(field, **kw):
        warnings.warn(f"{old} is now {new.__name__}", DeprecationWarning, stacklevel=2)
        if old == "percentile":
            kw["q"] = kw.pop("p")
        return new(field, **kw)

    helper.__name__ = old
    return helper


avg = _old_name("avg", mean)
variance = _old_name("variance", var)
stddev = _old_name("stddev", std)
count_distinct = _old_name("count_distinct", n_unique)
percentile = _old_name("percentile", quantile)
