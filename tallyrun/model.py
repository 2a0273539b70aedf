"""Declarations: event sources, derivations (chains of row operators) and keyed feature tables."""

from __future__ import annotations

import inspect
import re
import typing
from collections.abc import Callable
from dataclasses import dataclass, replace
from dataclasses import field as _with
from typing import Any

from .errors import RegistrationError
from .functions.expr import Expr, as_expr, wrap
from .functions.types import OF_ANNOTATION, OF_CAST

_DURATION = re.compile(r"(\d+)(ms|s|m|h|d)")
_UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
DEDUPE_WINDOW = "24h"


def duration_ms(text: str | None) -> int | None:
    """Milliseconds; None for no duration and for `forever`."""
    if text is None or text == "forever":
        return None
    m = _DURATION.fullmatch(text) if isinstance(text, str) else None
    if not m or int(m[1]) == 0:
        raise ValueError(f"invalid duration {text!r}: digits and one of ms, s, m, h, d, or 'forever'")
    return int(m[1]) * _UNIT_MS[m[2]]


@dataclass(frozen=True)
class Feature:
    """One named aggregate: an operator, its field and its parameters."""

    op: str
    field: str | None = None
    window: str | None = None
    half_life: str | None = None
    where: Expr | None = None
    params: dict[str, Any] = _with(default_factory=dict)

    def describe(self) -> dict[str, Any]:
        d: dict[str, Any] = {"op": self.op}
        for k in ("field", "window", "half_life"):
            if getattr(self, k) is not None:
                d[k] = getattr(self, k)
        if self.where is not None:
            d["where"] = str(self.where)
        return d | self.params


class Chain:
    """Row operators, for sources and derivations alike."""

    def _then(self, op: str, payload: Any) -> Derivation:
        return Derivation(self.name, root_of(self), (*self.steps, (op, payload)), None)

    def filter(self, e: Any) -> Derivation:
        return self._then("filter", as_expr(e))

    def select(self, *cols: str) -> Derivation:
        return self._then("select", list(cols))

    def drop(self, *cols: str) -> Derivation:
        return self._then("drop", list(cols))

    def rename(self, **mapping: str) -> Derivation:
        return self._then("rename", dict(mapping))

    def with_columns(self, **exprs: Any) -> Derivation:
        return self._then("with_columns", {k: wrap(v) for k, v in exprs.items()})

    map = with_columns

    def cast(self, **types: str) -> Derivation:
        for k, v in types.items():
            if v not in OF_CAST:
                raise ValueError(f"cast target {v!r} for {k!r} not in {tuple(OF_CAST)}")
        return self._then("cast", dict(types))

    def fillna(self, **defaults: Any) -> Derivation:
        return self._then("fillna", dict(defaults))

    def named(self, name: str) -> Derivation:
        return Derivation(name, root_of(self), self.steps, None)

    def group_by(self, *keys: str) -> GroupBy:
        return GroupBy(self, tuple(keys))

    def agg(self, **features: Feature) -> Derivation:
        return self.group_by().agg(**features)


@dataclass(frozen=True)
class EventSource(Chain):
    name: str
    schema: dict[str, str]
    optional: frozenset[str] = frozenset()
    keep_events_for: str | None = None
    cold_after: str | None = None
    dedupe_key: str | None = None
    dedupe_window: str | None = None
    steps: tuple = ()


@dataclass(frozen=True)
class Derivation(Chain):
    name: str
    root: EventSource
    steps: tuple
    grouped: tuple[tuple[str, ...], dict[str, Feature]] | None


@dataclass(frozen=True)
class GroupBy:
    of: Chain
    keys: tuple[str, ...]

    def agg(self, **features: Feature) -> Derivation:
        for name, f in features.items():
            if not isinstance(f, Feature):
                raise TypeError(f"feature {name!r} must be an aggregate; got {type(f).__name__}")
        return Derivation(self.of.name, root_of(self.of), self.of.steps, (self.keys, dict(features)))


@dataclass(frozen=True)
class Table:
    name: str
    keys: tuple[str, ...]
    root: EventSource
    steps: tuple
    features: dict[str, Feature]


def root_of(chain: Chain) -> EventSource:
    return chain if isinstance(chain, EventSource) else chain.root


_SOURCE_OPTIONS = ("keep_events_for", "cold_after", "dedupe_key", "dedupe_window")
_NO_EVENT_TIME = ("event_time_field", "tolerate_delay")


def _source(cls: type, options: dict[str, Any]) -> EventSource:
    schema, optional = {}, set()
    for name, kind in typing.get_type_hints(cls).items():
        if name == "event_time":
            raise TypeError("events are ordered by arrival; a field event_time is not allowed")
        args = typing.get_args(kind)
        if type(None) in args:
            optional.add(name)
            kind = next(a for a in args if a is not type(None))
        schema[name] = OF_ANNOTATION.get(kind, "str")
    return EventSource(cls.__name__, schema, frozenset(optional), **options)


def _parameter(f: Callable, what: str):
    params = list(inspect.signature(f).parameters.values())
    if len(params) != 1:
        raise TypeError(f"{what} takes one upstream; got {len(params)}")
    upstream = params[0].annotation
    if isinstance(upstream, str):
        upstream = {**f.__globals__, **inspect.getclosurevars(f).nonlocals}.get(upstream, upstream)
    if not isinstance(upstream, (EventSource, Derivation)):
        raise TypeError(f"{what} needs its parameter annotated with an event; got {upstream!r}")
    return upstream


def event(target: Any = None, **options: Any):
    """Declare an event source (a class with annotated fields) or a derivation (a function of one event)."""
    for k in options:
        if k in _NO_EVENT_TIME:
            raise TypeError(f"{k} is not supported: events are ordered by arrival")
        if k not in _SOURCE_OPTIONS:
            raise TypeError(f"unknown option {k!r}")

    def declare(t: Any):
        if isinstance(t, type):
            return _source(t, options)
        upstream = _parameter(t, f"event {t.__name__}")
        out = t(upstream)
        if not isinstance(out, Chain):
            raise TypeError(f"event {t.__name__} must return a chain")
        return replace(out, name=t.__name__)

    return declare(target) if target is not None else declare


def table(target: Any = None, *, key: str | list[str] | None = None):
    """Declare a feature table: a function of one event that returns group_by(...).agg(...)."""
    keys = () if key is None else (key,) if isinstance(key, str) else tuple(key)

    def declare(f: Callable):
        if isinstance(f, type) or not callable(f):
            raise TypeError("a table is declared by a function")
        out = f(_parameter(f, f"table {f.__name__}"))
        if not isinstance(out, Derivation) or out.grouped is None:
            raise TypeError(f"table {f.__name__} must return group_by(...).agg(...)")
        if set(out.grouped[0]) != set(keys):
            raise RegistrationError("invalid_registration", f"key {list(keys)} differs from group_by {list(out.grouped[0])}", f.__name__)
        return Table(f.__name__, out.grouped[0], out.root, out.steps, out.grouped[1])

    return declare(target) if target is not None else declare
