"""The catalogue: validation, differences between versions, installation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import SparkSession

from .errors import RegistrationError
from .functions.expr import ExprError, compile_expr, fields_of
from .functions.types import FIELD_TYPES
from .model import Chain, Derivation, EventSource, GroupBy, Table, duration_ms, root_of
from .operators import chain
from .operators.compile import result_type
from .operators.features import LIFETIME, MAX_N, OPERATORS, REQUIRED

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,127}")
KINDS = {EventSource: "event", Derivation: "derivation", Table: "table"}


@dataclass
class Catalogue:
    """What is installed: sources, derivations, tables, and the registry version each came with."""

    version: int = 0
    events: dict[str, EventSource] = field(default_factory=dict)
    derivations: dict[str, Derivation] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    since: dict[str, int] = field(default_factory=dict)

    def copy(self) -> Catalogue:
        return replace(self, events=dict(self.events), derivations=dict(self.derivations), tables=dict(self.tables), since=dict(self.since))

    def all(self) -> dict[str, Any]:
        return {**self.events, **self.derivations, **self.tables}


def error(code: str, path: str, message: str) -> dict[str, str]:
    return {"code": code, "path": path, "message": message}


def collect(declarations: Iterable[Any]) -> Catalogue:
    """Declarations with the sources they stand on."""
    out, errors = Catalogue(), []

    def put(where: dict, d: Any):
        if d.name in out.all() and out.all()[d.name] != d:
            errors.append(error("invalid_registration", d.name, f"the name {d.name!r} is used twice"))
        where[d.name] = d

    for d in declarations:
        if isinstance(d, Table):
            put(out.events, d.root)
            put(out.tables, d)
        elif isinstance(d, EventSource):
            put(out.events, d)
        elif isinstance(d, Derivation) and d.name != d.root.name:
            if d.grouped is not None:
                raise RegistrationError("invalid_registration", "a grouped chain is registered as a table", d.name)
            put(out.events, d.root)
            put(out.derivations, d)
        elif isinstance(d, (Chain, GroupBy)):
            raise TypeError("a bare chain cannot be registered: declare it with event or table")
        else:
            raise TypeError(f"cannot register {type(d).__name__}")
    if errors:
        raise RegistrationError(errors[0]["code"], errors[0]["message"], errors[0]["path"], errors)
    return out


def check(cat: Catalogue, spark: SparkSession) -> dict[str, dict[str, str]]:
    """Validate in order: structure, then expressions and schemas, then aggregates. Returns each node's output schema."""
    errors: list[dict] = []
    for name, d in cat.all().items():
        if not NAME.fullmatch(name) or name.startswith(chain.RESERVED):
            errors.append(error("invalid_registration", name, "names are letters, digits and _, 128 at most"))
    for name, e in cat.events.items():
        if not e.schema:
            errors.append(error("invalid_registration", name, "an event needs a field"))
        for f, kind in e.schema.items():
            if not NAME.fullmatch(f) or f.startswith(chain.RESERVED):
                errors.append(error("invalid_registration", f"{name}.{f}", "bad field name"))
            if kind not in FIELD_TYPES:
                errors.append(error("invalid_registration", f"{name}.{f}", f"unknown type {kind!r}"))
        for option in ("keep_events_for", "cold_after", "dedupe_window"):
            try:
                duration_ms(getattr(e, option))
            except ValueError as bad:
                errors.append(error("invalid_registration", f"{name}.{option}", str(bad)))
        cold = None if any(x["path"] == f"{name}.cold_after" for x in errors) else duration_ms(e.cold_after)
        if cold is not None and not 1000 <= cold <= 365 * 86_400_000:
            errors.append(error("invalid_registration", f"{name}.cold_after", "cold_after is between 1s and 365d"))
        if e.dedupe_key is not None and e.dedupe_key not in e.schema:
            errors.append(error("invalid_registration", f"{name}.dedupe_key", f"no field {e.dedupe_key!r}"))
        if e.dedupe_window is not None and e.dedupe_key is None:
            errors.append(error("invalid_registration", f"{name}.dedupe_window", "dedupe_window needs dedupe_key"))
    _stop(errors)
    schemas: dict[str, dict[str, str]] = {n: dict(e.schema) for n, e in cat.events.items()}
    for name, d in [*cat.derivations.items(), *cat.tables.items()]:
        try:
            schemas[name] = chain.propagate(d.steps, d.root.schema, spark)
        except RegistrationError as bad:
            errors.append(error("invalid_expression", name, bad.message))
    _stop(errors)
    owner: dict[str, str] = {}
    for name, t in cat.tables.items():
        errors += check_table(t, schemas[name])
        for f in t.features:
            if f in owner:
                errors.append(error("aggregation_feature_name_collision_across_aggregations", f"{name}.{f}", f"also a feature of {owner[f]}"))
            owner.setdefault(f, name)
    _stop(errors)
    for name, t in cat.tables.items():
        own = schemas[name]
        schemas[name] = {k: own[k] for k in t.keys} | {n: result_type(f, own) for n, f in t.features.items()}
    return schemas


def _stop(errors: list[dict]) -> None:
    if errors:
        raise RegistrationError(errors[0]["code"], errors[0]["message"], errors[0]["path"], errors)


def check_table(t: Table, schema: dict[str, str]) -> list[dict]:
    errors: list[dict] = []
    for k in t.keys:
        if k not in schema:
            errors.append(error("aggregation_unknown_field", f"{t.name}.{k}", f"no key field {k!r}"))
        elif schema[k] in ("f64", "bytes", "json"):
            errors.append(error("invalid_registration", f"{t.name}.{k}", f"a {schema[k]} field cannot be a key"))
    if not t.features:
        errors.append(error("invalid_registration", t.name, "a table needs a feature"))
    for name, f in t.features.items():
        path = f"{t.name}.{name}"

        def bad(code: str, message: str, path: str = path):
            errors.append(error(code, path, message))

        if not NAME.fullmatch(name) or name.startswith(chain.RESERVED):
            bad("invalid_registration", "bad feature name")
        if name in t.keys:
            bad("aggregation_group_key_collides_with_feature", "a feature has the name of a key")
        if f.op not in OPERATORS:
            bad("aggregation_unknown_op", f"unknown operator {f.op!r}")
            continue
        if f.op in REQUIRED and REQUIRED[f.op] not in f.params:
            bad("unbounded_op_in_lifetime_mode", f"{f.op} needs {REQUIRED[f.op]}=")
        for used in (f.field, f.params.get("lat"), f.params.get("lon")):
            if used is not None and used not in schema:
                bad("aggregation_unknown_field", f"no field {used!r}")
        try:
            duration_ms(f.window)
        except ValueError as e:
            bad("aggregation_invalid_window", str(e))
        if f.window is not None and f.op == "bloom_member":
            bad("window_not_supported", "bloom_member covers the whole life")
        elif f.window is not None and f.op in LIFETIME:
            bad("aggregation_invalid_window", f"{f.op} covers the whole life")
        for what, value in (("half_life", f.half_life), ("sub_window", f.params.get("sub_window"))):
            try:
                duration_ms(value)
            except ValueError as e:
                bad("invalid_registration", f"{what}: {e}")
        if "q" in f.params and not 0 < f.params["q"] < 1:
            bad("invalid_percentile_q", "q lies between 0 and 1")
        if "k" in f.params and not 1 <= f.params["k"] <= MAX_N:
            bad("invalid_top_k_k", f"k lies between 1 and {MAX_N}")
        if "fpr" in f.params and not 0 < f.params["fpr"] < 1:
            bad("invalid_bloom_fpr", "fpr lies between 0 and 1")
        for n in ("n", "samples"):
            if n in f.params and not 1 <= f.params[n] <= MAX_N:
                bad("invalid_registration", f"{n} lies between 1 and {MAX_N}")
        if f.where is not None:
            try:
                if not fields_of(f.where) <= set(schema) or compile_expr(f.where, schema)[1] != "bool":
                    bad("aggregation_invalid_where", "where must be a condition on known fields")
            except ExprError as e:
                bad("aggregation_invalid_where", str(e))
    return errors


def diff(old: Catalogue, new: Catalogue) -> dict[str, list[dict]]:
    """What changes from one whole catalogue to the next. A destructive change needs force."""
    destructive: list[dict] = []
    additive: list[dict] = []
    gone = {n: d for n, d in old.all().items() if n not in new.all()}
    fresh = {n: d for n, d in new.all().items() if n not in old.all()}
    for n, d in gone.items():
        twin = next((m for m, e in fresh.items() if type(e) is type(d)), None)
        if twin is not None:
            destructive.append({"kind": "rename", "from": n, "to": twin})
            del fresh[twin]
        else:
            destructive.append({"kind": "rename", "from": n, "to": ""})
    for n, d in fresh.items():
        additive.append({"kind": "new_descriptor", "descriptor_kind": KINDS[type(d)], "name": n})
    for n, d in new.all().items():
        was = old.all().get(n)
        if was is None or was == d:
            continue
        if type(was) is not type(d):
            destructive.append({"kind": "type_change", "field": n, "from": KINDS[type(was)], "to": KINDS[type(d)]})
            continue
        if isinstance(d, EventSource):
            for f, kind in was.schema.items():
                if f not in d.schema:
                    destructive.append({"kind": "type_change", "field": f"{n}.{f}", "from": kind, "to": ""})
                elif d.schema[f] != kind:
                    destructive.append({"kind": "type_change", "field": f"{n}.{f}", "from": kind, "to": d.schema[f]})
            additive += [{"kind": "new_field", "event": n, "field": f, "type": k} for f, k in d.schema.items() if f not in was.schema]
            continue
        now_steps, old_steps = [_step(s) for s in d.steps], [_step(s) for s in was.steps]
        destructive += [{"kind": "op_removal", "table": n, "agg": s} for s in old_steps if s not in now_steps]
        if isinstance(d, Table):
            if d.keys != was.keys:
                destructive.append({"kind": "key_cols_change", "table": n, "from": list(was.keys), "to": list(d.keys)})
            for f, x in was.features.items():
                y = d.features.get(f)
                if y is None or y.op != x.op:
                    destructive.append({"kind": "agg_removal", "table": n, "agg": f})
                elif y.window != x.window:
                    destructive.append({"kind": "window_change", "agg": f"{n}.{f}", "from": x.window or "forever", "to": y.window or "forever"})
            additive += [{"kind": "new_agg", "table": n, "agg": f, "source": d.root.name} for f in d.features if f not in was.features]
    return {"destructive": destructive, "additive": additive}


def _step(step) -> str:
    op, payload = step
    if isinstance(payload, dict):
        return f"{op}({', '.join(f'{k}={v}' for k, v in sorted(payload.items()))})"
    return f"{op}({payload})"


#: payloads with these are refused before anything else: (key, value) -> code
REMOVED = {"join": "feature_removed_no_joins_v0", "union": "feature_removed_no_unions_v0"}
REMOVED_KEYS = {"event_time_field": "unknown_field_event_time_v0", "tolerate_delay_ms": "unknown_field_tolerate_delay_v0"}


def precheck(payload: dict) -> None:
    """Codes of features that a JSON payload must not use."""
    for i, node in enumerate(payload.get("nodes", [])):
        path = f"nodes[{i}]"
        for key, code in REMOVED_KEYS.items():
            if key in node:
                raise RegistrationError(code, f"{key} is not supported", path)
        if node.get("kind") not in ("event", "derivation"):
            raise RegistrationError("unsupported_node_kind", f"kind {node.get('kind')!r}", path)
        for step in node.get("ops", []):
            if step.get("op") in REMOVED:
                raise RegistrationError(REMOVED[step["op"]], f"{step['op']} is not supported", path)


def fingerprint(d: Any) -> str:
    """A declaration as text; equal declarations have equal texts."""
    if isinstance(d, EventSource):
        own: tuple = (sorted(d.schema.items()), sorted(d.optional), d.keep_events_for, d.cold_after, d.dedupe_key, d.dedupe_window)
    else:
        own = (fingerprint(d.root), [_step(s) for s in d.steps])
        if isinstance(d, Table):
            own += (d.keys, sorted((n, sorted((k, str(v)) for k, v in f.describe().items())) for n, f in d.features.items()))
    return f"{KINDS[type(d)]} {d.name} {own}"


def state_of(cat: Catalogue) -> dict:
    """What a folder keeps of a catalogue, for the next application on it."""
    return {"version": cat.version, "since": cat.since, "declared": {n: fingerprint(d) for n, d in cat.all().items()}}


def resumed(new: Catalogue, kept: dict) -> Catalogue:
    """A catalogue as it follows on what a folder keeps: what has not changed keeps its version."""
    out, was = new.copy(), kept["declared"]
    now = {n: fingerprint(d) for n, d in out.all().items()}
    out.version = kept["version"] + (now != was)
    out.since = {n: kept["since"][n] if was.get(n) == now[n] else out.version for n in now}
    return out


def install(cat: Catalogue, new: Catalogue, spark: SparkSession, force: bool = False, dry_run: bool = False) -> tuple[Catalogue, dict]:
    """The next catalogue and a report. A new declaration sees events from its version on."""
    schemas = check(new, spark)
    changes = diff(cat, new)
    if dry_run:
        return cat, {"status": "dry_run", "diff": changes, "version": cat.version}
    if changes["destructive"] and not force:
        raise RegistrationError("force_required", "destructive changes need force=True", errors=changes["destructive"])
    if not changes["destructive"] and not changes["additive"] and cat.all() == new.all():
        return cat, {"status": "unchanged", "diff": changes, "version": cat.version}
    out = new.copy()
    out.version = cat.version + 1
    dropped = {x["from"] for x in changes["destructive"] if x["kind"] == "rename"}
    changed = {root_of(d).name if isinstance(d, Derivation) else n for n, d in new.all().items() if n in cat.all() and cat.all()[n] != d}
    out.since = {n: cat.since[n] if n in cat.since and n not in changed and n not in dropped else out.version for n in new.all()}
    return out, {"status": "ok", "diff": changes, "version": out.version, "schemas": schemas}
