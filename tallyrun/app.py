"""Register, push and read: the engine as an application sees it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .errors import RegistrationError, ValidationError
from .functions.types import schema_of
from .model import EventSource, Table
from .plans.planner import Stream, table_rows
from .sources.log import LSN, NOW_MS, VERSION, EventLog
from .streaming.tables import plain

MAX_CELLS = 10_000


class App:
    """Feature tables over pushed events and over DataFrames bound to sources.

    Pushed events get the clock's time on arrival. A read is a query over the events of the asked keys only;
    all features of a table come from one plan. With `folder`, push_sync() and flush() make pushed events durable, as does
    a buffer that is full, and a new App on the same folder goes on with them and with the catalogue's versions.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, test_mode: bool = False, clock: Callable[[], int] | None = None):
        self.spark, self.folder, self.test_mode = spark, folder, test_mode
        self.clock = clock or (lambda: int(time.time() * 1000))
        self._start()

    def _start(self) -> None:
        self.catalogue = registry.Catalogue()
        self.logs: dict[str, EventLog] = {}
        self.bound: dict[str, Stream] = {}
        self.lsn, self.watermark, self.pushed = 0, 0, 0

    # catalogue

    def register(self, *declarations: Any, force: bool = False, dry_run: bool = False) -> dict:
        """Install the whole catalogue: what is not named any more goes, which needs force."""
        kept = self._kept() if not self.catalogue.version else None
        new = registry.collect(declarations)
        if kept is not None and not dry_run:
            gone = [{"kind": "rename", "from": n, "to": ""} for n in kept["declared"] if n not in new.all()]
            if gone and not force:
                raise RegistrationError("force_required", "the folder's catalogue has more; that needs force=True", errors=gone)
        self.catalogue, report = registry.install(self.catalogue, new, self.spark, force, dry_run)
        if not dry_run:
            if kept is not None:
                self.catalogue = registry.resumed(self.catalogue, kept)
                report["version"] = self.catalogue.version
            if self.folder and report["status"] != "unchanged":
                EventLog.write_text(self.spark, f"{self.folder}/catalogue.json", json.dumps(registry.state_of(self.catalogue)))
            for name, source in self.catalogue.events.items():
                if name not in self.logs or self.logs[name].source.schema != source.schema:
                    self.logs[name] = EventLog(self.spark, source, self.folder)
                    if self.folder and self.logs[name]._exists():
                        r = self.logs[name].rows().agg(F.max(LSN).alias("l"), F.max(NOW_MS).alias("t")).first()
                        self.lsn, self.watermark = max(self.lsn, r.l or 0), max(self.watermark, r.t or 0)
            for name in [n for n in self.logs if n not in self.catalogue.events]:
                self.logs.pop(name)
                self.bound.pop(name, None)
        return report

    def _kept(self) -> dict | None:
        """The catalogue's versions as an earlier App on the folder left them."""
        text = EventLog.read_text(self.spark, f"{self.folder}/catalogue.json") if self.folder else None
        return json.loads(text) if text else None

    def bind(self, event: str, df: DataFrame, time: str, ties: Sequence[str] = ()) -> None:
        """Let a source's events come from a DataFrame; `time` takes the place of the arrival time."""
        source = self._event(event)
        have = schema_of(df.schema)
        for f, kind in source.schema.items():
            if f not in have and f not in source.optional:
                raise ValidationError("invalid_event", f"no column {f!r}", event)
            if f in have and have[f] != kind and not {have[f], kind} <= {"i64", "f64"}:
                raise ValidationError("invalid_event", f"column {f!r} is {have[f]}, not {kind}", event)
        self.bound[event] = Stream(df, time, tuple(ties))

    def describe(self) -> dict:
        c = self.catalogue
        return {"version": c.version, "events": {n: e.schema for n, e in c.events.items()}, "derivations": sorted(c.derivations), "tables": {n: {"key": list(t.keys), "features": {k: f.describe() for k, f in t.features.items()}} for n, t in c.tables.items()}}

    # events

    def push(self, event: str, fields: dict[str, Any]) -> dict:
        source = self._event(event)
        self._check(source, fields)
        now = max(self.clock(), self.watermark)
        self.lsn += 1
        self.pushed += 1
        self.logs[event].append(fields, self.lsn, now, self.catalogue.version)
        self.watermark = now
        return {"ok": True, "lsn": self.lsn, "registry_version": self.catalogue.version}

    def push_sync(self, event: str, fields: dict[str, Any]) -> dict:
        """push(), acknowledged only once the event is in the folder (in memory if there is none)."""
        ack = self.push(event, fields)
        self.logs[event].flush()
        return ack

    def push_batch(self, event: str, rows: Iterable[dict[str, Any]], sync: bool = False) -> dict:
        """All rows; with `sync` they are in the folder when this returns."""
        ack = {"ok": True, "lsn": self.lsn}
        for r in rows:
            ack = self.push(event, r)
        if sync and event in self.logs:
            self.logs[event].flush()
        return ack

    replay = push_batch

    def flush(self) -> int:
        return sum(log.flush() for log in self.logs.values())

    def _event(self, name: str) -> EventSource:
        if name not in self.catalogue.events:
            raise ValidationError("event_not_found", f"no event {name!r}", name)
        return self.catalogue.events[name]

    @staticmethod
    def _check(source: EventSource, fields: dict[str, Any]) -> None:
        if not isinstance(fields, dict):
            raise ValidationError("invalid_json_body", "an event is an object", source.name)
        for k, v in fields.items():
            if k not in source.schema:
                code = "unknown_field_event_time_v0" if k in ("event_time", "event_time_ms") else "unknown_field_v0"
                raise ValidationError(code, f"no field {k!r}", source.name)
            if isinstance(v, str) and any(ord(c) < 32 or ord(c) == 127 for c in v):
                raise ValidationError("control_character_in_string", f"field {k!r}", source.name)
        for k, kind in source.schema.items():
            if k in source.optional:
                continue
            v = fields.get(k)
            ok = {
                "str": isinstance(v, str),
                "bool": isinstance(v, bool),
                "bytes": isinstance(v, bytes),
                "i64": isinstance(v, (int, float)) and not isinstance(v, bool),
                "f64": isinstance(v, (int, float)) and not isinstance(v, bool),
            }.get(kind, v is not None)
            if not ok:
                raise ValidationError("invalid_event", f"field {k!r} must be {kind}", source.name)

    # reads

    def _stream(self, t: Table) -> Stream:
        if t.root.name in self.bound:
            return self.bound[t.root.name]
        rows = self.logs[t.root.name].rows().filter(F.col(VERSION) >= self.catalogue.since.get(t.name, 0))
        return Stream(rows.drop(VERSION), NOW_MS, (LSN,))

    def table(self, name: str, query_time: int | None = None, only=None, parts: int | None = None) -> DataFrame:
        """All rows of a table as a DataFrame. `parts` spreads hot entities over parts of time (see feature_table)."""
        t = self._table(name)
        return table_rows(t, self._stream(t), query_time=query_time, schema=dict(t.root.schema), only=only, parts=parts)

    def _table(self, name: str) -> Table:
        if name not in self.catalogue.tables:
            raise ValidationError("unknown_table", f"no table {name!r}", name)
        return self.catalogue.tables[name]

    def _key(self, t: Table, key: Any) -> tuple[str, ...]:
        """A key as texts: a scalar, parts joined by |, a sequence, or a dict of key columns."""
        if not t.keys:
            if key not in (None, ""):
                raise ValidationError("key_parse_failure", f"{t.name} has no key", t.name)
            return ()
        if isinstance(key, dict):
            parts = [key.get(k) for k in t.keys]
        elif isinstance(key, (list, tuple)):
            parts = list(key)
        else:
            parts = str(key).split("|") if len(t.keys) > 1 and isinstance(key, str) else [key]
        if len(parts) != len(t.keys) or any(p is None for p in parts):
            raise ValidationError("key_parse_failure", f"{t.name} is keyed by {list(t.keys)}; got {key!r}", t.name)
        return tuple(str(p).lower() if isinstance(p, bool) else str(p) for p in parts)

    def _features(self, t: Table, features: Sequence[str] | None) -> list[str]:
        for f in features or ():
            if f not in t.features:
                raise ValidationError("feature_not_found", f"{t.name} has no feature {f!r}", t.name)
        return list(features) if features is not None else list(t.features)

    def _rows(self, t: Table, keys: list[tuple], query_time: int | None) -> dict[tuple, dict]:
        """Rows of the asked keys. The condition on keys narrows the events before they are shuffled."""
        only = None
        if t.keys:
            columns = [F.col(f"`{k}`").cast("string") for k in t.keys]
            wanted = sorted(set(keys))
            only = columns[0].isin([k[0] for k in wanted]) if len(t.keys) == 1 else F.struct(*columns).isin([F.struct(*[F.lit(p) for p in k]) for k in wanted])
        found = {}
        for r in self.table(t.name, query_time, only).collect():
            row = r.asDict(recursive=True)
            key = tuple(str(row[k]).lower() if isinstance(row[k], bool) else str(row[k]) for k in t.keys)
            found[key] = {k: plain(v) for k, v in row.items() if k not in t.keys}
        return found

    def get(self, table: str, key: Any = None, features: Sequence[str] | None = None) -> dict:
        """A key's features as of now (never before the last event); {} if no event had the key."""
        t = self._table(table)
        names, k = self._features(t, features), self._key(t, key)
        now = None if t.root.name in self.bound else max(self.watermark, self.clock())
        row = self._rows(t, [k], now).get(k)
        return {n: row[n] for n in names} if row is not None else {}

    def get_single(self, name: str, key: Any = None) -> dict:
        """One feature's value by its own name, as feature names are unique, or, by a table's name, all of a key's features.

        A key without an event, which get() answers with {}, is an error here.
        """
        owner = next((t for t in self.catalogue.tables.values() if name in t.features), None)
        if owner is None and name not in self.catalogue.tables:
            raise ValidationError("feature_not_found", f"no feature or table {name!r}", name)
        row = self.get(owner.name if owner else name, key, [name] if owner else None)
        if not row:
            raise ValidationError("key_not_found", f"no event had the key {key!r}", name)
        return {"value": row[name]} if owner else row

    def mget(self, table: str, keys: Sequence[Any], features: Sequence[str] | None = None) -> dict[str, dict]:
        """Rows of several keys; keys without an event are left out."""
        t = self._table(table)
        names = self._features(t, features)
        if len(keys) * len(names) > MAX_CELLS:
            raise ValidationError("batch_too_large", f"{len(keys)} keys x {len(names)} features; {MAX_CELLS} cells at most", table)
        parsed = [self._key(t, k) for k in keys]
        now = None if t.root.name in self.bound else max(self.watermark, self.clock())
        rows = self._rows(t, parsed, now)
        return {"|".join(k): {n: rows[k][n] for n in names} for k in parsed if k in rows}

    def batch_get(self, requests: Sequence[tuple]) -> list[dict]:
        """Rows for (table, key) or (table, key, features), in order, as of the last event; one query for each table.

        An unknown table or a key that does not fit gives that request an `error`; an unknown feature, and more than
        MAX_CELLS cells in all, refuse the whole batch.
        """
        asked: list[tuple | dict] = []
        cells = 0
        for r in requests:
            if not isinstance(r, (tuple, list)) or len(r) not in (2, 3):
                raise TypeError("batch_get takes (table, key) or (table, key, features)")
            try:
                t = self._table(r[0])
            except ValidationError as e:
                asked.append({"error": {"code": e.code, "message": e.message}})
                continue
            names = self._features(t, r[2] if len(r) == 3 else None)
            cells += len(names)
            try:
                asked.append((t, self._key(t, r[1]), names))
            except ValidationError as e:
                asked.append({"error": {"code": e.code, "message": e.message}})
        if cells > MAX_CELLS:
            raise ValidationError("batch_too_large", f"{cells} cells; {MAX_CELLS} at most")
        wanted: dict[str, list[tuple]] = {}
        for a in asked:
            if not isinstance(a, dict):
                wanted.setdefault(a[0].name, []).append(a[1])
        rows = {}
        for name, keys in wanted.items():
            t = self.catalogue.tables[name]
            rows[name] = self._rows(t, keys, None if t.root.name in self.bound else self.watermark)
        return [a if isinstance(a, dict) else {n: rows[a[0].name].get(a[1], {})[n] for n in a[2]} if a[1] in rows[a[0].name] else {} for a in asked]

    # administration

    def health(self) -> dict:
        """Alive: the session answers."""
        return {"ok": not self.spark.sparkContext._jsc.sc().isStopped()}

    def ready(self) -> dict:
        """Ready to take events: a catalogue is installed and, with a folder, the folder can be reached."""
        ok = self.catalogue.version > 0
        if ok and self.folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            ok = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return {"ok": ok, "registry_version": self.catalogue.version}

    def ping(self) -> dict:
        return {"ok": True, "registry_version": self.catalogue.version}

    def metrics(self) -> dict:
        """Counters, with the progress of the session's streaming queries."""
        streams = {}
        for q in self.spark.streams.active:
            p = q.lastProgress or {}
            streams[q.name or q.id] = {"batch": p.get("batchId"), "rows_per_second": p.get("processedRowsPerSecond"), "state_rows": sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))}
        held = sum(len(log.held) for log in self.logs.values())
        return {"events_pushed": self.pushed, "events_held": held, "lsn": self.lsn, "watermark_ms": self.watermark, "tables": len(self.catalogue.tables), "features": sum(len(t.features) for t in self.catalogue.tables.values()), "streams": streams}

    def reset(self) -> None:
        if not self.test_mode:
            raise ValidationError("reset_not_allowed", "reset needs test_mode=True")
        for log in self.logs.values():
            log.clear()
        self._start()

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> App:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()
