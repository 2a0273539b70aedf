from dataclasses import replace

import pytest

from tallyrun.app import App
from tallyrun.errors import RegistrationError, ValidationError
from tallyrun.functions import col
from tallyrun.model import Table, event, table
from tallyrun.operators import features as f
from tallyrun.registry import precheck
from tallyrun.sources.demos import DEMOS, demo


@event
class Click:
    user_id: str
    page: str


@event(dedupe_key="id", dedupe_window="1h")
class Pay:
    user_id: int
    id: str
    amount: float
    note: str | None


@event
def Home(clicks: Click):
    return clicks.filter(col("page") == "/")


@table(key="user_id")
def Clicks(clicks: Click):
    return clicks.group_by("user_id").agg(c=f.count(), pages=f.n_unique("page"), last=f.last("page"))


@table
def Totals(clicks: Click):
    return clicks.agg(total=f.count())


@table(key=["user_id", "page"])
def ByPage(clicks: Click):
    return clicks.group_by("user_id", "page").agg(hits=f.count(), seen=f.last_seen())


@table(key="user_id")
def Paid(pays: Pay):
    return pays.group_by("user_id").agg(paid=f.sum("amount"), week=f.count(window="7d"))


class Clock:
    now = 1_700_000_000_000

    def __call__(self):
        self.now += 1000
        return self.now


@pytest.fixture
def app(spark):
    a = App(spark, test_mode=True, clock=Clock())
    a.register(Click, Pay, Clicks, Totals, ByPage, Paid)
    return a


def test_push_and_read(app):
    for user, page in (("alice", "/"), ("bob", "/x"), ("alice", "/y")):
        assert app.push("Click", {"user_id": user, "page": page})["ok"]
    assert app.get("Clicks", "alice") == {"c": 2, "pages": 2, "last": "/y"}
    assert app.get("Clicks", "carol") == {}
    assert app.get("Clicks", "bob", ["c"]) == {"c": 1}
    assert app.get("Totals") == {"total": 3}
    assert app.get("ByPage", "alice|/y")["hits"] == app.get("ByPage", ("alice", "/y"))["hits"] == 1
    assert app.mget("Clicks", ["alice", "zed", "bob"], ["c"]) == {"alice": {"c": 2}, "bob": {"c": 1}}
    assert app.batch_get([("Clicks", "bob", ["c"]), ("Totals", None), ("Clicks", "zed")]) == [{"c": 1}, {"total": 3}, {}]
    assert app.ping()["ok"] and app.metrics()["events_pushed"] == 3
    assert app.health() == {"ok": True} and app.ready()["ok"] and app.metrics()["events_held"] == 3
    assert app.table("Clicks", parts=3).count() == 2


def test_batch_get_answers_each_request(app):
    """A bad table or key is that request's error; a bad feature or too many cells refuse all."""
    app.push("Click", {"user_id": "alice", "page": "/"})
    got = app.batch_get([("Nope", "x"), ("Clicks", "alice", ["c"]), ("ByPage", "alice"), ("Totals", "x"), ("Totals", None)])
    assert [g.get("error", {}).get("code") for g in got] == ["unknown_table", None, "key_parse_failure", "key_parse_failure", None]
    assert got[1] == {"c": 1} and got[4] == {"total": 1}
    with pytest.raises(ValidationError) as e:
        app.batch_get([("Clicks", "alice", ["c"]), ("Clicks", "alice", ["nope"])])
    assert e.value.code == "feature_not_found"
    with pytest.raises(ValidationError) as e:
        app.batch_get([("Clicks", f"u{i}") for i in range(3400)])
    assert e.value.code == "batch_too_large"
    assert app.batch_get([]) == []


def test_get_single(app):
    app.push("Click", {"user_id": "alice", "page": "/"})
    assert app.get_single("c", "alice") == {"value": 1} and app.get_single("total") == {"value": 1}
    assert app.get_single("Clicks", "alice") == app.get("Clicks", "alice")
    for name, key, code in (("nope", "alice", "feature_not_found"), ("c", "zed", "key_not_found"), ("hits", "alice", "key_parse_failure")):
        with pytest.raises(ValidationError) as e:
            app.get_single(name, key)
        assert e.value.code == code


def test_acknowledged_events_and_versions_survive(spark, tmp_path):
    """push_sync() is in the folder when it returns; a new App keeps versions, so a table sees the events it saw before."""
    folder, clock = str(tmp_path / "log"), Clock()
    a = App(spark, folder, clock=clock)
    a.register(Click, Totals)
    a.push_sync("Click", {"user_id": "ann", "page": "/"})
    a.register(Click, Totals, Clicks)  # version 2: sees events from here on
    a.push_batch("Click", [{"user_id": "ann", "page": "/"}, {"user_id": "bob", "page": "/"}], sync=True)
    a.push("Click", {"user_id": "lost", "page": "/"})  # not acknowledged as durable
    was = (a.get("Totals")["total"] - 1, a.get("Clicks", "ann"))
    b = App(spark, folder, clock=clock)
    report = b.register(Click, Totals, Clicks)
    assert report["version"] == 2 and b.catalogue.since == a.catalogue.since
    assert (b.get("Totals")["total"], b.get("Clicks", "ann")) == was == (3, {"c": 1, "pages": 1, "last": "/"})
    assert b.push_sync("Click", {"user_id": "ann", "page": "/x"})["registry_version"] == 2 and b.get("Clicks", "ann")["c"] == 2
    c = App(spark, folder, clock=clock)
    with pytest.raises(RegistrationError) as e:
        c.register(Click, Totals)
    assert e.value.code == "force_required"
    assert c.register(Click, Totals, Clicks, ByPage)["version"] == 3 and c.catalogue.since["ByPage"] == 3 and c.catalogue.since["Clicks"] == 2
    assert c.get("ByPage", "ann|/") == {} and c.get("Clicks", "ann")["c"] == 2


def test_a_full_buffer_goes_to_the_folder(spark, tmp_path):
    from tallyrun.sources.log import EventLog

    log = EventLog(spark, Click, str(tmp_path), most_held=10)
    for i in range(25):
        log.append({"user_id": "u", "page": "/"}, i, i, 1)
    assert len(log.held) == 5 and log.rows().count() == 25


def test_numeric_keys_and_dedupe(app):
    for i, amount in (("p1", 5.0), ("p1", 5.0), ("p2", 2.5)):
        app.push("Pay", {"user_id": 7, "id": i, "amount": amount})
    assert app.get("Paid", 7) == {"paid": 7.5, "week": 2}


@pytest.mark.parametrize(
    "name, fields, code",
    [
        ("Nope", {}, "event_not_found"),
        ("Click", {"user_id": "a"}, "invalid_event"),
        ("Click", {"user_id": None, "page": "/"}, "invalid_event"),
        ("Click", {"user_id": 1, "page": "/"}, "invalid_event"),
        ("Click", {"user_id": "a", "page": "/", "more": 1}, "unknown_field_v0"),
        ("Click", {"user_id": "a", "page": "/", "event_time": 1}, "unknown_field_event_time_v0"),
        ("Click", {"user_id": "a\x01", "page": "/"}, "control_character_in_string"),
        ("Click", [1], "invalid_json_body"),
    ],
)
def test_bad_events(app, name, fields, code):
    with pytest.raises(ValidationError) as e:
        app.push(name, fields)
    assert e.value.code == code


def test_bad_reads(app):
    for call, code in ((lambda: app.get("Nope", "a"), "unknown_table"), (lambda: app.get("Clicks", "a", ["nope"]), "feature_not_found"), (lambda: app.get("ByPage", "a"), "key_parse_failure"), (lambda: app.mget("Clicks", list(range(4000))), "batch_too_large")):
        with pytest.raises(ValidationError) as e:
            call()
        assert e.value.code == code
    with pytest.raises(TypeError):
        app.batch_get([{"table": "Clicks"}])


def test_evolution(app, spark):
    more = replace(Clicks, features={**Clicks.features, "pages2": f.top_k("page", k=1)})
    rest = (Click, Pay, Totals, ByPage, Paid)
    report = app.register(*rest, more, dry_run=True)
    assert report["status"] == "dry_run" and report["diff"]["additive"] == [{"kind": "new_agg", "table": "Clicks", "agg": "pages2", "source": "Click"}]
    assert app.register(*rest, more)["version"] == 2
    assert app.register(*rest, more)["status"] == "unchanged"
    with pytest.raises(RegistrationError) as e:
        app.register(*rest, Clicks)
    assert e.value.code == "force_required" and e.value.errors[0]["kind"] == "agg_removal"
    windowed = replace(Totals, features={"total": f.count(window="1h")})
    with pytest.raises(RegistrationError) as e:
        app.register(Click, Pay, more, windowed, ByPage, Paid)
    assert e.value.errors[0]["kind"] == "window_change"
    assert app.register(Click, Clicks, force=True)["status"] == "ok"
    assert "Paid" not in app.describe()["tables"]


def made(name="T", key=("user_id",), steps=(), **features):
    return Table(name, key, Click, steps, features)


@pytest.mark.parametrize(
    "t, code",
    [
        (made(c=f.sum("nope")), "aggregation_unknown_field"),
        (made(key=("nope",), c=f.count()), "aggregation_unknown_field"),
        (made(user_id=f.count()), "aggregation_group_key_collides_with_feature"),
        (made(c=f.count(where=col("nope") == 1)), "aggregation_invalid_where"),
        (made(c=f.count(where=col("page"))), "aggregation_invalid_where"),
        (made(c=f.Feature("nope")), "aggregation_unknown_op"),
        (made(c=f.Feature("first", "page", window="1h")), "aggregation_invalid_window"),
        (made(c=f.bloom_member("page", window="1h")), "window_not_supported"),
        (made(c=f.Feature("quantile", "page", params={"q": 2})), "invalid_percentile_q"),
        (made(c=f.top_k("page", k=5000)), "invalid_top_k_k"),
        (made(c=f.Feature("last_n", "page")), "unbounded_op_in_lifetime_mode"),
        (made(name="1bad", c=f.count()), "invalid_registration"),
        (made(steps=Click.select("nope").steps, c=f.count()), "invalid_expression"),
    ],
)
def test_bad_tables(spark, t, code):
    with pytest.raises(RegistrationError) as e:
        App(spark).register(t)
    assert e.value.code == code


def test_names_are_checked_together(spark):
    with pytest.raises(RegistrationError) as e:
        App(spark).register(made("A", c=f.count()), made("B", c=f.count()))
    assert e.value.code == "aggregation_feature_name_collision_across_aggregations"
    with pytest.raises(RegistrationError):
        App(spark).register(made("A", c=f.count()), made("A", d=f.count()))
    with pytest.raises(TypeError):
        App(spark).register(Click.filter(col("page") == "/"))
    assert App(spark).register(Home)["status"] == "ok"


@pytest.mark.parametrize("node, code", [({"kind": "event", "event_time_field": "t"}, "unknown_field_event_time_v0"), ({"kind": "event", "tolerate_delay_ms": 1}, "unknown_field_tolerate_delay_v0"), ({"kind": "table"}, "unsupported_node_kind"), ({"kind": "derivation", "ops": [{"op": "join"}]}, "feature_removed_no_joins_v0"), ({"kind": "derivation", "ops": [{"op": "union"}]}, "feature_removed_no_unions_v0")])
def test_removed_features(node, code):
    with pytest.raises(RegistrationError) as e:
        precheck({"nodes": [node]})
    assert e.value.code == code


def test_declarations_are_checked():
    with pytest.raises(TypeError):
        event(event_time_field="t")
    with pytest.raises(TypeError):

        @event
        class Bad:
            event_time: int

    with pytest.raises(TypeError):

        @table(key="a")
        def no_annotation(x):
            return x

    with pytest.raises(RegistrationError):

        @table(key="page")
        def wrong_key(c: Click):
            return c.group_by("user_id").agg(z=f.count())


def test_log_survives_restart(spark, tmp_path):
    folder = str(tmp_path / "log")
    with App(spark, folder=folder, clock=Clock()) as a:
        a.register(Clicks)
        a.push_batch("Click", [{"user_id": "a", "page": "/"}, {"user_id": "a", "page": "/b"}])
    b = App(spark, folder=folder, clock=Clock())
    b.register(Clicks)
    assert b.lsn == 2
    b.push("Click", {"user_id": "a", "page": "/c"})
    assert b.get("Clicks", "a") == {"c": 3, "pages": 3, "last": "/c"}


def test_bound_frames_and_reset(spark):
    a = App(spark, test_mode=True)
    a.register(Clicks)
    a.bind("Click", spark.createDataFrame([(1, "u", "/"), (2, "u", "/z")], "ts long, user_id string, page string"), "ts")
    assert a.get("Clicks", "u")["c"] == 2
    a.reset()
    assert a.describe()["tables"] == {}
    with pytest.raises(ValidationError):
        App(spark).reset()


@pytest.mark.parametrize("name", list(DEMOS))
def test_demos(spark, name):
    for e, (source, df) in demo(spark, name).items():
        assert df.count() == DEMOS[name][e][0] and set(source.schema) <= set(df.columns)
    with pytest.raises(ValueError):
        demo(spark, "nope")
