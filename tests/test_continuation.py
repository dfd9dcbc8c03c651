import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from foldtrace.operators.constraints import Rules
from foldtrace.operators.record_view import finish_many
from foldtrace.plans import apps
from foldtrace.plans.programs import program_app
from foldtrace.plans.serve import Snapshot, declared, encoded, logical_type
from foldtrace.sources.tables import events_as_records, read_table
from foldtrace.streaming import lifecycle
from foldtrace.streaming.runner import Runner

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    frame = events_as_records(read_table(spark, SMALL, "events")).where("position <= 200").cache()
    yield frame
    frame.unpersist()


def rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


def keyed(rules, columns="struct(source AS label, position AS last)", fields=("label", "last")):
    normalize = lambda frame: finish_many(frame, F.array(F.expr(columns)))
    fold = lambda events: events.select(*fields, F.lit("upsert").alias("op"), "position", "ordinal")
    return program_app("labels", normalize, {"labels": rules}, [{"labels": fold}])


def test_installed_apps_answer_before_their_first_record(spark, records, tmp_path):
    chosen = [apps.session_cost(), apps.agent_guard(chunk=64)]
    runner = Runner(spark, str(tmp_path / "store"), chosen)
    for app in chosen:
        runner.install(app)
    snapshot = Snapshot(spark, str(tmp_path / "store"), chosen)
    empty = snapshot.query("agent-guard", "SELECT p.session_id, c.cost_microusd FROM {session_progress} p JOIN {c_session_cost} c ON c.session_id = p.session_id", mounts={"c": "session-cost"})
    assert empty.rows == [] and not empty.truncated and empty.complete and empty.position == 0
    assert empty.columns == [{"name": "session_id", "type": "TEXT"}, {"name": "cost_microusd", "type": "INTEGER"}]
    assert snapshot.query("agent-guard", "SELECT evidence FROM {policy_findings}").columns == [{"name": "evidence", "type": "JSON"}]
    for batch, part in enumerate(["position <= 90", "position > 90"]):
        runner.process_records(records.where(part), batch)
    state = runner.store.read()
    for app in chosen:
        assert state["apps"][app.name]["frontier"]["complete"], state["apps"][app.name]["frontier"]
        whole = app.tables(records)
        for name in app.keys:
            assert rows(runner.store.table(state, app.name, name)) == rows(whole[name]), name


def test_continuing_keeps_tables_and_refuses_other_shapes(spark, records, tmp_path):
    first = keyed(Rules(("label",)))
    runner = Runner(spark, str(tmp_path / "store"), [first])
    runner.install(first)
    runner.process_records(records.where("position <= 50"), 0)
    before = runner.store.read()
    kept = rows(runner.store.table(before, "labels", "labels"))
    assert kept

    changed = {
        "another shape": keyed(Rules(("label",)), "struct(source AS label, CAST(position AS DOUBLE) AS last)"),
        "other keys": keyed(Rules(("label", "last"))),
        "other rules": keyed(Rules(("label",), checks={"last > 0": "last > 0"})),
        "was removed": replace(first, keys={}, apply=lambda normalized, prior: {}),
        "other append_only": replace(first, append_only=frozenset({"labels"})),
    }
    for reason, app in changed.items():
        with pytest.raises(ValueError, match=reason):
            runner.install(app, continue_tables=True)
    with pytest.raises(Exception, match="nowhere"):
        runner.install(keyed(Rules(("label",)), fields=("nowhere", "last")), continue_tables=True)
    assert runner.store.read() == before

    more = replace(
        first,
        keys={**first.keys, "signals": ("signal",)},
        rules={**first.rules, "signals": "by signal"},
        revision="2",
        apply=lambda normalized, prior: {**first.apply(normalized, prior), "signals": lambda: normalized.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))},
    )
    runner.install(more, continue_tables=True)
    state = runner.store.read()
    assert rows(runner.store.table(state, "labels", "labels")) == kept and runner.store.table(state, "labels", "signals").count() == 0
    assert state["apps"]["labels"]["revision"] == "2" and state["apps"]["labels"]["frontier"]["position"] == 50
    runner.apps[:] = [more]
    runner.process_records(records.where("position BETWEEN 51 AND 120"), 1)
    state = runner.store.read()
    assert rows(runner.store.table(state, "labels", "labels")) == rows(first.tables(records.where("position <= 120"))["labels"])
    assert state["apps"]["labels"]["frontier"]["position"] == 120
    runner.install(first)  # without continuing: from the head, with nothing
    state = runner.store.read()
    assert runner.store.table(state, "labels", "labels").count() == 0 and state["apps"]["labels"]["frontier"]["boundary"] == 120


def test_declarations_must_fit(spark, records):
    app = apps.session_cost()
    app.validate(records)
    for wrong in ({"exports": ("nothing",)}, {"logical": {"session_cost": {"nothing": "JSON"}}}, {"keys": {"other": ("a",)}}, {"keys": {**app.keys, "session_cost": ("nothing",)}}):
        with pytest.raises(ValueError):
            replace(app, **wrong).validate(records)


def test_types_follow_the_contract_and_not_the_name(spark):
    table = declared(
        spark.sql("SELECT 'plain {' AS evidence, '{\"a\": [1.50, null]}' AS detail, 9007199254740993L AS big, true AS yes, X'00ff' AS raw, 0.5D AS part, CAST(NULL AS STRING) AS gone"),
        {"detail": "JSON"},
    )
    other = declared(spark.sql("SELECT 'plain {' AS evidence, 7 AS n"))
    found = spark.sql(
        "SELECT t.detail AS why, t.evidence, t.big, t.big + 1 AS more, t.yes, t.raw, t.part, t.part > 1 AS much, upper(t.evidence) AS loud, t.gone, o.n, max(t.detail) OVER () AS top "
        "FROM {t} t LEFT JOIN {o} o ON o.evidence = t.evidence", t=table, o=other,
    )
    types = {item.name: logical_type(item) for item in found.schema}
    assert types == {
        "why": "JSON", "evidence": "TEXT", "big": "INTEGER", "more": "DYNAMIC", "yes": "BOOLEAN", "raw": "BLOB", "part": "REAL",
        "much": "DYNAMIC", "loud": "DYNAMIC", "gone": "TEXT", "n": "INTEGER", "top": "DYNAMIC",
    }
    row = encoded(found).first().asDict()
    assert {name: None if text is None else json.loads(text) for name, text in row.items()} == {
        "why": {"a": [1.5, None]}, "evidence": "plain {", "big": {"integer_decimal": "9007199254740993"}, "more": {"integer_decimal": "9007199254740994"},
        "yes": True, "raw": {"bytes_base64": "AP8="}, "part": 0.5, "much": False, "loud": "PLAIN {", "gone": None, "n": 7, "top": '{"a": [1.50, null]}',
    }
    merged = table.select("detail").union(declared(spark.sql("SELECT '[]' AS detail"), {"detail": "JSON"})).groupBy("detail").count()
    assert [logical_type(item) for item in merged.schema] == ["JSON", "DYNAMIC"]
    for broken in ("SELECT CAST('NaN' AS DOUBLE) AS x", "SELECT -1.0D / CAST('0' AS DOUBLE) AS x"):
        with pytest.raises(Exception, match="x: non-finite|DIVIDE_BY_ZERO"):
            encoded(spark.sql(broken)).collect()
    with pytest.raises(Exception, match="x: not JSON"):
        encoded(declared(spark.sql("SELECT '{' AS x"), {"x": "JSON"})).collect()
    with pytest.raises(ValueError, match="repeat"):
        encoded(spark.sql("SELECT 1 AS x, 2 AS x"))


def test_only_exports_can_be_mounted(spark, records, tmp_path):
    cost = replace(apps.session_cost(), exports=("session_cost",))
    chosen = [apps.signal_counts(), cost]
    runner = Runner(spark, str(tmp_path / "store"), chosen)
    for app in chosen:
        runner.install(app)
    runner.process_records(records.where("position <= 30"), 0)
    snapshot = Snapshot(spark, str(tmp_path / "store"), chosen)
    answer = snapshot.query("signal-counts", "SELECT count(*) AS n FROM {c_session_cost}", mounts={"c": "session-cost"})
    assert list(answer.mounts[0]["contract"]) == ["session_cost"] and answer.columns == [{"name": "n", "type": "DYNAMIC"}]
    with pytest.raises(Exception):
        snapshot.query("signal-counts", "SELECT * FROM {c_session_cost_detail}", mounts={"c": "session-cost"})


def test_counters_and_sample_of_a_batch(spark):
    texts = {1: "a", 2: "b" * 40000, 3: "é"}
    frame = spark.createDataFrame(
        [(k, f"e{k}", "log" if k < 3 else "span", "n", "s", text, len(text.encode())) for k, text in texts.items()],
        "position long, event_id string, signal string, name string, source string, record string, canonical_bytes long",
    )
    counted = {row.signal: row[1:] for row in lifecycle.intake(frame).collect()}
    assert counted == {"log": (2, 40001, 2), "span": (1, 2, 3)}
    normalized = frame.withColumns({"effective": F.lit(False), "error_reason": F.lit(None).cast("string")})
    sample = lifecycle.ineffective_sample(frame, normalized).collect()
    assert [(row.position, row.payload, row.payload_omitted) for row in sample] == [(3, '{"record":"é"}', False), (2, None, True), (1, '{"record":"a"}', False)]
    plan = lifecycle.ineffective_sample(frame, normalized)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
