import pytest
from pyspark.sql import functions as F

from foldtrace.plans import apps
from foldtrace.plans.serve import FrontierChanged, Snapshot
from foldtrace.sources import otlp
from foldtrace.sources.tables import events_as_records, read_table
from foldtrace.streaming.runner import Runner

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    frame = events_as_records(read_table(spark, SMALL, "events")).where("position <= 400").cache()
    yield frame
    frame.unpersist()


def rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


def test_batches_equal_one_batch_and_replay_changes_nothing(spark, records, tmp_path):
    chosen = [apps.session_cost(), apps.agent_guard(chunk=64)]
    runner = Runner(spark, str(tmp_path / "store"), chosen)
    for batch, (low, high) in enumerate([(1, 150), (151, 333), (334, 400)]):
        part = records.where(F.col("position").between(low, high))
        runner.process_records(part, batch)
    before = runner.store.read()
    runner.process_records(records.where("position > 333"), 2)
    assert runner.store.read() == before
    for app in chosen:
        whole = app.tables(records)
        for name in app.keys:
            assert rows(runner.store.table(before, app.name, name)) == rows(whole[name]), name
    status = {row.app: row for row in runner.status().collect()}
    assert status["agent-guard"].position == 400 and status["agent-guard"].lag == 0
    assert status["agent-guard"].consumed == 400
    assert status["agent-guard"].ineffective + status["agent-guard"].emitted == 400
    assert len(before["apps"]["agent-guard"]["sample"]) == 16
    assert sum(part["records"] for part in before["intake"].values()) == 400

    snapshot = Snapshot(spark, str(tmp_path / "store"), chosen)
    joined = snapshot.query(
        "agent-guard",
        "SELECT p.session_id, c.input_tokens FROM {session_progress} p JOIN {cost_session_cost} c "
        "ON c.harness = p.harness AND c.session_id = p.session_id WHERE c.input_tokens >= ? ORDER BY p.session_id",
        [0],
        {"cost": "session-cost"},
        expected_position=400,
        limit=3,
    )
    assert joined.truncated and len(joined.rows) == 3 and joined.mounts[0]["alias"] == "cost"
    findings = snapshot.query("agent-guard", "SELECT evidence FROM {policy_findings} LIMIT 1")
    assert isinstance(findings.rows[0][0], dict) and findings.columns == [{"name": "evidence", "type": "JSON"}]
    with pytest.raises(FrontierChanged):
        snapshot.query("agent-guard", "SELECT 1", expected_position=1)


def test_gap_stops_one_app_and_keeps_the_prefix(spark, tmp_path):
    events = read_table(spark, SMALL, "events").where("event_id < 200")
    # A fractional duration cannot be an INTEGER: the review rounds it, activity stops there.
    fractional = {"duration_ms": "CASE WHEN timed AND slot <> 1 THEN IF(event_id >= 120, value * 20 + 0.5, floor(value * 20)) END"}
    frame = events_as_records(events, fractional)
    chosen = [apps.activity_stats(), apps.daily_review()]
    runner = Runner(spark, str(tmp_path / "store"), chosen)
    runner.process_records(frame.where("position <= 150"), 0)
    runner.process_records(frame.where("position > 150"), 1)
    status = {row.app: row for row in runner.status().collect()}
    stopped, running = status["activity-stats"], status["daily-review"]
    bad = chosen[0].normalize(frame).where("error_reason IS NOT NULL").agg(F.min("position")).first()[0]
    assert bad > 120 and stopped.gap_position == bad and stopped.position == bad - 1 and not stopped.complete
    assert "duration_milliseconds" in stopped.gap_reason
    assert stopped.consumed == bad - 1 and stopped.detached == 200 - bad + 1
    assert running.position == 200 and running.complete
    state = runner.store.read()
    prefix = chosen[0].tables(frame.where(F.col("position") < bad))
    assert rows(runner.store.table(state, "activity-stats", "session_activity")) == rows(prefix["session_activity"])


def test_negative_total_is_a_gap_only_below_zero(spark, tmp_path):
    events = read_table(spark, SMALL, "events").where("event_id < 120")
    app = apps.activity_stats()
    timed = events_as_records(events).where("attributes.duration_ms > 0 OR attributes.latency_ms > 0").select("position")
    plain = app.normalize(events_as_records(events)).where("effective").join(timed, "position")
    # The first timed event of its bucket: whatever follows, its total is the first to fall below zero.
    first = plain.agg(F.min("position")).first()[0]
    for value, gap in ((-1, first), (0, None)):
        changed = {name: f"CASE WHEN timed THEN IF(event_id + 1 = {first}, {value}, floor(value * 20)) END" for name in ("duration_ms", "latency_ms")}
        runner = Runner(spark, str(tmp_path / f"store{value}"), [app])
        runner.process_records(events_as_records(events, changed), 0)
        status = runner.status().first()
        assert status.gap_position == gap and ("CHECK" in status.gap_reason if gap else status.complete)


def test_streams_have_ledgers_of_their_own(spark, records, tmp_path):
    app = apps.signal_counts()
    runner = Runner(spark, str(tmp_path / "store"), [app])
    parts = [records.where(F.col("position").between(low, low + 49)) for low in (1, 51, 101)]
    runner.process_records(parts[0], 0, "logs")
    runner.process_records(parts[1], 0, "spans")
    runner.process_records(parts[1], 0, "spans")
    runner.process_records(parts[2], 1, "logs")
    state = runner.store.read()
    assert state["batches"] == {"logs": 1, "spans": 0} and state["head"] == 150
    expected = app.tables(records.where("position <= 150"))["signal_counts"]
    assert rows(runner.store.table(state, app.name, "signal_counts")) == rows(expected)


def test_an_app_that_cannot_start_does_not_stop_others(spark, records, tmp_path):
    good, late = apps.signal_counts(), apps.session_cost()
    runner = Runner(spark, str(tmp_path / "store"), [good])
    runner.process_records(records.where("position <= 60"), 0)
    runner.apps.append(late)  # never installed: its positions do not start at 1
    runner.process_records(records.where("position BETWEEN 61 AND 90"), 1)
    status = {row.app: row for row in runner.status().collect()}
    assert status["signal-counts"].position == 90 and status["signal-counts"].complete
    stopped = status["session-cost"]
    assert stopped.gap_position == 1 and "do not continue" in stopped.gap_reason and stopped.detached == 30


def test_boundary_install_and_rebuild(spark, records, tmp_path):
    first, later = apps.signal_counts(), apps.session_cost()
    runner = Runner(spark, str(tmp_path / "store"), [first])
    runner.process_records(records.where("position <= 100"), 0)
    runner.install(later)
    runner.apps.append(later)
    runner.process_records(records.where("position BETWEEN 101 AND 200"), 1)
    state = runner.store.read()
    expected = later.tables(records.where("position BETWEEN 101 AND 200"))["session_cost"]
    assert rows(runner.store.table(state, "session-cost", "session_cost")) == rows(expected)
    runner.rebuild(later, records.where("position <= 200"))
    state = runner.store.read()
    expected = later.tables(records.where("position <= 200"))["session_cost"]
    assert rows(runner.store.table(state, "session-cost", "session_cost")) == rows(expected)


def test_unrouted_when_no_app_is_active(spark, records, tmp_path):
    runner = Runner(spark, str(tmp_path / "store"), [])
    runner.process_records(records.where("position <= 10"), 0)
    assert runner.store.read()["unrouted"] == 10


def test_stream_of_requests(spark, tmp_path):
    import json

    from .fixtures.cross_harness import log, resource

    source = tmp_path / "in"
    source.mkdir()
    for part in range(2):
        good = json.dumps({"resourceLogs": [resource("codex", [log(part, "codex.tool_result", tool_name="read")])]})
        (source / f"part-{part}.json").write_text(good + "\n" + '{"resourceLogs":' + "\n")
    requests = otlp.stream_requests(spark, str(source), "log")
    runner = Runner(spark, str(tmp_path / "store"), [apps.signal_counts()])
    runner.start(requests, str(tmp_path / "check")).awaitTermination()
    state = runner.store.read()
    assert state["head"] == 2
    counts = runner.store.table(state, "signal-counts", "signal_counts").collect()
    assert [(row.event_name, row.event_count) for row in counts] == [("codex.tool_result", 2)]
    assert spark.read.parquet(str(tmp_path / "store" / "rejects")).count() == 2
