import json

from pyspark.sql import functions as F

from foldtrace.plans import apps
from foldtrace.sources import otlp

from .fixtures.cross_harness import BASE, DAY, MINUTE, ONE_METRIC, ONE_SPAN, attribute, log, resource, working_day

SCHEMA = "request_block string, request_line long, signal string, body string"


def canonical(spark, *bodies):
    rows = [("b0", i, signal, body) for i, (signal, body) in enumerate(bodies)]
    return otlp.canonicalize(spark.createDataFrame(rows, SCHEMA))


def test_a_working_day_through_the_apps(spark):
    frame = canonical(spark, ("log", working_day()), ("span", ONE_SPAN), ("metric", ONE_METRIC))
    records = otlp.positioned_records(frame).cache()
    rows = records.select("position", "event_id", "source", "signal", "name").orderBy("position").collect()
    assert [row.position for row in rows] == list(range(1, len(DAY) + 3))
    assert rows[-1].name == "plan.words" and rows[-2].name == "plan.step"
    guard = apps.agent_guard().tables(records)
    denied = guard["policy_violations"].where("rule_id = 'denied-tool'").select("harness", "session_id").collect()
    assert [tuple(row) for row in denied] == [("claude-code", "release")]
    assert {row.session_id for row in guard["policy_gaps"].collect()} == {"chores"}
    loops = {(row.finding_kind, row.session_id) for row in guard["loop_findings"].collect()}
    assert loops == {("repeated-failure", "nightly-build"), ("bounded-no-progress", "triage")}
    cost = apps.session_cost().tables(records)["session_cost"]
    assert {row.session_id: row.cost_microusd for row in cost.collect()} == {"release": 3300, "chores": 15, "idle": 0}
    joined = guard["session_progress"].join(cost, ["harness", "session_id"]).select("session_id").collect()
    assert {row.session_id for row in joined} == {"release", "chores"}
    signals = apps.signal_counts().tables(records)["signal_counts"].where("source = 'planner'").collect()
    assert {(row.signal, row.event_name) for row in signals} == {("span", "plan.step"), ("metric", "plan.words")}
    records.unpersist()


def test_span_and_metric_details(spark):
    rows = otlp.admitted(canonical(spark, ("span", ONE_SPAN), ("metric", ONE_METRIC))).collect()
    span, metric = rows
    assert span.trace_id == "abcd1234" * 4 and span.span_id == "1234abcd" * 2 and span.time_unix_nano == str(BASE + 7 * MINUTE)
    frame = otlp.admitted(canonical(spark, ("span", ONE_SPAN), ("metric", ONE_METRIC)))
    span_record, metric_record = [json.loads(row.j) for row in frame.select(F.to_json("record").alias("j")).collect()]
    assert span_record["kind"] == "SPAN_KIND_CLIENT" and span_record["parent_span_id"] is None
    assert metric_record["metric"] == {
        "aggregation_temporality": "AGGREGATION_TEMPORALITY_DELTA",
        "description": "",
        "is_monotonic": True,
        "name": "plan.words",
        "point_type": "sum",
        "unit": "word",
    }


def test_any_values(spark):
    values = [
        {"key": "s", "value": {"stringValue": "x"}},
        {"key": "big", "value": {"intValue": "9007199254740993"}},
        {"key": "list", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"stringValue": "a"}, {}]}}},
        {"key": "map", "value": {"kvlistValue": {"values": [{"key": "in.ner", "value": {"boolValue": True}}]}}},
        {"key": "bytes", "value": {"bytesValue": "aGVsbG8="}},
        {"key": "none", "value": {}},
        {"key": "half", "value": {"doubleValue": 0.5}},
        {"key": "empty", "value": {"arrayValue": {}}},
    ]
    record = log(1, "x")
    record["attributes"] = values
    body = json.dumps({"resourceLogs": [resource("svc", [record])]})
    row = otlp.admitted(canonical(spark, ("log", body))).select(F.to_json("attributes").alias("a")).first()
    assert json.loads(row.a) == {
        "s": "x",
        "big": {"integer_decimal": "9007199254740993"},
        "list": [1, "a", None],
        "map": {"in.ner": True},
        "bytes": {"bytes_base64": "aGVsbG8="},
        "none": None,
        "half": 0.5,
        "empty": [],
    }


def test_bad_requests_contribute_nothing(spark):
    def with_attributes(attributes):
        good, bad = log(1, "a"), log(2, "b")
        bad["attributes"] = attributes
        return json.dumps({"resourceLogs": [resource("svc", [good, bad])]})

    cases = {
        "malformed request": '{"resourceLogs":',
        "record: attribute key is duplicated": with_attributes([attribute("k", 1), attribute("k", 2)]),
        "attribute key is empty": with_attributes([attribute("", 1)]),
        "string-table attributes are unsupported": with_attributes([{"keyStrindex": 1, "key": "k", "value": {"intValue": "1"}}]),
        "canonical record exceeds the limit": with_attributes([attribute("k", "v" * (256 * 1024))]),
        "non-finite double": with_attributes([{"key": "k", "value": {"doubleValue": "NaN"}}]),
    }
    nested = {"kvlistValue": {"values": [{"key": "", "value": {"intValue": "1"}}]}}
    shapes = {
        "an integer is expected": with_attributes([{"key": "k", "value": {"intValue": "abc"}}]),
        "a number is expected": with_attributes([{"key": "k", "value": {"doubleValue": "1,5"}}]),
        "a boolean is expected": with_attributes([{"key": "k", "value": {"boolValue": "yes"}}]),
        "a text is expected": with_attributes([{"key": 7, "value": {"stringValue": "x"}}]),
        "an object is expected": with_attributes([{"key": "k", "value": {"arrayValue": [1]}}]),
        "a list is expected": with_attributes({"k": "v"}),
        "attribute key is empty": json.dumps({"resourceLogs": [resource("svc", [{**log(1, "a"), "body": nested}])]}),
    }
    frame = canonical(spark, *[("log", body) for body in shapes.values()], ("log", json.dumps({"resourceLogs": {"a": 1}})))
    assert [row.rejected for row in frame.orderBy("request_line").collect()] == [*shapes, "a list is expected"]
    quoted = json.dumps({"resourceLogs": [resource("svc", [log(3, '"attributes":{ "key":"" "intValue":x')])]})
    assert canonical(spark, ("log", quoted)).first().rejected is None
    frame = canonical(spark, *[("log", body) for body in cases.values()], ("log", json.dumps({"resourceLogs": [resource("svc", [log(3, "fine")])]})))
    assert [row.rejected for row in frame.orderBy("request_line").collect()] == [*cases, None]
    records = otlp.positioned_records(frame, base=10).collect()
    assert [(row.position, row.name) for row in records] == [(11, "fine")]
    pointless = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m"}]}]}]})
    assert canonical(spark, ("metric", pointless)).first().rejected == "metric has no supported data points"


def test_positions_run_over_blocks(spark):
    rows = []
    for block in ("a", "b", "c"):
        for line in range(3):
            body = json.dumps({"resourceLogs": [resource("svc", [log(i, f"{block}{line}{i}") for i in range(line + 1)])]})
            rows.append((block, line, "log", body))
    frame = otlp.canonicalize(spark.createDataFrame(rows, SCHEMA).repartition(3))
    records = otlp.positioned_records(frame).orderBy("position").collect()
    assert [row.position for row in records] == list(range(1, 19))
    assert [row.name for row in records] == sorted(row.name for row in records)


def test_read_requests_from_gzip_lines(spark, tmp_path):
    import gzip

    for part in range(2):
        with gzip.open(tmp_path / f"part-{part}.json.gz", "wt") as out:
            for line in range(2):
                out.write(json.dumps({"resourceLogs": [resource("svc", [log(1, f"p{part}l{line}")])]}) + "\n")
    frame = otlp.canonicalize(otlp.read_requests(spark, str(tmp_path), "log"))
    records = otlp.positioned_records(frame).orderBy("position").collect()
    assert [row.name for row in records] == ["p0l0", "p0l1", "p1l0", "p1l1"]
