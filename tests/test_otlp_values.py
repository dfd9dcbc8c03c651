"""Values of OTLP requests: decoded at any depth, or the request is refused."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldtrace.sources import otlp
from foldtrace.sources.otlp_json import Limits, canonical_texts


def request(**fields):
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [fields]}]}]})


def with_value(value):
    return request(attributes=[{"key": "k", "value": value}])


def outcome(body, signal="log", limits=Limits()):
    reason, texts = canonical_texts(signal, body, limits)
    return reason or [json.loads(text) for text in texts]


def pair(key, value):
    return {"key": key, "value": value}


def keyed(*pairs):
    return {"kvlistValue": {"values": list(pairs)}}


def listed(*values):
    return {"arrayValue": {"values": list(values)}}


TWICE = (pair("k", {"intValue": "1"}), pair("k", {"intValue": "2"}))
REFUSED = {
    with_value(listed(keyed(*TWICE))): "record: attribute key is duplicated",
    with_value(keyed(pair("o", keyed(*TWICE)))): "record: attribute key is duplicated",
    with_value(keyed(pair("a", listed(keyed(pair("b", keyed(*TWICE))))))): "record: attribute key is duplicated",
    request(body=keyed(*TWICE)): "body: attribute key is duplicated",
    with_value(keyed(pair("", {}))): "attribute key is empty",
    with_value({"mysteryValue": 1}): "unknown field 'mysteryValue'",
    with_value({"intValue": "9223372036854775808"}): "an integer is out of range",
    with_value({"intValue": "9" * 6000}): "an integer is out of range",
    with_value({"intValue": 1.5}): "an integer is expected",
    with_value({"intValue": True}): "an integer is expected",
    with_value({"intValue": "1", "stringValue": "x"}): "a value of two kinds",
    with_value({"doubleValue": "1e999"}): "a number is out of range",
    with_value({"doubleValue": "-Infinity"}): "non-finite double",
    with_value({"bytesValue": "!!"}): "base64 is expected",
    with_value({"stringValueStrindex": 0}): "string-table attributes are unsupported",
    with_value([]): "an object is expected",
    request(timeUnixNano="abc"): "an integer is expected",
    request(timeUnixNano="-5"): "an integer is out of range",
    request(traceId="zz!"): "base64 is expected",
    request(flags="x"): "an integer is expected",
    request(severityNumber="LOUD"): "an enumeration value is expected",
    request(extra=1): "unknown field 'extra'",
    '{"resourceLogs":[],"resourceLogs":[]}': "field 'resourceLogs' is given twice",
    '{"resourceLogs":[],"resource_logs":[]}': "field 'resource_logs' is given twice",
    '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"doubleValue":NaN}}]}]}]}': "malformed request",
    "[" * 100_000: "malformed request",
    '"\\ud800"': "an object is expected",
    request(severityText="\ud800"): "a text is not valid Unicode",
}


@pytest.mark.parametrize("body", REFUSED)
def test_refused_with_a_reason(body):
    assert outcome(body) == REFUSED[body]


def test_admitted_forms():
    record = outcome(request(time_unix_nano=5, observedTimeUnixNano="7", severityNumber=9, severity_text="0", flags=0, body=None, traceId="q80="))[0]
    assert record["otel"] == {"time_unix_nano": "5", "observed_time_unix_nano": "7", "severity_number": "SEVERITY_NUMBER_INFO", "severity_text": "0", "trace_id": "q80="}
    assert record["body"] is None and record["severity_number"] == "SEVERITY_NUMBER_INFO" and record["flags"] == 0
    assert outcome(request(severityNumber=77))[0]["severity_number"] == "77"
    assert outcome(with_value({"intValue": "1e2"}))[0]["attributes"] == {"k": 100}
    assert outcome(with_value({"bytesValue": "-_8"}))[0]["attributes"] == {"k": {"bytes_base64": "+/8="}}
    assert outcome(request(attributes=None)) == outcome(request()) and outcome("{}") == []


def test_points_of_every_kind():
    point = {"timeUnixNano": "9", "count": "2", "attributes": [pair("a", {"boolValue": False})]}
    kinds = {"gauge": {"asInt": "0"}, "sum": {"asDouble": "NaN"}, "histogram": {"sum": 0}, "exponentialHistogram": {"scale": -3}, "summary": {}}
    metrics = []
    for kind, more in kinds.items():
        own = {**point, **more}
        if kind in ("gauge", "sum"):
            del own["count"]
        metrics.append({"name": kind, kind: {"dataPoints": [own]}})
    records = outcome(json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]}), "metric")
    assert [r["metric"]["point_type"] for r in records] == ["gauge", "sum", "histogram", "exponential_histogram", "summary"]
    assert records[0]["otel"]["as_int"] == "0" and records[1]["otel"]["as_double"] == "NaN" and records[2]["otel"]["sum"] == 0
    assert all(r["attributes"] == {"a": False} and r["time_unix_nano"] == "9" for r in records)
    assert outcome('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"x","gauge":{},"sum":{}}]}]}]}', "metric") == "a value of two kinds"


def test_limits_refuse_the_whole_request():
    body = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{}, {"severityText": "x" * 400}]}]}]})
    assert len(outcome(body)) == 2
    assert outcome(body, limits=Limits(request_records=1)) == "request exceeds the record limit"
    assert outcome(body, limits=Limits(request_bytes=100)) == "request exceeds the byte limit"
    assert outcome(body, limits=Limits(record_bytes=400)) == "canonical record exceeds the limit"
    deep = {"intValue": "1"}
    for _ in range(60):
        deep = listed(keyed(pair("k", deep)))
    assert outcome(with_value(deep)) == "values nest too deep"
    assert isinstance(outcome(with_value(deep), limits=Limits(depth=320)), list)


VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.text(max_size=5), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False)),
    lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(st.text(min_size=1, max_size=3), inner, max_size=3)),
    max_leaves=12,
)


def sent(value):
    if value is None:
        return {}
    if isinstance(value, bool):
        return {"boolValue": value}
    if isinstance(value, str):
        return {"stringValue": value}
    if isinstance(value, int):
        return {"intValue": str(value)}
    if isinstance(value, float):
        return {"doubleValue": value}
    if isinstance(value, list):
        return listed(*map(sent, value))
    return keyed(*(pair(k, sent(v)) for k, v in value.items()))


def expected(value):
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) > 2**53 - 1:
        return {"integer_decimal": str(value)}
    if isinstance(value, list):
        return [expected(x) for x in value]
    return {k: expected(v) for k, v in value.items()} if isinstance(value, dict) else value


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_any_value_is_given_back(value):
    assert outcome(with_value(sent(value)))[0]["attributes"] == {"k": expected(value)}


def test_values_and_refusals_through_spark(spark):
    bodies = [with_value(sent({"a": [{"b": {"c": [1, None]}}]})), *list(REFUSED)[:3], None, with_value({"intValue": "1"})]
    rows = [("b", k, "log", body) for k, body in enumerate(bodies)] + [("b", 99, "trace", "{}"), ("b", 98, None, "{}")]
    frame = otlp.canonicalize(spark.createDataFrame(rows, "request_block string, request_line long, signal string, body string"))
    records = otlp.positioned_records(frame).select("position", F.to_json("attributes").alias("a")).orderBy("position").collect()
    assert [(r.position, json.loads(r.a)) for r in records] == [(1, {"k": {"a": [{"b": {"c": [1, None]}}]}}), (2, {"k": 1})]
    refused = {r.request_line: (r.signal, r.rejected, r.body) for r in otlp.rejected(frame).collect()}
    assert refused[1] == ("log", "record: attribute key is duplicated", bodies[1])
    assert [refused[k][1] for k in (4, 98, 99)] == ["malformed request"] * 3 and refused[99][0] == "trace" and refused[98][0] is None


def test_a_batch_is_decoded_as_its_pieces_leave(monkeypatch):
    bodies, walked = [with_value({"stringValue": "x" * 200})] * 40, []
    monkeypatch.setattr(otlp, "PIECE_CHARS", 1000)
    monkeypatch.setattr(otlp, "canonical_texts", lambda *given: walked.append(1) or canonical_texts(*given))
    batch = pa.RecordBatch.from_pydict({"signal": ["log"] * 40, "body": bodies})
    layout = pa.schema([*batch.schema, pa.field("records", pa.list_(pa.string())), pa.field("rejected", pa.string())])
    rows = 0
    for piece in otlp._decoder(layout, Limits())(iter([batch])):
        rows += piece.num_rows
        assert len(walked) == rows and piece.num_rows < 10
    assert rows == 40
