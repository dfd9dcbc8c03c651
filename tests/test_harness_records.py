"""Shapes of the supported harnesses as open (VARIANT) records, with values of our own."""

import json

import pytest
from pyspark.sql import functions as F

from foldtrace.operators import normalize_activity, normalize_guard, normalize_review, normalize_usage
from foldtrace.plans import apps
from foldtrace.sources.tables import events_as_records, read_table, with_variant_attributes

SCHEMA = (
    "position long, event_id string, signal string, name string, source string, time_unix_nano string, observed_unix_nano string, "
    "content_digest string, body string, a string, r string"
)
AT = "1712345678000000123"


def records(spark, *items):
    rows = []
    for index, item in enumerate(items, 1):
        item = {"signal": "log", "name": "", "source": "codex", "time": AT, "observed": None, "body": None, "resource": {}, **item}
        rows.append(
            (index, f"local:{index}", item["signal"], item["name"], item["source"], item["time"], item["observed"], "sha256:x",
             item["body"], json.dumps(item["attributes"]), json.dumps(item["resource"]))
        )
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns(
        {"attributes": F.parse_json("a"), "resource_attributes": F.parse_json("r"), "body": F.col("body").cast("variant")}
    ).drop("a", "r")


CLAUDE_TOOL = dict(source="claude-code", name="tool_result", body="claude_code.tool_result",
                   attributes={"event.name": "tool_result", "session.id": "s", "tool_name": "Read", "success": True})
CLAUDE_API = dict(source="claude-code", name="api_request", body="claude_code.api_request",
                  attributes={"event.name": "api_request", "session.id": "s", "input_tokens": 11, "output_tokens": 204,
                              "cache_read_tokens": 7301, "cost_usd_micros": 480213})
CODEX_USAGE = dict(source="codex_exec", name="event x", time=None, observed="1712345000000000777",
                   attributes={"event.name": "codex.sse_event", "conversation.id": "s", "input_token_count": 91,
                               "output_token_count": 44, "cached_token_count": 17, "reasoning_token_count": 6})
CODEX_API = dict(source="codex_exec", name="event x", time=None, observed="1712345000000000888",
                 attributes={"event.name": "codex.api_request", "conversation.id": "s", "endpoint": "/v1/responses",
                             "latency_ms": 1230, "status_code": 200})
OPENCODE_API = dict(source="opencode", name="api_request", body="api_request",
                    attributes={"event.name": "api_request", "session.id": "s", "input_tokens": 63, "output_tokens": 25,
                                "reasoning_tokens": 3, "cache_read_tokens": 12, "cost_usd": 0.012345})
OPENCODE_SPAN = dict(source="opencode", name="opencode.tool.bash", signal="span", attributes={"session.id": "s", "tool.name": "bash"})
VSCODE = dict(source="copilot-chat", name="gen_ai.client.inference.operation.details", resource={"session.id": "r"},
              attributes={"event.name": "gen_ai.client.inference.operation.details", "gen_ai.usage.input_tokens": 310,
                          "gen_ai.usage.output_tokens": 8})


def test_usage_of_every_harness(spark):
    frame = records(spark, CLAUDE_API, CODEX_USAGE, CODEX_API, OPENCODE_API, OPENCODE_SPAN, VSCODE)
    found = {
        row.position: (row.harness, row.session_id, row.input_tokens, row.output_tokens, row.cached_input_tokens, row.reasoning_output_tokens, row.cost_microusd)
        for row in apps.session_cost().events(frame).collect()
    }
    assert found == {
        1: ("claude-code", "s", 11, 204, 7301, 0, 480213),
        2: ("codex", "s", 91, 44, 17, 6, 0),
        4: ("opencode", "s", 63, 25, 12, 3, 12345),
        6: ("vscode-copilot-chat", "r", 310, 8, 0, 0, 0),
    }


def test_activity_and_guard_views(spark):
    frame = records(spark, CLAUDE_TOOL, CODEX_API, OPENCODE_SPAN)
    activity = {row.position: row for row in apps.activity_stats().events(frame).collect()}
    assert set(activity) == {1, 2}
    assert (activity[2].event_family, activity[2].endpoint_bucket, activity[2].success_state, activity[2].duration_milliseconds) == (
        "api-request", "responses", "success", 1230)
    assert activity[2].token_coverage == "unknown" and activity[2].event_time_unix_nano == "1712345000000000888"
    guard = apps.agent_guard().events(frame).collect()
    assert [(row.position, row.tool, row.target, row.target_coverage, row.success) for row in guard] == [(1, "read", None, "unknown", True)]


def test_null_zero_and_malformed_values(spark):
    frame = records(
        spark,
        dict(attributes={"event.name": "codex.tool_result", "success": None, "duration_ms": 0, "latency_ms": 5, "session.id": ""}),
        dict(attributes={"event.name": "codex.tool_result", "duration_ms": 1.5, "model": None}),
        dict(attributes={"event.name": "codex.api_request", "input_tokens": "12", "status_code": "abc"}),
        dict(attributes={"event.name": "codex.api_request", "input_tokens": 9007199254740992}),
    )
    activity = normalize_activity.normalize(frame).orderBy("position").collect()
    # A null success is a failure; a zero duration falls through to the next alias; an empty id is unknown.
    assert (activity[0].success_state, activity[0].duration_milliseconds, activity[0].session_id) == ("failure", 5, "unknown:codex")
    assert "duration_milliseconds" in activity[1].error_reason and activity[2].error_reason == "status_code: must be numeric"
    assert "input_tokens" in activity[3].error_reason
    review = normalize_review.normalize(frame).orderBy("position").collect()
    # The review keeps the zero and rounds half to even.
    assert (review[0].duration_observed, review[0].duration_milliseconds) == (1, 0)
    assert review[1].error_reason is None and review[1].duration_milliseconds == 2
    usage = normalize_usage.normalize(frame).orderBy("position").collect()
    assert usage[2].input_tokens == 12 and usage[2].error_reason is None
    guard = normalize_guard.normalize(frame).orderBy("position").collect()
    assert guard[0].success is False and guard[1].model == "null"


@pytest.mark.parametrize("module", [normalize_usage, normalize_guard])
def test_typed_and_open_attributes_agree(spark, module):
    typed = events_as_records(read_table(spark, "/root/testdata/sf0.001", "events"))
    left, right = module.normalize(typed), module.normalize(with_variant_attributes(typed))
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0
