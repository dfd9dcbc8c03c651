"""Activity statistics: event families, buckets, lengths, durations and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.values import Value, counter
from .normalize_usage import Usage
from .record_view import RecordView, coverage, finish, mapped, number_problems, outcome

KEYS = [
    *V.COUNTER_KEYS,
    *V.TOOL_KEYS,
    *V.ENDPOINT_KEYS,
    *V.LENGTH_KEYS,
    *V.DURATION_KEYS,
    "success",
    "status_code",
    "status",
]


def family_of(view: RecordView) -> Column:
    """Family of an event name, empty when it is none of ours."""
    name = view.name
    stream = (name == V.USAGE_STREAM_EVENT) & view.attrs.any_present(V.COUNTER_KEYS)
    return (
        F.when(view.is_tool, "tool")
        .when(view.is_api_request, "api-request")
        .when(name.isin(*V.ASSISTANT_RESPONSE_EVENTS), "assistant-response")
        .when(name.isin(*V.USER_PROMPT_EVENTS), "user-prompt")
        .when(name.isin(*V.TURN_TTFT_EVENTS), "turn-ttft")
        .when(name.isin(*V.WEBSOCKET_EVENTS), "websocket-request")
        .when(stream, "token-usage")
        .otherwise("")
    )


def lowered(value: Value) -> Column:
    return F.lower(F.coalesce(value.text, F.lit("")))


def tool_bucket(tool: Value) -> Column:
    name = lowered(tool)
    return mapped(name, V.TOOL_BUCKETS, F.when(name == "", "unknown").otherwise("other"))


def endpoint_bucket(endpoint: Value, websocket: Column) -> Column:
    name = lowered(endpoint)
    fallback = F.when(websocket, "websocket").when(name == "", "unknown").otherwise("other")
    return mapped(name, V.ENDPOINT_BUCKETS, fallback)


def normalize(records: DataFrame) -> DataFrame:
    view = RecordView(records, KEYS)
    view.frame = view.frame.withColumn("_family", family_of(view))
    attrs = view.attrs
    family = F.col("_family")
    usage = Usage(attrs)
    length = attrs.first_truthy(V.LENGTH_KEYS)
    duration = attrs.first_truthy(V.DURATION_KEYS)
    status_code = attrs["status_code"]
    opencode_log = (F.col("harness") == "opencode") & (F.col("signal") == "log")

    has_length = family.isin("assistant-response", "user-prompt")
    performance = family.isin("api-request", "turn-ttft", "websocket-request")
    has_duration = performance | (family == "tool")
    has_endpoint = family.isin("api-request", "websocket-request")
    has_tokens = family.isin("api-request", "token-usage")

    zero = F.lit(0).cast("bigint")
    counters = {
        "reported_length": F.when(has_length, counter(length)).otherwise(zero),
        "duration_milliseconds": F.when(has_duration, counter(duration)).otherwise(zero),
        **{name: counter(value) for name, value in usage.values.items()},
        "cost_microusd": usage.cost_microusd(opencode_log),
    }
    problems = (
        number_problems({"length": length}, has_length)
        + number_problems({"duration": duration}, has_duration)
        + number_problems({"status_code": status_code})
        + number_problems(usage.values)
        + usage.cost_problems(opencode_log)
    )
    return finish(
        view.frame,
        (family != "") & view.has_time,
        problems,
        {
            "harness": F.col("harness"),
            "session_id": F.col("session_id"),
            "event_family": family,
            "tool_bucket": F.when(family == "tool", tool_bucket(attrs.first_truthy(V.TOOL_KEYS))).otherwise(
                "not-applicable"
            ),
            "endpoint_bucket": F.when(
                has_endpoint,
                endpoint_bucket(attrs.first_truthy(V.ENDPOINT_KEYS), family == "websocket-request"),
            ).otherwise("not-applicable"),
            "success_state": outcome(
                attrs["success"], status_code, attrs.first_existing(("status_code", "status"))
            ),
            **counters,
            "length_coverage": coverage(length.exists, has_length),
            "duration_coverage": coverage(duration.exists, has_duration),
            "token_coverage": coverage(attrs.any_present(V.COUNTER_KEYS), has_tokens),
            "session_coverage": coverage(view.session_known),
            "performance_event": performance,
            "event_time_unix_nano": F.col("_time"),
            "source_position": F.col("position"),
        },
        integers=list(counters),
    )
