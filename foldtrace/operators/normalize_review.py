"""Daily review: per-day activity, usage, content-presence and risk flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.values import counter, round_half_even, utc_day
from .normalize_activity import lowered
from .normalize_usage import MICRO, Usage
from .record_view import RecordView, finish, number_problems, outcome

KEYS = [
    *V.COUNTER_KEYS,
    *V.DURATION_KEYS,
    *V.IDENTITY_KEYS,
    *V.AUTH_KEYS,
    *V.PROMPT_CONTENT_KEYS,
    *V.TOOL_CONTENT_KEYS,
    *V.TOOL_KEYS,
    *V.TARGET_KEYS,
    "operation_kind",
    "success",
    "status_code",
    "http.response.status_code",
    "status",
]


def flag(condition: Column) -> Column:
    return condition.cast("bigint")


def rounded(number: Column) -> Column:
    return round_half_even(number.cast("double"))


def normalize(records: DataFrame) -> DataFrame:
    view = RecordView(records, KEYS)
    view.frame = view.frame.withColumns({"_tool": view.is_tool, "_api": view.is_api_request})
    attrs = view.attrs
    tool_event, api_event = F.col("_tool"), F.col("_api")
    usage = Usage(attrs)
    stream = (view.name == V.USAGE_STREAM_EVENT) & attrs.any_present(V.REVIEW_COUNTER_KEYS)
    usage_event = api_event | stream

    status_code = attrs.first_existing(("status_code", "http.response.status_code"))
    duration = attrs.first_existing(V.DURATION_KEYS)
    duration_known = F.coalesce(duration.number >= 0, F.lit(False))

    # A used counter counts only for usage events of records that carry a time.
    counted = usage_event & view.has_time
    zero = F.lit(0.0)
    counters = {
        name: F.when(usage_event, rounded(counter(value))).otherwise(zero) for name, value in usage.values.items()
    }
    usd = F.coalesce(round_half_even(usage.cost_usd.number / F.lit(MICRO)), zero)
    counters["cost_microusd"] = F.when(
        usage_event, F.when(usage.cost.exists, rounded(counter(usage.cost))).otherwise(usd)
    ).otherwise(zero)
    numbers = {
        "duration_milliseconds": F.when(duration_known, rounded(duration.number)).otherwise(zero),
        **counters,
    }
    problems = (
        number_problems({"status_code": status_code, "duration": duration})
        + number_problems(usage.values, counted)
        + number_problems({"cost_microusd": usage.cost}, counted)
        + number_problems({"cost_usd": usage.cost_usd}, counted & ~usage.cost.exists)
        + [(view.has_time & F.col("_time").try_cast("double").isNull(), "event time: must be numeric")]
    )
    target = F.coalesce(attrs.first_truthy(V.TARGET_KEYS).text, F.lit(""))
    risky = (
        lowered(attrs.first_truthy(V.TOOL_KEYS)).isin(*V.DENIED_TOOLS)
        | lowered(attrs["operation_kind"]).isin(*V.DENIED_OPERATIONS)
        | target.startswith(V.OUTSIDE_TARGET_PREFIX)
    )
    return finish(
        view.frame,
        view.has_time,
        problems,
        {
            "day_utc": utc_day(F.col("_time").try_cast("double")),
            "harness": F.col("harness"),
            "tool_event": flag(tool_event),
            "api_event": flag(api_event),
            "success_state": F.when(
                tool_event | api_event, outcome(attrs["success"], status_code, attrs["status"])
            ).otherwise("not-applicable"),
            "duration_observed": flag(duration_known),
            **numbers,
            "session_unknown": flag(~view.session_known),
            "identity_metadata": flag(attrs.any_present(V.IDENTITY_KEYS)),
            "auth_metadata": flag(attrs.any_present(V.AUTH_KEYS)),
            "raw_prompt_content": flag(attrs.any_present(V.PROMPT_CONTENT_KEYS)),
            "raw_tool_content": flag(attrs.any_present(V.TOOL_CONTENT_KEYS)),
            "risky_action": flag(risky),
            "event_time_unix_nano": F.col("_time"),
            "source_position": F.col("position"),
        },
        integers=list(numbers),
    )
