"""Fold declarations of the counting apps."""

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .folds import (
    Count,
    CountIf,
    EverObserved,
    FirstNanos,
    Fold,
    KeyText,
    LastNanos,
    LastPosition,
    LastWhere,
    Quantiles,
    Sum,
)

C = F.col
TIME = "event_time_unix_nano"
USAGE = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens", "cost_microusd")


def _is(column: str, value: str):
    return C(column) == value


def _sums(*names: str) -> tuple[Sum, ...]:
    return tuple(Sum(name, C(name)) for name in names)


def _seen(first: str, last: str) -> tuple:
    return FirstNanos(first, C(TIME)), LastNanos(last, C(TIME))


def _outcomes() -> tuple[CountIf, ...]:
    return (
        CountIf("success_count", _is("success_state", "success")),
        CountIf("failure_count", _is("success_state", "failure")),
        CountIf("outcome_unknown_count", _is("success_state", "unknown")),
    )


def _position() -> LastPosition:
    return LastPosition("last_source_position", C("source_position"))


def signal_counts() -> Fold:
    return Fold(
        "signal_counts",
        ("source", "signal", "event_name"),
        (Count("event_count"), *_seen("first_seen_unix_nano", "last_seen_unix_nano"), _position()),
    )


def session_cost() -> Fold:
    return Fold(
        "session_cost",
        ("harness", "session_id"),
        (*_sums(*USAGE), LastNanos("last_event_time_unix_nano", C(TIME)), _position()),
    )


def session_cost_detail() -> Fold:
    return Fold(
        "session_cost_detail",
        ("harness", "session_id", "model"),
        (
            KeyText("session_id_prefix", F.substring("session_id", 1, V.SESSION_PREFIX_CHARS)),
            LastWhere("project", C("project"), _is("project_coverage", "observed"), "unknown"),
            EverObserved("model_coverage", C("model_coverage")),
            EverObserved("project_coverage", C("project_coverage")),
            *_sums(*USAGE),
            *_seen("first_event_time_unix_nano", "last_event_time_unix_nano"),
            _position(),
        ),
        columns=(
            "harness",
            "session_id",
            "session_id_prefix",
            "model",
            "project",
            "model_coverage",
            "project_coverage",
            *USAGE,
            "first_event_time_unix_nano",
            "last_event_time_unix_nano",
            "last_source_position",
        ),
    )


def event_inventory() -> Fold:
    return Fold(
        "event_inventory",
        ("harness", "event_family", "tool_bucket", "endpoint_bucket"),
        (
            Count("event_count"),
            *_seen("first_seen_unix_nano", "last_seen_unix_nano"),
            Sum("reported_length_total", C("reported_length")),
            CountIf("length_observed_count", _is("length_coverage", "observed")),
            CountIf("length_unknown_count", _is("length_coverage", "unknown")),
            Sum("duration_milliseconds_total", C("duration_milliseconds")),
            CountIf("duration_observed_count", _is("duration_coverage", "observed")),
            CountIf("duration_unknown_count", _is("duration_coverage", "unknown")),
            *_outcomes(),
            CountIf("session_unknown_count", _is("session_coverage", "unknown")),
            CountIf("token_observed_count", _is("token_coverage", "observed")),
            CountIf("token_unknown_count", _is("token_coverage", "unknown")),
            _position(),
        ),
    )


def session_activity() -> Fold:
    tool = _is("event_family", "tool")
    unknown_fields = sum(
        (
            F.when(_is(column, "unknown"), 1).otherwise(0)
            for column in (
                "session_coverage",
                "length_coverage",
                "duration_coverage",
                "success_state",
                "token_coverage",
            )
        ),
        F.lit(0),
    )
    return Fold(
        "session_activity",
        ("harness", "session_id"),
        (
            Count("event_count"),
            *_seen("first_seen_unix_nano", "last_seen_unix_nano"),
            CountIf("tool_event_count", tool),
            CountIf("shell_command_count", tool & _is("tool_bucket", "shell")),
            CountIf("prompt_count", _is("event_family", "user-prompt")),
            CountIf("response_count", _is("event_family", "assistant-response")),
            CountIf("request_count", C("event_family").isin("api-request", "websocket-request")),
            *_outcomes(),
            Sum("reported_length_total", C("reported_length")),
            *_sums(*USAGE),
            Sum("unknown_field_observations", unknown_fields),
            _position(),
        ),
    )


def request_performance() -> Fold:
    observed = _is("duration_coverage", "observed")
    duration = C("duration_milliseconds")
    return Fold(
        "request_performance",
        ("harness", "session_id", "event_family", "endpoint_bucket"),
        (
            Count("request_count"),
            *_seen("first_seen_unix_nano", "last_seen_unix_nano"),
            *_outcomes(),
            CountIf("duration_observed_count", observed),
            CountIf("duration_unknown_count", ~observed),
            Sum("duration_milliseconds_total", F.when(observed, duration).otherwise(0)),
            *[
                CountIf(f"duration_le_{bound}ms", observed & (duration <= bound))
                for bound in V.LATENCY_BOUNDS
            ],
            CountIf("duration_gt_5000ms", observed & (duration > V.LATENCY_BOUNDS[-1])),
            _position(),
        ),
        where=C("performance_event"),
    )


def request_latency() -> Fold:
    """Observed durations per family as a sketch, for percentiles between the fixed bounds."""
    observed = C("duration_coverage") == "observed"
    return Fold(
        "request_latency",
        ("harness", "event_family"),
        (
            CountIf("duration_observed_count", observed),
            Quantiles("duration_sketch", F.when(observed, C("duration_milliseconds"))),
            _position(),
        ),
        where=C("performance_event"),
    )


def daily_review() -> Fold:
    return Fold(
        "daily_review",
        ("day_utc", "harness"),
        (
            Count("record_count"),
            CountIf("log_count", _is("signal", "log")),
            CountIf("span_count", _is("signal", "span")),
            CountIf("metric_count", _is("signal", "metric")),
            Sum("tool_event_count", C("tool_event")),
            Sum("api_event_count", C("api_event")),
            *_outcomes(),
            Sum("duration_observed_count", C("duration_observed")),
            Sum("duration_milliseconds_total", C("duration_milliseconds")),
            CountIf(
                "duration_gt_5000ms_count",
                (C("duration_observed") == 1) & (C("duration_milliseconds") > V.LATENCY_BOUNDS[-1]),
            ),
            *_sums("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "cost_microusd"),
            Sum("session_unknown_count", C("session_unknown")),
            Sum("identity_metadata_count", C("identity_metadata")),
            Sum("auth_metadata_count", C("auth_metadata")),
            Sum("raw_prompt_content_count", C("raw_prompt_content")),
            Sum("raw_tool_content_count", C("raw_tool_content")),
            Sum("risky_action_count", C("risky_action")),
            *_seen("first_event_time_unix_nano", "last_event_time_unix_nano"),
            _position(),
        ),
    )
