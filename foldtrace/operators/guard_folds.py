"""Guard tables: session progress, coverage, policy findings, loop findings, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.values import pack_nanos, unpack_nanos
from . import runs
from .folds import latest_rows

C = F.col


def unseen() -> Column:
    """Tool or target needed by the policy was not observed."""
    return (C("tool_coverage") != "observed") | (C("target_coverage") != "observed")


def rule_of() -> Column:
    """First policy rule that applies, NULL when none does."""
    outside = (C("target_coverage") == "observed") & C("target").startswith(V.OUTSIDE_TARGET_PREFIX)
    return (
        F.when(C("tool").isin(*V.DENIED_TOOLS), "denied-tool")
        .when(C("operation_kind").isin(*V.DENIED_OPERATIONS), "denied-operation")
        .when(outside, "target-boundary")
        .when(unseen(), "insufficient-telemetry")
    )


def policy_rows(events: DataFrame) -> DataFrame:
    """One finding per event that breaks a rule."""
    insufficient = C("rule_id") == "insufficient-telemetry"
    summary = None
    for rule, text in V.RULE_SUMMARIES.items():
        summary = F.when(C("rule_id") == rule, text) if summary is None else summary.when(C("rule_id") == rule, text)
    evidence = F.struct("tool", "operation_kind", "target", "argument_digest", "coverage_reason")
    return (
        events.withColumn("rule_id", rule_of())
        .where(C("rule_id").isNotNull())
        .select(
            F.when(insufficient, F.concat_ws("|", F.lit("policy"), "rule_id", "harness", "session_id"))
            .otherwise(
                F.concat_ws("|", F.lit("policy"), "harness", "session_id", C("source_position").cast("string"))
            )
            .alias("finding_id"),
            "rule_id",
            F.when(insufficient, "unknown").otherwise("high").alias("severity"),
            "harness",
            "session_id",
            "source_position",
            C("event_time_unix_nano").alias("observed_unix_nano"),
            summary.alias("summary"),
            F.to_json(evidence, {"ignoreNullFields": "false"}).alias("evidence"),
            F.when(unseen(), "unknown").otherwise("observed").alias("coverage_state"),
        )
    )


def policy_violations(events: DataFrame) -> DataFrame:
    """Findings keyed by position: new events only ever add rows."""
    return policy_rows(events).where(C("rule_id") != "insufficient-telemetry")


def policy_gaps(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Latest insufficient-telemetry finding per session."""
    rows = policy_rows(events.where(unseen())).where(C("rule_id") == "insufficient-telemetry")
    return latest_rows(rows, ["finding_id"], C("source_position"), prior)


def policy_findings(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    gap = C("rule_id") == "insufficient-telemetry"
    fresh = policy_violations(events)
    if prior is None:
        return fresh.unionByName(policy_gaps(events))
    return fresh.unionByName(prior.where(~gap)).unionByName(policy_gaps(events, prior.where(gap)))


def telemetry_coverage(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Latest state per harness and capability.

    Every event reports all three capabilities, so they share first and last; the reasons
    are drawn from short fixed lists and travel through the aggregation as their index.
    """
    lists = (V.TOOL_REASONS, V.TARGET_REASONS, V.PROGRESS_REASONS)
    reasons = ("tool_coverage_reason", "target_coverage_reason", "progress_coverage_reason")
    order = C("source_position")

    def code(reason: str, texts: tuple[str, ...]) -> Column:
        return F.array_position(F.array(*[F.lit(text) for text in texts]), C(reason)).cast("int")

    coded = events.select(
        "harness",
        "source_position",
        pack_nanos(C("event_time_unix_nano")).alias("_t"),
        *[code(reason, texts).alias(f"_{reason}") for reason, texts in zip(reasons, lists)],
    )
    totals = coded.groupBy("harness").agg(
        F.min_by("_t", order).alias("_first"),
        F.max_by("_t", order).alias("_last"),
        F.max(order).alias("last_source_position"),
        *[F.max_by(f"_{reason}", order).alias(f"_{reason}") for reason in reasons],
    )
    observed = {V.TOOL_REASONS[1], V.TARGET_REASONS[0], V.PROGRESS_REASONS[0]}
    entries = [
        F.struct(
            F.lit(capability).alias("capability"),
            F.element_at(F.array(*[F.lit(text) for text in texts]), C(f"_{reason}")).alias("reason"),
        )
        for capability, reason, texts in zip(V.CAPABILITIES, reasons, lists)
    ]
    rows = totals.select("*", F.inline(F.array(*entries))).select(
        "harness",
        "capability",
        F.when(C("reason").isin(*observed), "observed").otherwise("unknown").alias("state"),
        "reason",
        unpack_nanos(C("_first")).alias("first_seen_unix_nano"),
        unpack_nanos(C("_last")).alias("last_seen_unix_nano"),
        "last_source_position",
    )
    if prior is None:
        return rows
    merged = latest_rows(rows, ["harness", "capability"], C("last_source_position"), prior)
    started = prior.select("harness", "capability", C("first_seen_unix_nano").alias("_started"))
    return merged.join(started, ["harness", "capability"], "left").select(
        "harness",
        "capability",
        "state",
        "reason",
        F.coalesce("_started", "first_seen_unix_nano").alias("first_seen_unix_nano"),
        "last_seen_unix_nano",
        "last_source_position",
    )


def tool_failure_detail(events: DataFrame) -> DataFrame:
    """Failed actions, keyed by position, with how much of the failure was reported."""
    has_command = C("command") != ""
    has_detail = C("failure_detail") != ""
    target = F.coalesce("target", F.lit(""))
    some = has_command | has_detail | (C("tool_arguments") != "") | (target != "")
    return events.where(~C("success")).select(
        "source_position",
        "event_time_unix_nano",
        "harness",
        "session_id",
        "session_id_prefix",
        "project",
        "model",
        F.coalesce("tool", F.lit("unknown")).alias("tool"),
        "command",
        "tool_arguments",
        target.alias("target"),
        "failure_detail",
        F.when(has_command & has_detail, "observed").when(some, "partial").otherwise("unknown").alias("detail_coverage"),
    )


def loop_kind() -> Column:
    bound = V.LOOP_THRESHOLD
    return (
        F.when(C("consecutive_failures") >= bound, "repeated-failure")
        .when(C("repeat_count") >= bound, "repeated-action")
        .when(C("no_progress_count") >= bound, "bounded-no-progress")
    )


def loop_rows(counters: DataFrame) -> DataFrame:
    """Events that stand in a loop, as findings."""
    evidence = F.struct(
        "action_fingerprint",
        F.when(unseen(), "degraded").otherwise("observed").alias("action_fingerprint_coverage"),
        C("coverage_reason").alias("action_fingerprint_reason"),
        "progress_fingerprint",
        "progress_coverage",
        "last_distinct_progress_unix_nano",
    )
    return (
        counters.withColumn("finding_kind", loop_kind())
        .where(C("finding_kind").isNotNull())
        .select(
            F.concat_ws("|", F.lit("loop"), "finding_kind", "harness", "session_id").alias("finding_id"),
            "finding_kind",
            "harness",
            "session_id",
            "source_position",
            C("first_activity_unix_nano").alias("first_observed_unix_nano"),
            C("event_time_unix_nano").alias("last_observed_unix_nano"),
            "repeat_count",
            "consecutive_failures",
            "no_progress_count",
            F.to_json(evidence).alias("evidence"),
        )
    )


def session_tables(
    events: DataFrame,
    prior_progress: DataFrame | None = None,
    prior_loops: DataFrame | None = None,
    chunk: int = runs.CHUNK_POSITIONS,
) -> tuple[DataFrame, DataFrame]:
    """``session_progress`` and ``loop_findings`` from one pass of chunk states."""
    shared = ("tool_coverage", "target_coverage", "coverage_reason")
    kept = [
        "harness",
        "session_id",
        "source_position",
        "event_time_unix_nano",
        "action_fingerprint",
        "progress_fingerprint",
        "progress_coverage",
        "success",
    ]
    states = runs.chunk_states(events.select(*kept, *shared), chunk)
    carry = runs.carry_over(runs.chunk_summaries(states, shared), prior_progress)
    loops = latest_rows(
        loop_rows(runs.event_counters(states, carry)), ["finding_id"], C("source_position"), prior_loops
    )
    return runs.session_progress(carry), loops
