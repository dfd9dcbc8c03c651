"""Guard action view: what was done, to what, with what evidence that it was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.values import Value
from .record_view import RecordView, coverage, covered_text, finish

KEYS = [
    *V.TOOL_KEYS,
    *V.GUARD_TARGET_KEYS,
    *V.SUCCESS_KEYS,
    *V.COMMAND_KEYS,
    *V.ARGUMENT_KEYS,
    *V.FAILURE_KEYS,
    *V.GUARD_MODEL_KEYS,
    *V.PROJECT_KEYS,
    "argument_digest",
    "operation_kind",
    "progress_fingerprint",
]


def unredacted(value: Value) -> Column:
    return value.filled & F.coalesce(value.text != V.REDACTED, F.lit(False))


def retained(value: Value, failed: Column) -> Column:
    """Payload text kept only for failed actions, bounded."""
    kept = F.when(failed & value.exists, F.substring(value.text, 1, V.DETAIL_CHARS))
    return F.coalesce(kept, F.lit(""))


def normalize(records: DataFrame) -> DataFrame:
    view = RecordView(records, KEYS)
    attrs = view.attrs
    tool = attrs.first_truthy(V.TOOL_KEYS)
    target = attrs.first_truthy(V.GUARD_TARGET_KEYS)
    success = attrs.first_existing(V.SUCCESS_KEYS)
    progress = attrs["progress_fingerprint"]
    operation = attrs["operation_kind"]
    digest = attrs["argument_digest"]
    fallback_digest = F.col("content_digest") if "content_digest" in records.columns else F.lit("")
    frame = view.frame.withColumns(
        {
            "_tool": F.when(tool.filled, F.lower(tool.text)),
            "_target": F.when(unredacted(target), target.text),
            "_success": F.when(success.exists, success.is_true),
            "_operation": F.when(operation.truthy, operation.text).otherwise("tool"),
            "_progress": F.when(unredacted(progress), progress.text),
        }
    )
    tool_known = F.col("_tool").isNotNull()
    target_known = F.col("_target").isNotNull()
    progress_known = F.col("_progress").isNotNull()
    failed = ~F.col("_success")
    session_known = view.session_known
    absent, observed, unseen = V.TOOL_REASONS
    tool_reason = F.when(~session_known, absent).when(tool_known, observed).otherwise(unseen)
    target_reason = F.when(target_known, V.TARGET_REASONS[0]).otherwise(V.TARGET_REASONS[1])
    tool_coverage = coverage(session_known & tool_known)
    unknown = F.lit("unknown")
    return finish(
        frame,
        view.is_tool & view.has_time,
        [],
        {
            "harness": F.col("harness"),
            "session_id": F.col("session_id"),
            "session_id_prefix": F.substring("session_id", 1, V.SESSION_PREFIX_CHARS),
            "project": covered_text(attrs.first_existing(V.PROJECT_KEYS), chars=V.PROJECT_CHARS),
            "model": covered_text(attrs.first_existing(V.GUARD_MODEL_KEYS), chars=V.MODEL_CHARS),
            "kind": F.lit("tool-activity"),
            "operation_kind": F.col("_operation"),
            "tool": F.col("_tool"),
            "target": F.col("_target"),
            "command": retained(attrs.first_existing(V.COMMAND_KEYS), failed),
            "tool_arguments": retained(attrs.first_existing(V.ARGUMENT_KEYS), failed),
            "failure_detail": retained(attrs.first_existing(V.FAILURE_KEYS), failed),
            "argument_digest": F.when(digest.exists, digest.text).otherwise(fallback_digest),
            "success": F.col("_success"),
            "event_time_unix_nano": F.col("_time"),
            "action_fingerprint": F.concat_ws(
                "|",
                "harness",
                "session_id",
                "_operation",
                F.coalesce("_tool", unknown),
                F.coalesce("_target", unknown),
            ),
            "progress_fingerprint": F.coalesce("_progress", unknown),
            "progress_coverage": coverage(progress_known),
            "source_position": F.col("position"),
            "tool_coverage": tool_coverage,
            "target_coverage": coverage(target_known),
            "coverage_reason": F.when(tool_coverage != "observed", tool_reason)
            .when(~target_known, target_reason)
            .otherwise(V.COVERED_REASON),
            "tool_coverage_reason": tool_reason,
            "target_coverage_reason": target_reason,
            "progress_coverage_reason": F.when(progress_known, V.PROGRESS_REASONS[0]).otherwise(
                V.PROGRESS_REASONS[1]
            ),
        },
    )
