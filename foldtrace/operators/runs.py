"""Run lengths per session, computed in position chunks.

A session can hold any share of the records, so its history is never sorted in one
task.  Events are partitioned by (harness, session, position chunk); windows run inside
a chunk, which bounds every task.  Each chunk also yields one summary row: its edges and
its trailing counters.  A window over those few summaries carries the counters from
chunk to chunk, and a join on (harness, session, chunk) brings the carry back to the
events.  A stored ``session_progress`` row enters as one more summary ahead of all
chunks, so continuing a table and building it in one go are the same computation.

Counters that restart use running totals: ``total - total at the last restart``.  Totals
never decrease, so the total at the last restart is a running maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ("harness", "session_id")
CHUNK_POSITIONS = 1 << 20
PRIOR_CHUNK = -1
C = F.col


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def chunk_states(events: DataFrame, chunk: int = CHUNK_POSITIONS) -> DataFrame:
    """Events with their counters counted from the start of their chunk."""
    order = Window.partitionBy(*SESSION, "_chunk").orderBy("source_position")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    observed = C("progress_coverage") == "observed"
    frame = events.withColumn("_chunk", F.expr(f"source_position div {chunk}"))
    frame = frame.withColumns(
        {
            "_n": F.row_number().over(order).cast("bigint"),
            "_action_before": F.lag("action_fingerprint").over(order),
            "_progress_before": F.lag("progress_fingerprint").over(order),
            "_edge_action": F.first("action_fingerprint").over(running),
            "_edge_progress": F.first("progress_fingerprint").over(running),
            "_edge_observed": F.first(observed).over(running),
            "_edge_time": F.first("event_time_unix_nano").over(running),
            "_fails": F.sum(_flag(~C("success"))).over(running),
        }
    )
    inner = C("_n") > 1
    same = inner & observed & (C("progress_fingerprint") == C("_progress_before"))
    frame = frame.withColumns(
        {
            "_break": inner & (C("action_fingerprint") != C("_action_before")),
            "_same": same,
            "_reset": inner & observed & ~same,
        }
    )
    frame = frame.withColumns(
        {
            "_break_n": F.max(F.when(C("_break"), C("_n"))).over(running),
            "_sames": F.sum(_flag(C("_same"))).over(running),
            "_fails_at_success": F.max(F.when(C("success"), C("_fails"))).over(running),
            "_reset_time": F.last(F.when(C("_reset"), C("event_time_unix_nano")), ignorenulls=True).over(running),
        }
    )
    return frame.withColumn("_sames_at_reset", F.max(F.when(C("_reset"), C("_sames"))).over(running)).select(
        *events.columns,
        "_chunk",
        "_n",
        "_edge_action",
        "_edge_progress",
        "_edge_observed",
        "_edge_time",
        C("_break_n").isNotNull().alias("_broke"),
        F.coalesce(C("_n") - C("_break_n") + 1, C("_n")).alias("_run"),
        C("_sames_at_reset").isNotNull().alias("_was_reset"),
        (C("_sames") - F.coalesce("_sames_at_reset", F.lit(0))).alias("_same_run"),
        C("_fails_at_success").isNotNull().alias("_succeeded"),
        (C("_fails") - F.coalesce("_fails_at_success", F.lit(0))).alias("_fail_run"),
        "_reset_time",
    )


SUMMARY = (
    "source_position",
    "event_time_unix_nano",
    "action_fingerprint",
    "progress_fingerprint",
    "_n",
    "_edge_action",
    "_edge_progress",
    "_edge_observed",
    "_edge_time",
    "_broke",
    "_run",
    "_was_reset",
    "_same_run",
    "_succeeded",
    "_fail_run",
    "_reset_time",
)


def chunk_summaries(states: DataFrame, shared: tuple[str, ...] = ()) -> DataFrame:
    """Last state of every chunk; the grouping keys are the partitioning already in place.

    ``shared`` names event columns another branch over the same states reads.  Carrying
    them here gives both branches the same shuffle, which Spark then runs once.
    """
    return (
        states.groupBy(*SESSION, "_chunk")
        .agg(F.max_by(F.struct(*SUMMARY, *shared), "source_position").alias("_s"))
        .select(*SESSION, "_chunk", *[C(f"_s.{name}").alias(name) for name in SUMMARY])
    )


def _prior_summaries(progress: DataFrame) -> DataFrame:
    """Stored sessions in the shape of a summary that restarts every counter."""
    return progress.select(
        *SESSION,
        F.lit(PRIOR_CHUNK).cast("bigint").alias("_chunk"),
        C("last_source_position").alias("source_position"),
        C("last_activity_unix_nano").alias("event_time_unix_nano"),
        "action_fingerprint",
        "progress_fingerprint",
        C("total_actions").alias("_n"),
        C("action_fingerprint").alias("_edge_action"),
        C("progress_fingerprint").alias("_edge_progress"),
        F.lit(True).alias("_edge_observed"),
        C("first_activity_unix_nano").alias("_edge_time"),
        F.lit(True).alias("_broke"),
        C("repeat_count").alias("_run"),
        F.lit(True).alias("_was_reset"),
        C("no_progress_count").alias("_same_run"),
        F.lit(True).alias("_succeeded"),
        C("consecutive_failures").alias("_fail_run"),
        C("last_distinct_progress_unix_nano").alias("_reset_time"),
    )


def carry_over(summaries: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Summaries with counters at the end of each chunk and the carry into it."""
    if prior is not None:
        summaries = summaries.unionByName(_prior_summaries(prior))
    order = Window.partitionBy(*SESSION).orderBy("_chunk")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = summaries.withColumns(
        {
            "_last_action": F.lag("action_fingerprint").over(order),
            "_last_progress": F.lag("progress_fingerprint").over(order),
        }
    )
    fresh = C("_last_action").isNull()
    stored = C("_chunk") == PRIOR_CHUNK
    edge_same = ~fresh & C("_edge_observed") & (C("_edge_progress") == C("_last_progress"))
    frame = frame.withColumns(
        {
            "_edge_break": fresh | (C("_edge_action") != C("_last_action")),
            "_edge_same": edge_same,
            "_edge_reset": ~stored & C("_edge_observed") & ~edge_same,
        }
    )
    frame = frame.withColumns(
        {
            "_tail_run": C("_run"),
            "_tail_same": C("_same_run") + _flag(C("_edge_same") & ~C("_was_reset")),
            "_tail_fail": C("_fail_run"),
            "_distinct_here": F.coalesce(
                "_reset_time", F.when(C("_edge_reset") | fresh, C("_edge_time"))
            ),
        }
    )
    tails = ("_tail_run", "_tail_same", "_tail_fail")
    frame = frame.withColumns({f"_total{tail}": F.sum(tail).over(running) for tail in tails})
    restarts = {
        "_tail_run": C("_broke") | C("_edge_break"),
        "_tail_same": C("_was_reset") | C("_edge_reset"),
        "_tail_fail": C("_succeeded"),
    }
    frame = frame.withColumns(
        {
            f"_base{tail}": F.max(F.when(test, C(f"_total{tail}") - C(tail))).over(running)
            for tail, test in restarts.items()
        }
    )
    frame = frame.withColumns(
        {
            "repeat_count": C("_total_tail_run") - F.coalesce("_base_tail_run", F.lit(0)),
            "no_progress_count": C("_total_tail_same") - F.coalesce("_base_tail_same", F.lit(0)),
            "consecutive_failures": C("_total_tail_fail") - F.coalesce("_base_tail_fail", F.lit(0)),
            "total_actions": F.sum("_n").over(running),
            "last_distinct_progress_unix_nano": F.last("_distinct_here", ignorenulls=True).over(running),
            "first_activity_unix_nano": F.first("_edge_time").over(running),
        }
    )
    carried = ("repeat_count", "no_progress_count", "consecutive_failures", "last_distinct_progress_unix_nano")
    return frame.withColumns(
        {
            **{f"_in_{name}": F.lag(name).over(order) for name in carried},
            "_is_last": F.lead("_chunk").over(order).isNull(),
        }
    )


def session_progress(carry: DataFrame) -> DataFrame:
    """State of every session after its last event."""
    return carry.where("_is_last").select(
        *SESSION,
        "first_activity_unix_nano",
        C("event_time_unix_nano").alias("last_activity_unix_nano"),
        "last_distinct_progress_unix_nano",
        "action_fingerprint",
        "progress_fingerprint",
        "repeat_count",
        "no_progress_count",
        "consecutive_failures",
        "total_actions",
        C("source_position").alias("last_source_position"),
    )


def event_counters(states: DataFrame, carry: DataFrame) -> DataFrame:
    """Every event with its session counters at that event."""
    edges = carry.where(C("_chunk") != PRIOR_CHUNK).select(
        *SESSION,
        "_chunk",
        "first_activity_unix_nano",
        "_edge_break",
        "_edge_same",
        "_edge_reset",
        C("_edge_time").alias("_chunk_time"),
        "_in_repeat_count",
        "_in_no_progress_count",
        "_in_consecutive_failures",
        "_in_last_distinct_progress_unix_nano",
    )
    joined = states.join(edges, [*SESSION, "_chunk"])

    def carried(name: str) -> Column:
        return F.coalesce(f"_in_{name}", F.lit(0))

    return joined.withColumns(
        {
            "repeat_count": C("_run")
            + F.when(C("_broke") | C("_edge_break"), 0).otherwise(carried("repeat_count")),
            "no_progress_count": C("_same_run")
            + F.when(C("_was_reset") | C("_edge_reset"), 0).otherwise(
                carried("no_progress_count") + _flag(C("_edge_same"))
            ),
            "consecutive_failures": C("_fail_run")
            + F.when(C("_succeeded"), 0).otherwise(carried("consecutive_failures")),
            "last_distinct_progress_unix_nano": F.coalesce(
                "_reset_time",
                F.when(C("_edge_reset"), C("_chunk_time")),
                "_in_last_distinct_progress_unix_nano",
                "first_activity_unix_nano",
            ),
        }
    )
