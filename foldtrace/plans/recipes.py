"""Canned analytic recipes over the app tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.addresses import is_local, is_single_label, plain_host
from ..operators.folds import quantile

C = F.col
NANOS_PER_DAY = 86_400_000_000_000
MICROUSD_PER_USD = 1_000_000.0
PERCENTILES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def dollars(microusd: Column) -> Column:
    return microusd.cast("double") / F.lit(MICROUSD_PER_USD)


def totals(frame: DataFrame, keys: list[str], sums: dict[str, str], **more: Column) -> DataFrame:
    """Sums of columns by keys, ``sums`` mapping result names to columns; ``more`` are other aggregates."""
    return frame.groupBy(*keys).agg(
        *[F.sum(column).alias(name) for name, column in sums.items()], *[value.alias(name) for name, value in more.items()]
    )


def _same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


def latest_day(daily: DataFrame) -> DataFrame:
    """The most recent day of the review, a row per harness."""
    newest = daily.agg(F.max("day_utc").alias("newest"))  # one row
    rows = daily.join(F.broadcast(newest), C("day_utc") == C("newest"))
    return rows.select(
        "harness",
        "record_count",
        "failure_count",
        C("duration_gt_5000ms_count").alias("slow_events"),
        dollars(C("cost_microusd")).alias("cost_usd"),
        "risky_action_count",
    )


def coverage_rollup(inventory: DataFrame) -> DataFrame:
    """How often each measure was missing, per harness and family."""
    unknown = {f"{measure}_unknown": f"{measure}_unknown_count" for measure in ("length", "duration", "outcome", "session", "token")}
    return totals(inventory, ["harness", "event_family"], {"events": "event_count", **unknown})


def cache_efficiency(activity: DataFrame) -> DataFrame:
    """Share of input tokens served from cache, per harness and day of last activity."""
    dated = activity.withColumn("unix_day", F.expr(f"CAST(last_seen_unix_nano AS BIGINT) div {NANOS_PER_DAY}"))
    fresh, cached = F.sum("input_tokens"), F.sum("cached_input_tokens")
    return totals(
        dated,
        ["harness", "unix_day"],
        _same("input_tokens", "cached_input_tokens", "output_tokens"),
        cache_percent=F.when(fresh + cached != 0, F.lit(100.0) * cached / (fresh + cached)),
        cost_usd=dollars(F.sum("cost_microusd")),
    )


def tool_outcomes(inventory: DataFrame) -> DataFrame:
    """Calls by tool with their outcomes, most called first."""
    outcomes = {"calls": "event_count", "successes": "success_count", "failures": "failure_count", "outcome_unknown": "outcome_unknown_count"}
    rows = totals(inventory.where(C("event_family") == "tool"), ["harness", "tool_bucket"], outcomes)
    return rows.orderBy(C("calls").desc(), "harness", "tool_bucket")


def latency_buckets(performance: DataFrame) -> DataFrame:
    """Cumulative latency counts per endpoint."""
    bounds = ("le_100ms", "le_500ms", "le_1000ms", "le_5000ms", "gt_5000ms")
    sums = {"requests": "request_count", **{f"duration_{state}": f"duration_{state}_count" for state in ("observed", "unknown")}}
    sums |= {bound: f"duration_{bound}" for bound in bounds}
    return totals(performance, ["harness", "event_family", "endpoint_bucket"], sums)


TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")


def usage_by_session(cost: DataFrame) -> DataFrame:
    """Sessions by cost, dearest first."""
    rows = cost.select("harness", "session_id", *TOKENS, dollars(C("cost_microusd")).alias("cost_usd"), "last_event_time_unix_nano")
    return rows.orderBy(C("cost_usd").desc(), "harness", "session_id")


def usage_by_harness(cost: DataFrame) -> DataFrame:
    return totals(cost, ["harness"], _same(*TOKENS), cost_usd=dollars(F.sum("cost_microusd")))


def cost_by_model(detail: DataFrame) -> DataFrame:
    keys = ["harness", "model", "project", "model_coverage", "project_coverage"]
    return totals(detail, keys, _same(*TOKENS[:3]), cost_usd=dollars(F.sum("cost_microusd")))


def session_labels(detail: DataFrame) -> DataFrame:
    span = [f"{end}_event_time_unix_nano" for end in ("first", "last")]
    return detail.select("harness", "session_id_prefix", *span, "project", "model", dollars(C("cost_microusd")).alias("cost_usd"))


def guard_cost(progress: DataFrame, cost: DataFrame) -> DataFrame:
    """Actions, tokens and cost of the sessions that both apps know."""
    key = ["harness", "session_id"]
    actions = progress.select(*key, "total_actions", "consecutive_failures", "no_progress_count")
    return actions.join(cost.select(*key, *TOKENS, "cost_microusd"), key).orderBy(*key)


def coverage_by_capability(coverage: DataFrame) -> DataFrame:
    """What each harness was seen to report, and since when."""
    seen = [f"{end}_seen_unix_nano" for end in ("first", "last")]
    return coverage.select("harness", "capability", "state", "reason", *seen, "last_source_position").orderBy("harness", "capability")


def stalled_sessions(progress: DataFrame, before_nanos: str) -> DataFrame:
    """Sessions whose last distinct progress lies before a time."""
    stalled = progress.where(C("last_distinct_progress_unix_nano") < F.lit(before_nanos))
    return stalled.select("harness", "session_id", *[f"last_{what}_unix_nano" for what in ("activity", "distinct_progress")], "total_actions")


def urls_due(observations: DataFrame, verdicts: DataFrame, provider: str, now_nanos: str) -> DataFrame:
    """Observed URLs without a verdict of the provider that is still valid.

    The context columns of the latest observation come along.
    """
    valid = verdicts.where((C("provider") == provider) & (C("valid_until_unix_nano").cast("bigint") > F.lit(int(now_nanos))))
    due = observations.join(valid.select("observed_full"), "observed_full", "left_anti")
    context = [f"latest_{name}" for name in ("tool_name", "project", "harness", "session_id_prefix")]
    return due.select("observed_full", "host", "last_observed_unix_nano", *[name for name in context if name in due.columns])


def due_listing(observations: DataFrame, verdicts: DataFrame, provider: str, now_nanos: str) -> DataFrame:
    """``urls_due``, those observed longest ago first."""
    return urls_due(observations, verdicts, provider, now_nanos).orderBy("last_observed_unix_nano", "observed_full")


def enabled_exclusions(exclusions: DataFrame) -> DataFrame:
    rows = exclusions.where(C("enabled") == 1).select("exclusion_id", "kind", "pattern", "updated_unix_nano")
    return rows.orderBy("kind", "pattern", "exclusion_id")


def failed_commands(failures: DataFrame) -> DataFrame:
    """What the failing tools were asked to do, newest first."""
    action = ("project", "model", "tool", "command", "tool_arguments", "target", "failure_detail", "detail_coverage")
    return failures.orderBy(C("source_position").desc()).select("event_time_unix_nano", "harness", "session_id_prefix", *action)


def loop_evidence(loops: DataFrame) -> DataFrame:
    counts = ("repeat_count", "consecutive_failures", "no_progress_count")
    seen = [f"{end}_observed_unix_nano" for end in ("first", "last")]
    return loops.orderBy(C("source_position").desc()).select(*seen, "harness", "session_id", "finding_kind", *counts, "evidence")


def daily_listing(daily: DataFrame) -> DataFrame:
    """The review by day, newest first, with cost in dollars."""
    rows = daily.orderBy(C("day_utc").desc(), "harness")
    counts = ("record", "tool_event", "api_event", "failure", "duration_gt_5000ms")
    exposed = ("identity_metadata", "auth_metadata", "raw_prompt_content", "raw_tool_content", "risky_action")
    return rows.select(
        "day_utc", "harness", *[f"{name}_count" for name in counts], *TOKENS, dollars(C("cost_microusd")).alias("cost_usd"),
        *[f"{name}_count" for name in exposed],
    )


def latency_summary(performance: DataFrame) -> DataFrame:
    """Average and bucket-resolution P95 of observed durations.

    The table holds cumulative counts at fixed bounds, so P95 is the first bound that
    covers 95 percent of the observed requests, NULL when it lies above the last bound.
    """
    bounds = (100, 500, 1000, 5000)
    totals = performance.groupBy("harness", "event_family").agg(
        F.sum("duration_observed_count").alias("observed"),
        F.sum("duration_milliseconds_total").alias("_total"),
        *[F.sum(f"duration_le_{bound}ms").alias(f"_le_{bound}") for bound in bounds],
    )
    needed = C("observed") * 95
    p95 = F.coalesce(*[F.when(C(f"_le_{bound}") * 100 >= needed, bound) for bound in bounds]).cast("bigint")
    return totals.select(
        "harness",
        "event_family",
        "observed",
        F.when(C("observed") > 0, C("_total") / C("observed")).alias("average_ms"),
        F.when(C("observed") > 0, p95).alias("p95_bound_ms"),
    )


def latency_percentiles(latency: DataFrame, shares: Mapping[str, float] = PERCENTILES) -> DataFrame:
    """Percentiles of observed durations from the sketches of ``request_latency``."""
    found = {name: quantile(C("duration_sketch"), share) for name, share in shares.items()}
    return latency.select("harness", "event_family", C("duration_observed_count").alias("observed"), *[c.alias(n) for n, c in found.items()])


def _suffixes(host: Column) -> Column:
    """The host and everything of it after a label dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def builtin_excluded(host: Column) -> dict[str, Column]:
    """Rules whose pattern is a word for a class of hosts rather than a host."""
    return {"loopback-or-private-ip-literal": is_local(host), "single-label-host": is_single_label(host)}


def enforce_exclusions(due: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Due URLs that no enabled exclusion covers.

    A URL has the tokens a rule could name: its host, the classes of its host, every suffix of
    the host in whole labels, and the URL cut at each length that a prefix rule has.  Tokens meet
    rules by key, so neither side has to be small, and each URL is read once.
    """
    active = exclusions.where(C("enabled") == 1)
    bare = F.regexp_replace(plain_host(C("pattern")), r"^\.+", "")
    # A suffix covers whole labels, written with or without the leading dot.
    key = F.when(C("kind") == "host-suffix", bare).when(C("kind") == "host-exact", plain_host(C("pattern"))).otherwise(C("pattern"))
    rules = active.select(C("kind").alias("_kind"), key.alias("_key")).where("_key <> ''").distinct()
    lengths = rules.where(C("_kind") == "url-prefix").agg(F.collect_set(F.length("_key")).alias("_lengths"))  # one row
    token = lambda kind: lambda key: F.struct(F.lit(kind).alias("_kind"), key.alias("_key"))
    host = F.coalesce(plain_host(C("host")), F.lit(""))
    named = F.array(host, *[F.when(test, name) for name, test in builtin_excluded(C("host")).items()])
    cuts = F.transform(F.filter("_lengths", lambda n: n <= F.length("observed_full")), lambda n: F.substring("observed_full", F.lit(1), n))
    tokens = F.concat(
        F.transform(F.array_compact(named), token("host-exact")), F.transform(_suffixes(host), token("host-suffix")), F.transform(cuts, token("url-prefix"))
    )
    columns = due.columns
    # The token without a key keeps URLs that have no other.
    listed = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("_kind"), F.lit(None).cast("string").alias("_key"))), tokens)
    held = due.crossJoin(F.broadcast(lengths)).select(*columns, F.inline(F.array_distinct(listed)))
    met = held.join(rules.withColumn("_met", F.lit(True)), ["_kind", "_key"], "left")
    return met.groupBy(*columns).agg(F.bool_or(F.coalesce("_met", F.lit(False))).alias("_blocked")).where(~C("_blocked")).select(*columns)
