"""Registered queries of the folded tables (F) and the recipes over them (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import app_folds, guard_folds
from ..plans import recipes
from . import oracle_base as O
from .inputs import conversation_records, event_records, events_of, tables_of

C = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE[name] = oracle


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in ctes) + "\n"


def table(app: str, name: str):
    return lambda spark, directory: tables_of(spark, directory, app)[name]


FIRST_LAST = """arg_min(struct_pack(v := t), position).v AS first_seen_unix_nano,
  arg_max(struct_pack(v := t), position).v AS last_seen_unix_nano"""
OUTCOMES = """count(*) FILTER (success_state = 'success') AS success_count,
  count(*) FILTER (success_state = 'failure') AS failure_count,
  count(*) FILTER (success_state = 'unknown') AS outcome_unknown_count"""
TOKENS = """CAST(sum(COALESCE(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(COALESCE(output_tokens, 0)) AS BIGINT) AS output_tokens,
  CAST(sum(COALESCE(cached, 0)) AS BIGINT) AS cached_input_tokens, CAST(sum(COALESCE(reasoning, 0)) AS BIGINT) AS reasoning_output_tokens,
  CAST(sum(cost) AS BIGINT) AS cost_microusd"""

SIGNAL_COUNTS = f"""signal_counts AS (
  SELECT source, signal, name AS event_name, count(*) AS event_count, {FIRST_LAST}, max(position) AS last_source_position
  FROM rec GROUP BY ALL)"""
SESSION_COST = f"""session_cost AS (
  SELECT harness, session_id, {TOKENS}, arg_max(t, position) AS last_event_time_unix_nano, max(position) AS last_source_position
  FROM usage GROUP BY harness, session_id)"""
SESSION_COST_DETAIL = f"""session_cost_detail AS (
  SELECT harness, session_id, left(session_id, 12) AS session_id_prefix, COALESCE(model, 'unknown') AS model,
    COALESCE(arg_max(project, position) FILTER (project IS NOT NULL), 'unknown') AS project,
    CASE WHEN COALESCE(model, 'unknown') <> 'unknown' THEN 'observed' ELSE 'unknown' END AS model_coverage,
    CASE WHEN count(project) > 0 THEN 'observed' ELSE 'unknown' END AS project_coverage, {TOKENS},
    arg_min(t, position) AS first_event_time_unix_nano, arg_max(t, position) AS last_event_time_unix_nano,
    max(position) AS last_source_position
  FROM usage u GROUP BY harness, session_id, COALESCE(u.model, 'unknown'))"""
SESSION_COST_DETAIL = SESSION_COST_DETAIL.replace(
    "COALESCE(model, 'unknown')", "COALESCE(u.model, 'unknown')"
)
EVENT_INVENTORY = f"""event_inventory AS (
  SELECT harness, event_family, tool_bucket, endpoint_bucket, count(*) AS event_count, {FIRST_LAST},
    CAST(sum(reported_length) AS BIGINT) AS reported_length_total,
    count(*) FILTER (length_coverage = 'observed') AS length_observed_count,
    count(*) FILTER (length_coverage = 'unknown') AS length_unknown_count,
    CAST(sum(duration_milliseconds) AS BIGINT) AS duration_milliseconds_total,
    count(*) FILTER (duration_coverage = 'observed') AS duration_observed_count,
    count(*) FILTER (duration_coverage = 'unknown') AS duration_unknown_count, {OUTCOMES},
    count(*) FILTER (session_coverage = 'unknown') AS session_unknown_count,
    count(*) FILTER (token_coverage = 'observed') AS token_observed_count,
    count(*) FILTER (token_coverage = 'unknown') AS token_unknown_count, max(position) AS last_source_position
  FROM activity GROUP BY harness, event_family, tool_bucket, endpoint_bucket)"""
SESSION_ACTIVITY = f"""session_activity AS (
  SELECT harness, session_id, count(*) AS event_count, {FIRST_LAST},
    count(*) FILTER (event_family = 'tool') AS tool_event_count,
    count(*) FILTER (event_family = 'tool' AND tool_bucket = 'shell') AS shell_command_count,
    count(*) FILTER (event_family = 'user-prompt') AS prompt_count,
    count(*) FILTER (event_family = 'assistant-response') AS response_count,
    count(*) FILTER (event_family IN ('api-request', 'websocket-request')) AS request_count, {OUTCOMES},
    CAST(sum(reported_length) AS BIGINT) AS reported_length_total, {TOKENS},
    CAST(sum(CAST(session_coverage = 'unknown' AS INT) + CAST(length_coverage = 'unknown' AS INT)
      + CAST(duration_coverage = 'unknown' AS INT) + CAST(success_state = 'unknown' AS INT)
      + CAST(token_coverage = 'unknown' AS INT)) AS BIGINT) AS unknown_field_observations,
    max(position) AS last_source_position
  FROM activity GROUP BY harness, session_id)"""
_D = "count(*) FILTER (duration_coverage = 'observed' AND duration_milliseconds {})"
REQUEST_PERFORMANCE = f"""request_performance AS (
  SELECT harness, session_id, event_family, endpoint_bucket, count(*) AS request_count, {FIRST_LAST}, {OUTCOMES},
    count(*) FILTER (duration_coverage = 'observed') AS duration_observed_count,
    count(*) FILTER (duration_coverage <> 'observed') AS duration_unknown_count,
    CAST(sum(CASE WHEN duration_coverage = 'observed' THEN duration_milliseconds ELSE 0 END) AS BIGINT) AS duration_milliseconds_total,
    {_D.format('<= 100')} AS duration_le_100ms, {_D.format('<= 500')} AS duration_le_500ms,
    {_D.format('<= 1000')} AS duration_le_1000ms, {_D.format('<= 5000')} AS duration_le_5000ms,
    {_D.format('> 5000')} AS duration_gt_5000ms, max(position) AS last_source_position
  FROM activity WHERE performance_event GROUP BY harness, session_id, event_family, endpoint_bucket)"""
_U = "CAST(sum(CASE WHEN usage_event THEN COALESCE({0}, 0) ELSE 0 END) AS BIGINT) AS {1}"
_S = "CAST(sum({0}) AS BIGINT) AS {1}"
DAILY_REVIEW = f"""daily_review AS (
  SELECT day_utc, harness, count(*) AS record_count, count(*) FILTER (signal = 'log') AS log_count,
    count(*) FILTER (signal = 'span') AS span_count, count(*) FILTER (signal = 'metric') AS metric_count,
    {_S.format('tool_event', 'tool_event_count')}, {_S.format('api_event', 'api_event_count')}, {OUTCOMES},
    count(duration) AS duration_observed_count, CAST(sum(COALESCE(duration, 0)) AS BIGINT) AS duration_milliseconds_total,
    count(*) FILTER (duration > 5000) AS duration_gt_5000ms_count,
    {_U.format('input_tokens', 'input_tokens')}, {_U.format('cached', 'cached_input_tokens')},
    {_U.format('output_tokens', 'output_tokens')}, {_U.format('reasoning', 'reasoning_output_tokens')},
    {_U.format('cost', 'cost_microusd')},
    {_S.format('CAST(NOT session_known AS INT)', 'session_unknown_count')},
    {_S.format('identity_metadata', 'identity_metadata_count')}, {_S.format('auth_metadata', 'auth_metadata_count')},
    {_S.format('raw_prompt_content', 'raw_prompt_content_count')},
    {_S.format('raw_tool_content', 'raw_tool_content_count')}, {_S.format('risky_action', 'risky_action_count')},
    arg_min(t, position) AS first_event_time_unix_nano, arg_max(t, position) AS last_event_time_unix_nano,
    max(position) AS last_source_position
  FROM review GROUP BY day_utc, harness)"""
SESSION_PROGRESS = """session_progress AS (
  SELECT harness, session_id, first_time AS first_activity_unix_nano, t AS last_activity_unix_nano,
    distinct_time AS last_distinct_progress_unix_nano, action_fp AS action_fingerprint, progress_fp AS progress_fingerprint,
    repeat_count, no_progress_count, consecutive_failures, CAST(rn AS BIGINT) AS total_actions, position AS last_source_position
  FROM runs QUALIFY row_number() OVER (PARTITION BY harness, session_id ORDER BY position DESC) = 1)"""
TELEMETRY_COVERAGE = """coverage_rows AS (
  SELECT harness, position, t, 'tool-observation' AS capability, tool_coverage AS state, tool_reason AS reason FROM guard
  UNION ALL SELECT harness, position, t, 'target-detail', target_coverage, target_reason FROM guard
  UNION ALL SELECT harness, position, t, 'progress-detail', CASE WHEN progress_seen THEN 'observed' ELSE 'unknown' END, progress_reason FROM guard),
telemetry_coverage AS (
  SELECT harness, capability, arg_max(state, position) AS state, arg_max(reason, position) AS reason,
    arg_min(t, position) AS first_seen_unix_nano, arg_max(t, position) AS last_seen_unix_nano, max(position) AS last_source_position
  FROM coverage_rows GROUP BY harness, capability)"""
LOOP_FINDINGS = """loops0 AS (
  SELECT *, CASE WHEN consecutive_failures >= 3 THEN 'repeated-failure' WHEN repeat_count >= 3 THEN 'repeated-action'
    WHEN no_progress_count >= 3 THEN 'bounded-no-progress' END AS finding_kind FROM runs),
loop_findings AS (
  SELECT 'loop|' || finding_kind || '|' || harness || '|' || session_id AS finding_id, finding_kind, harness, session_id,
    position AS source_position, first_time AS first_observed_unix_nano, t AS last_observed_unix_nano, repeat_count,
    consecutive_failures, no_progress_count,
    CAST(json_object('action_fingerprint', action_fp, 'action_fingerprint_coverage',
      CASE WHEN tool_coverage <> 'observed' OR target_coverage <> 'observed' THEN 'degraded' ELSE 'observed' END,
      'action_fingerprint_reason', CASE WHEN tool_coverage <> 'observed' THEN tool_reason WHEN target_coverage <> 'observed' THEN target_reason
        ELSE 'required policy fields observed' END, 'progress_fingerprint', progress_fp,
      'progress_coverage', CASE WHEN progress_seen THEN 'observed' ELSE 'unknown' END,
      'last_distinct_progress_unix_nano', distinct_time) AS VARCHAR) AS evidence
  FROM loops0 WHERE finding_kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY finding_kind, harness, session_id ORDER BY position DESC) = 1)"""
TOOL_FAILURES = """tool_failure_detail AS (
  SELECT position AS source_position, t AS event_time_unix_nano, harness, session_id, left(session_id, 12) AS session_id_prefix,
    COALESCE(project, 'unknown') AS project, COALESCE(model, 'unknown') AS model, COALESCE(tool, 'unknown') AS tool,
    COALESCE(full_command, '') AS command, COALESCE(arguments, '') AS tool_arguments, COALESCE(target_seen, '') AS target,
    COALESCE(error_message, '') AS failure_detail,
    CASE WHEN full_command IS NOT NULL AND error_message IS NOT NULL THEN 'observed'
      WHEN full_command IS NOT NULL OR arguments IS NOT NULL OR error_message IS NOT NULL OR target_seen IS NOT NULL THEN 'partial'
      ELSE 'unknown' END AS detail_coverage
  FROM guard WHERE success = FALSE)"""
URL_OBSERVATIONS = """url_observations AS (
  SELECT observed_full, arg_max(host, source_position) AS host,
    arg_min(event_time_unix_nano, source_position) AS first_observed_unix_nano,
    arg_max(event_time_unix_nano, source_position) AS last_observed_unix_nano, count(*) AS observation_count,
    arg_max(struct_pack(v := harness), source_position).v AS latest_harness,
    arg_max(struct_pack(v := session_id), source_position).v AS latest_session_id,
    arg_max(struct_pack(v := left(session_id, 12)), source_position).v AS latest_session_id_prefix,
    arg_max(struct_pack(v := tool_name), source_position).v AS latest_tool_name,
    arg_max(struct_pack(v := project), source_position).v AS latest_project, max(source_position) AS last_source_position
  FROM urls WHERE event_family = 'observation' GROUP BY observed_full)"""
URL_EXCLUSIONS = """seeds AS (
  SELECT s.*, 1 AS enabled, (SELECT arg_min(event_time_unix_nano, source_position) FROM urls) AS updated_unix_nano,
    (SELECT min(source_position) FROM urls) AS last_source_position
  FROM (VALUES ('builtin:ip-literal', 'host-exact', 'loopback-or-private-ip-literal'), ('builtin:localhost', 'host-exact', 'localhost'),
    ('builtin:single-label', 'host-exact', 'single-label-host'), ('builtin:local', 'host-suffix', '.local'),
    ('builtin:internal', 'host-suffix', '.internal'), ('builtin:home-arpa', 'host-suffix', '.home.arpa'),
    ('builtin:test', 'host-suffix', '.test')) s(exclusion_id, kind, pattern)),
operator_rules AS (
  SELECT exclusion_id, exclusion_kind AS kind, exclusion_pattern AS pattern, exclusion_enabled AS enabled,
    event_time_unix_nano AS updated_unix_nano, source_position AS last_source_position
  FROM urls WHERE event_family = 'exclusion'
  QUALIFY row_number() OVER (PARTITION BY exclusion_id ORDER BY source_position DESC) = 1),
url_exclusions AS (
  SELECT * FROM operator_rules UNION ALL SELECT * FROM seeds WHERE exclusion_id NOT IN (SELECT exclusion_id FROM operator_rules))"""
URL_VERDICTS = """url_verdicts AS (
  SELECT observed_full, provider, checked_full, verdict, threat_types, provider_reference, error, checked_unix_nano,
    valid_until_unix_nano, source_position AS last_source_position
  FROM urls WHERE event_family = 'reputation'
  QUALIFY row_number() OVER (PARTITION BY observed_full, provider ORDER BY source_position DESC) = 1)"""
URL_COUNTS = """url_family_counts AS (
  SELECT day_utc, event_family, count(*) AS record_count, count(*) FILTER (verdict = 'error') AS error_count,
    arg_min(event_time_unix_nano, source_position) AS first_event_time_unix_nano,
    arg_max(event_time_unix_nano, source_position) AS last_event_time_unix_nano, max(source_position) AS last_source_position
  FROM urls GROUP BY day_utc, event_family)"""

BASES = {
    "signal_counts": (O.REC, SIGNAL_COUNTS),
    "session_cost": (O.REC, O.USAGE, SESSION_COST),
    "session_cost_detail": (O.REC, O.USAGE, SESSION_COST_DETAIL),
    "event_inventory": (O.REC, O.ACTIVITY, EVENT_INVENTORY),
    "session_activity": (O.REC, O.ACTIVITY, SESSION_ACTIVITY),
    "request_performance": (O.REC, O.ACTIVITY, REQUEST_PERFORMANCE),
    "daily_review": (O.REC, O.REVIEW, DAILY_REVIEW),
    "session_progress": (O.REC, O.GUARD, O.RUNS, SESSION_PROGRESS),
    "telemetry_coverage": (O.REC, O.GUARD, TELEMETRY_COVERAGE),
    "policy_findings": (O.REC, O.GUARD, O.POLICY),
    "loop_findings": (O.REC, O.GUARD, O.RUNS, LOOP_FINDINGS),
    "tool_failure_detail": (O.REC, O.GUARD, TOOL_FAILURES),
    "url_observations": (O.URL, URL_OBSERVATIONS),
    "url_exclusions": (O.URL, URL_EXCLUSIONS),
    "url_verdicts": (O.URL, URL_VERDICTS),
    "url_family_counts": (O.URL, URL_COUNTS),
}


def oracle(select: str, *names: str) -> str:
    """Oracle text over the named tables, each CTE once and in dependency order."""
    parts: list[str] = []
    for name in names:
        parts += [part for part in BASES[name] if part not in parts]
    return with_ctes(*parts) + select


def _policy(spark, directory):
    return guard_folds.policy_findings(events_of(spark, directory, "agent-guard"))


FOLDED = {
    "f01_signal_counts": ("signal-counts", "signal_counts"),
    "f02_session_cost": ("session-cost", "session_cost"),
    "f03_session_cost_detail": ("session-cost", "session_cost_detail"),
    "f04_event_inventory": ("activity-stats", "event_inventory"),
    "f05_session_activity": ("activity-stats", "session_activity"),
    "f06_request_performance": ("activity-stats", "request_performance"),
    "f07_daily_review": ("daily-review", "daily_review"),
    "f08_session_progress": ("agent-guard", "session_progress"),
    "f09_telemetry_coverage": ("agent-guard", "telemetry_coverage"),
    "f11_loop_findings": ("agent-guard", "loop_findings"),
    "f12_tool_failure_detail": ("agent-guard", "tool_failure_detail"),
    "f13_url_observations": ("url-reputation", "url_observations"),
    "f14_url_exclusions": ("url-reputation", "url_exclusions"),
    "f15_url_verdicts": ("url-reputation", "url_verdicts"),
}
for key, (app, name) in FOLDED.items():
    register(key, table(app, name), oracle(f"SELECT * FROM {name}", name))
register("f10_policy_findings", _policy, oracle("SELECT * FROM policy_findings", "policy_findings"))
register(
    "f16_url_family_counts",
    table("url-reputation", "url_pipeline_counts"),
    oracle("SELECT * FROM url_family_counts", "url_family_counts"),
)


# -- recipes ---------------------------------------------------------------------


def recipe(make, app: str, *names: str):
    """A query that applies a recipe to tables of one app."""

    def run(spark, directory):
        tables = tables_of(spark, directory, app)
        return make(*[tables[name] for name in names])

    return run


def _day(text: str) -> str:
    return text.replace("1000000.0D", "1000000.0").replace("100.0D", "100.0").replace(" div ", " // ")


def _sum(name: str, alias: str | None = None) -> str:
    return f"CAST(sum({name}) AS BIGINT) AS {alias or name}"


register(
    "c01_latest_day",
    recipe(recipes.latest_day, "daily-review", "daily_review"),
    oracle(
        "SELECT harness, record_count, failure_count, duration_gt_5000ms_count AS slow_events, cost_microusd / 1000000.0 AS cost_usd, "
        "risky_action_count FROM daily_review WHERE day_utc = (SELECT max(day_utc) FROM daily_review)",
        "daily_review",
    ),
)
register(
    "c02_coverage_rollup",
    recipe(recipes.coverage_rollup, "activity-stats", "event_inventory"),
    oracle(
        f"SELECT harness, event_family, {_sum('event_count', 'events')}, {_sum('length_unknown_count', 'length_unknown')}, "
        f"{_sum('duration_unknown_count', 'duration_unknown')}, {_sum('outcome_unknown_count', 'outcome_unknown')}, "
        f"{_sum('session_unknown_count', 'session_unknown')}, {_sum('token_unknown_count', 'token_unknown')} "
        "FROM event_inventory GROUP BY harness, event_family",
        "event_inventory",
    ),
)
register(
    "c03_cache_efficiency",
    recipe(recipes.cache_efficiency, "activity-stats", "session_activity"),
    oracle(
        "SELECT harness, CAST(last_seen_unix_nano AS BIGINT) // 86400000000000 AS unix_day, "
        f"{_sum('input_tokens')}, {_sum('cached_input_tokens')}, "
        "CASE WHEN sum(input_tokens + cached_input_tokens) = 0 THEN NULL ELSE "
        "100.0::DOUBLE * sum(cached_input_tokens)::DOUBLE / sum(input_tokens + cached_input_tokens)::DOUBLE END AS cache_percent, "
        f"{_sum('output_tokens')}, sum(cost_microusd)::DOUBLE / 1000000.0 AS cost_usd FROM session_activity GROUP BY 1, 2",
        "session_activity",
    ),
)
register(
    "c04_tool_outcomes",
    recipe(recipes.tool_outcomes, "activity-stats", "event_inventory"),
    oracle(
        f"SELECT harness, tool_bucket, {_sum('event_count', 'calls')}, {_sum('success_count', 'successes')}, "
        f"{_sum('failure_count', 'failures')}, {_sum('outcome_unknown_count', 'outcome_unknown')} "
        "FROM event_inventory WHERE event_family = 'tool' GROUP BY harness, tool_bucket",
        "event_inventory",
    ),
)
register(
    "c05_latency_buckets",
    recipe(recipes.latency_buckets, "activity-stats", "request_performance"),
    oracle(
        f"SELECT harness, event_family, endpoint_bucket, {_sum('request_count', 'requests')}, "
        f"{_sum('duration_observed_count', 'duration_observed')}, {_sum('duration_unknown_count', 'duration_unknown')}, "
        f"{_sum('duration_le_100ms', 'le_100ms')}, {_sum('duration_le_500ms', 'le_500ms')}, {_sum('duration_le_1000ms', 'le_1000ms')}, "
        f"{_sum('duration_le_5000ms', 'le_5000ms')}, {_sum('duration_gt_5000ms', 'gt_5000ms')} "
        "FROM request_performance GROUP BY harness, event_family, endpoint_bucket",
        "request_performance",
    ),
)
register(
    "c06_policy_evidence",
    lambda spark, directory: _policy(spark, directory)
    .select(
        "observed_unix_nano", "harness", "session_id", "rule_id", "severity", "summary", "evidence", "coverage_state", "source_position"
    )
    .orderBy(C("source_position").desc()),
    oracle(
        "SELECT observed_unix_nano, harness, session_id, rule_id, severity, summary, evidence, coverage_state, source_position FROM policy_findings",
        "policy_findings",
    ),
)
register(
    "c06_coverage",
    recipe(recipes.coverage_by_capability, "agent-guard", "telemetry_coverage"),
    oracle(
        "SELECT harness, capability, state, reason, first_seen_unix_nano, last_seen_unix_nano, last_source_position FROM telemetry_coverage",
        "telemetry_coverage",
    ),
)
register(
    "c06_failed_commands",
    recipe(recipes.failed_commands, "agent-guard", "tool_failure_detail"),
    oracle(
        "SELECT event_time_unix_nano, harness, session_id_prefix, project, model, tool, command, tool_arguments, target, "
        "failure_detail, detail_coverage FROM tool_failure_detail",
        "tool_failure_detail",
    ),
)
register(
    "c06_loop_evidence",
    recipe(recipes.loop_evidence, "agent-guard", "loop_findings"),
    oracle(
        "SELECT first_observed_unix_nano, last_observed_unix_nano, harness, session_id, finding_kind, repeat_count, "
        "consecutive_failures, no_progress_count, evidence FROM loop_findings",
        "loop_findings",
    ),
)
CUTOFF = "1706000000000000000"
register(
    "c07_stalled_sessions",
    recipe(lambda progress: recipes.stalled_sessions(progress, CUTOFF), "agent-guard", "session_progress"),
    oracle(
        "SELECT harness, session_id, last_activity_unix_nano, last_distinct_progress_unix_nano, total_actions "
        f"FROM session_progress WHERE last_distinct_progress_unix_nano < '{CUTOFF}'",
        "session_progress",
    ),
)
register(
    "c08_usage_by_session",
    recipe(recipes.usage_by_session, "session-cost", "session_cost"),
    oracle(
        "SELECT harness, session_id, input_tokens, cached_input_tokens, output_tokens, reasoning_output_tokens, "
        "cost_microusd / 1000000.0 AS cost_usd, last_event_time_unix_nano FROM session_cost",
        "session_cost",
    ),
)
register(
    "c08_usage_by_harness",
    recipe(recipes.usage_by_harness, "session-cost", "session_cost"),
    oracle(
        f"SELECT harness, {_sum('input_tokens')}, {_sum('cached_input_tokens')}, {_sum('output_tokens')}, "
        f"{_sum('reasoning_output_tokens')}, sum(cost_microusd)::DOUBLE / 1000000.0 AS cost_usd FROM session_cost GROUP BY harness",
        "session_cost",
    ),
)
register(
    "c09_cost_by_model",
    recipe(recipes.cost_by_model, "session-cost", "session_cost_detail"),
    oracle(
        "SELECT harness, model, project, model_coverage, project_coverage, sum(cost_microusd)::DOUBLE / 1000000.0 AS cost_usd, "
        f"{_sum('input_tokens')}, {_sum('cached_input_tokens')}, {_sum('output_tokens')} FROM session_cost_detail GROUP BY 1, 2, 3, 4, 5",
        "session_cost_detail",
    ),
)
register(
    "c09_session_labels",
    recipe(recipes.session_labels, "session-cost", "session_cost_detail"),
    oracle(
        "SELECT harness, session_id_prefix, first_event_time_unix_nano, last_event_time_unix_nano, project, model, "
        "cost_microusd / 1000000.0 AS cost_usd FROM session_cost_detail",
        "session_cost_detail",
    ),
)


def _guard_cost(spark, directory):
    progress = tables_of(spark, directory, "agent-guard")["session_progress"]
    return recipes.guard_cost(progress, tables_of(spark, directory, "session-cost")["session_cost"])


register(
    "c10_guard_cost_join",
    _guard_cost,
    oracle(
        "SELECT p.harness, p.session_id, p.total_actions, p.consecutive_failures, p.no_progress_count, c.input_tokens, c.cached_input_tokens, c.output_tokens, "
        "c.reasoning_output_tokens, c.cost_microusd FROM session_progress p JOIN session_cost c ON c.harness = p.harness AND c.session_id = p.session_id",
        "session_progress",
        "session_cost",
    ),
)
register(
    "c11_signal_listing",
    lambda spark, directory: tables_of(spark, directory, "signal-counts")["signal_counts"]
    .select("source", "signal", "event_name", "event_count")
    .orderBy("source", "signal", "event_name"),
    oracle("SELECT source, signal, event_name, event_count FROM signal_counts", "signal_counts"),
)
PROVIDER, NOW = "safe-browsing-v5", "1704300000000000000"
DUE = (
    "SELECT o.observed_full, o.host, o.last_observed_unix_nano, o.latest_tool_name, o.latest_project, o.latest_harness, "
    "o.latest_session_id_prefix FROM url_observations o LEFT JOIN url_verdicts v "
    f"ON v.observed_full = o.observed_full AND v.provider = '{PROVIDER}' "
    f"WHERE v.observed_full IS NULL OR CAST(v.valid_until_unix_nano AS BIGINT) <= {NOW}"
)
_due = recipe(
    lambda observations, verdicts: recipes.due_listing(observations, verdicts, PROVIDER, NOW), "url-reputation", "url_observations", "url_verdicts"
)
register("c12_urls_due", _due, oracle(DUE, "url_observations", "url_verdicts"))
register(
    "c12_enabled_exclusions",
    recipe(recipes.enabled_exclusions, "url-reputation", "url_exclusions"),
    oracle("SELECT exclusion_id, kind, pattern, updated_unix_nano FROM url_exclusions WHERE enabled = 1", "url_exclusions"),
)
register(
    "c13_daily_listing",
    recipe(recipes.daily_listing, "daily-review", "daily_review"),
    oracle(
        "SELECT day_utc, harness, record_count, tool_event_count, api_event_count, failure_count, duration_gt_5000ms_count, "
        "input_tokens, cached_input_tokens, output_tokens, reasoning_output_tokens, cost_microusd / 1000000.0 AS cost_usd, "
        "identity_metadata_count, auth_metadata_count, raw_prompt_content_count, raw_tool_content_count, risky_action_count FROM daily_review",
        "daily_review",
    ),
)
register(
    "c14_latency_summary",
    lambda spark, directory: recipes.latency_summary(
        tables_of(spark, directory, "activity-stats")["request_performance"]
    ),
    oracle(
        "SELECT harness, event_family, CAST(o AS BIGINT) AS observed, CASE WHEN o > 0 THEN total::DOUBLE / o::DOUBLE END AS average_ms, "
        "CAST(CASE WHEN o = 0 THEN NULL WHEN a * 100 >= o * 95 THEN 100 WHEN b * 100 >= o * 95 THEN 500 WHEN c * 100 >= o * 95 THEN 1000 "
        "WHEN d * 100 >= o * 95 THEN 5000 END AS BIGINT) AS p95_bound_ms FROM (SELECT harness, event_family, "
        "sum(duration_observed_count) AS o, sum(duration_milliseconds_total) AS total, sum(duration_le_100ms) AS a, "
        "sum(duration_le_500ms) AS b, sum(duration_le_1000ms) AS c, sum(duration_le_5000ms) AS d "
        "FROM request_performance GROUP BY harness, event_family)",
        "request_performance",
    ),
)
RANK_ERROR = 0.02


def _percentiles_hold(spark, directory):
    """Whether the percentiles of sketches merged from two batches stand within their error of the true rank."""
    events = events_of(spark, directory, "activity-stats")
    fold = app_folds.request_latency()
    odd = C("source_position") % 2 == 1
    found = recipes.latency_percentiles(fold.apply(events.where(odd), fold.apply(events.where(~odd))))
    times = events.where(C("performance_event") & (C("duration_coverage") == "observed"))
    counted = times.groupBy("harness", "event_family", "duration_milliseconds").agg(F.count(F.lit(1)).alias("n"))
    ranks = [
        F.coalesce(F.sum(F.when(C("duration_milliseconds") < C(name), C("n"))) / F.sum("n") - RANK_ERROR <= share, F.lit(True))
        & (F.sum(F.when(C("duration_milliseconds") <= C(name), C("n"))) / F.sum("n") + RANK_ERROR >= share)
        for name, share in recipes.PERCENTILES.items()
    ]
    names = [f"{name}_holds" for name in recipes.PERCENTILES]
    held = counted.join(found, ["harness", "event_family"]).groupBy("harness", "event_family", "observed")
    return held.agg(*[rank.alias(name) for rank, name in zip(ranks, names)])


register(
    "c14_latency_percentiles",
    _percentiles_hold,
    oracle(
        "SELECT harness, event_family, CAST(sum(duration_observed_count) AS BIGINT) AS observed, true AS p50_ms_holds, true AS p95_ms_holds, "
        "true AS p99_ms_holds FROM request_performance GROUP BY harness, event_family HAVING sum(duration_observed_count) > 0",
        "request_performance",
    ),
)
register(
    "c15_exclusion_enforcement",
    lambda spark, directory: recipes.enforce_exclusions(
        _due(spark, directory), tables_of(spark, directory, "url-reputation")["url_exclusions"]
    ),
    oracle(
        f"SELECT * FROM ({DUE}) due WHERE NOT EXISTS (SELECT 1 FROM url_exclusions x WHERE x.enabled = 1 AND ("
        "(x.kind = 'host-exact' AND x.pattern = due.host) "
        "OR (x.kind = 'host-exact' AND x.pattern = 'single-label-host' AND strpos(due.host, '.') = 0) "
        "OR (x.kind = 'host-suffix' AND ltrim(x.pattern, '.') <> '' AND ends_with('.' || due.host, '.' || ltrim(x.pattern, '.'))) "
        "OR (x.kind = 'url-prefix' AND starts_with(due.observed_full, x.pattern))))",
        "url_observations",
        "url_verdicts",
        "url_exclusions",
    ),
)


def _conversation_activity(spark, directory):
    from ..plans import apps

    return apps.activity_stats().tables(conversation_records(spark, directory))["session_activity"].select(
        "session_id", "event_count", "prompt_count", "response_count", "reported_length_total", "last_source_position"
    )


register(
    "n08_conversation_lengths",
    _conversation_activity,
    "SELECT 'c' || conv_id AS session_id, count(*) AS event_count, count(*) FILTER (role = 'user') AS prompt_count, "
    "count(*) FILTER (role = 'assistant') AS response_count, CAST(sum(length(text)) AS BIGINT) AS reported_length_total, "
    "max(conv_id * 1048576 + turn + 1) AS last_source_position FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id",
)
