"""DuckDB text of the adapter rule and the normalizers, as CTEs to prefix a query with."""

REC = """
e0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS micros,
         user_id % 4 AS slot, CAST(floor(value * 100) AS BIGINT) AS cents,
         event_type IN ('click', 'error') AS is_tool, user_id % 7 = 0 AS calm
  FROM events
),
e1 AS (
  SELECT *, CASE WHEN is_tool THEN 'tool_result' WHEN event_type = 'view' THEN 'user_prompt'
    WHEN event_type = 'purchase' AND k % 9 = 0 THEN 'websocket_request'
    WHEN event_type = 'purchase' THEN 'api_request'
    WHEN k % 3 = 0 THEN 'assistant_response' WHEN k % 3 = 1 THEN 'turn_ttft'
    WHEN slot = 1 THEN 'sse_event' ELSE 'other' END AS kind
  FROM e0
),
e2 AS (
  SELECT *, CASE WHEN kind = 'other' THEN 'other.event'
    WHEN slot = 2 AND is_tool THEN 'opencode.tool.execute.after'
    WHEN slot = 0 THEN 'claude_code.' || kind WHEN slot = 1 THEN 'codex.' || kind
    WHEN slot = 2 THEN 'opencode.' || kind ELSE 'agent.' || kind END AS full_name,
    CASE WHEN event_id % 97 <> 0 THEN CAST(micros * 1000 AS VARCHAR) END AS t,
    CASE WHEN event_id % 17 <> 0 THEN 's' || user_id END AS sess,
    kind IN ('api_request', 'websocket_request') AS api,
    (kind = 'api_request' AND k % 12 <> 5) OR kind = 'sse_event' AS counted,
    event_type = 'error' AS failed, micros // 86400000000 AS day
  FROM e1
),
rec AS (
  SELECT *, event_id + 1 AS position,
    CASE slot WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex_exec' WHEN 2 THEN 'opencode' ELSE 'demo-agent' END AS source,
    CASE slot WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' ELSE 'demo-agent' END AS harness,
    CASE event_id % 10 WHEN 8 THEN 'span' WHEN 9 THEN 'metric' ELSE 'log' END AS signal,
    CASE slot WHEN 0 THEN kind WHEN 1 THEN 'event callsite' ELSE full_name END AS name,
    CASE WHEN NOT is_tool THEN NULL WHEN calm THEN 'read' ELSE
      CASE k % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'read' WHEN 2 THEN 'grep' WHEN 3 THEN 'write'
                 WHEN 4 THEN 'dangerous_shell' END END AS tool,
    CASE WHEN NOT is_tool THEN NULL WHEN calm THEN '/workspace/a' ELSE
      CASE k % 5 WHEN 0 THEN '/workspace/a' WHEN 1 THEN '/workspace/b' WHEN 2 THEN '/outside/x'
                 WHEN 3 THEN '<redacted>' END END AS target,
    CASE WHEN is_tool AND k % 23 = 0 THEN 'destructive' END AS operation_kind,
    CASE WHEN failed THEN FALSE WHEN event_type = 'click' AND k % 7 <> 0 THEN TRUE END AS success,
    CASE WHEN api THEN CASE k % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 END END AS status_code,
    CASE WHEN api AND k % 5 = 3 THEN 'OK' END AS status,
    CASE WHEN (is_tool OR api) AND k % 10 <> 9 THEN CAST(floor(value * 20) AS BIGINT)
         WHEN kind = 'turn_ttft' THEN CAST(floor(value * 20) AS BIGINT) END AS duration,
    CASE WHEN counted THEN k END AS input_tokens,
    CASE WHEN counted THEN k % 13 END AS output_tokens,
    CASE WHEN counted AND slot = 0 THEN k * 2 WHEN counted AND slot = 1 THEN k END AS cached,
    CASE WHEN counted AND slot = 2 THEN k % 5 WHEN counted AND slot = 1 THEN k % 3 END AS reasoning,
    CASE WHEN counted AND slot IN (0, 3) THEN cents END AS cost_micro,
    CASE WHEN counted AND slot = 2 THEN value / 1000 END AS cost_usd,
    CASE WHEN kind = 'user_prompt' THEN k * 3 WHEN kind = 'assistant_response' AND k % 11 <> 0 THEN k * 7 END AS reported,
    CASE WHEN k % 11 <> 0 THEN 'm' || (user_id % 3) END AS model,
    CASE WHEN k % 8 <> 3 THEN '/w/' || (user_id % 5) END AS project,
    CASE WHEN NOT is_tool THEN NULL WHEN user_id % 5 = 0 AND event_id % 4 <> 0 THEN 'p' || (day // 6)
         WHEN user_id % 5 = 0 AND event_id % 8 = 0 THEN '<redacted>' END AS progress,
    CASE WHEN failed AND k % 3 = 0 THEN 'run ' || k END AS full_command,
    CASE WHEN failed AND k % 4 = 0 THEN 'args ' || k END AS arguments,
    CASE WHEN failed AND k % 2 = 0 THEN 'failed ' || k END AS error_message,
    sess IS NOT NULL OR (slot = 2 AND event_id % 17 = 0) AS session_known,
    COALESCE(sess, CASE WHEN slot = 2 AND event_id % 17 = 0 THEN 'i' || (user_id % 3) END,
      'unknown:' || CASE slot WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' ELSE 'demo-agent' END) AS session_id
  FROM e2
)
"""

# Only the three known harness prefixes are recognised; the fourth source has none.
USAGE = """
usage AS (
  SELECT *, CASE WHEN cost_micro IS NOT NULL THEN cost_micro
      WHEN cost_usd IS NOT NULL AND signal = 'log' THEN CAST(round_even(cost_usd / 0.000001, 0) AS BIGINT) ELSE 0 END AS cost
  FROM rec
  WHERE slot < 3 AND counted AND t IS NOT NULL AND (kind = 'api_request')
     OR (slot = 1 AND kind = 'sse_event' AND t IS NOT NULL)
)
"""

ACTIVITY = """
fam AS (
  SELECT *, CASE WHEN slot = 3 THEN '' WHEN is_tool THEN 'tool' WHEN kind = 'api_request' THEN 'api-request'
    WHEN kind = 'assistant_response' THEN 'assistant-response' WHEN kind = 'user_prompt' THEN 'user-prompt'
    WHEN kind = 'turn_ttft' THEN 'turn-ttft' WHEN kind = 'websocket_request' THEN 'websocket-request'
    WHEN kind = 'sse_event' THEN 'token-usage' ELSE '' END AS event_family
  FROM rec
),
act AS (
  SELECT *,
    CASE WHEN event_family <> 'tool' THEN 'not-applicable' WHEN tool IS NULL THEN 'unknown'
      WHEN tool = 'bash' THEN 'shell' WHEN tool IN ('read', 'write') THEN tool WHEN tool = 'grep' THEN 'search'
      ELSE 'other' END AS tool_bucket,
    CASE WHEN event_family NOT IN ('api-request', 'websocket-request') THEN 'not-applicable'
      WHEN k % 4 = 0 THEN 'responses' WHEN k % 4 = 1 THEN 'chat-completions'
      WHEN event_family = 'websocket-request' THEN 'websocket' WHEN k % 4 = 2 THEN 'other' ELSE 'unknown' END AS endpoint_bucket,
    CASE WHEN success THEN 'success' WHEN success IS NOT NULL THEN 'failure'
      WHEN status = 'OK' OR status_code = 200 THEN 'success' WHEN status_code >= 400 THEN 'failure' ELSE 'unknown' END AS success_state,
    event_family IN ('assistant-response', 'user-prompt') AS has_length,
    event_family IN ('tool', 'api-request', 'turn-ttft', 'websocket-request') AS has_duration,
    event_family IN ('api-request', 'token-usage') AS has_tokens,
    CASE WHEN reported <> 0 THEN reported END AS len,
    CASE WHEN duration <> 0 THEN duration END AS dur,
    CASE WHEN cost_micro IS NOT NULL THEN cost_micro
      WHEN cost_usd IS NOT NULL AND signal = 'log' THEN CAST(round_even(cost_usd / 0.000001, 0) AS BIGINT) ELSE 0 END AS cost
  FROM fam WHERE event_family <> '' AND t IS NOT NULL
),
activity AS (
  SELECT *,
    CASE WHEN NOT has_length THEN 'not-applicable' WHEN len IS NOT NULL THEN 'observed' ELSE 'unknown' END AS length_coverage,
    CASE WHEN NOT has_duration THEN 'not-applicable' WHEN dur IS NOT NULL THEN 'observed' ELSE 'unknown' END AS duration_coverage,
    CASE WHEN NOT has_tokens THEN 'not-applicable' WHEN counted THEN 'observed' ELSE 'unknown' END AS token_coverage,
    CASE WHEN session_known THEN 'observed' ELSE 'unknown' END AS session_coverage,
    CASE WHEN has_length THEN COALESCE(len, 0) ELSE 0 END AS reported_length,
    CASE WHEN has_duration THEN COALESCE(dur, 0) ELSE 0 END AS duration_milliseconds,
    event_family IN ('api-request', 'turn-ttft', 'websocket-request') AS performance_event
  FROM act
)
"""

# A reported zero falls through the truthy chains above; the review keeps it (exists chain).
REVIEW = """
review AS (
  SELECT *, CAST(floor(CAST(t AS DOUBLE) / 86400000000000) AS BIGINT) AS day_utc,
    CAST(slot < 3 AND is_tool AS INT) AS tool_event,
    CAST(slot < 3 AND kind = 'api_request' AS INT) AS api_event,
    slot < 3 AND (kind = 'api_request' OR (slot = 1 AND kind = 'sse_event')) AS usage_event,
    CASE WHEN NOT (slot < 3 AND (is_tool OR kind = 'api_request')) THEN 'not-applicable'
      WHEN success THEN 'success' WHEN success IS NOT NULL THEN 'failure'
      WHEN status = 'OK' OR status_code = 200 THEN 'success' WHEN status_code >= 400 THEN 'failure'
      ELSE 'unknown' END AS success_state,
    CASE WHEN cost_micro IS NOT NULL THEN cost_micro
      WHEN cost_usd IS NOT NULL THEN CAST(round_even(cost_usd / 0.000001, 0) AS BIGINT) ELSE 0 END AS cost,
    CAST(user_id % 10 = 0 AS INT) AS identity_metadata, CAST(user_id % 10 = 1 AS INT) AS auth_metadata,
    CAST(kind = 'user_prompt' AND k % 2 = 0 AS INT) AS raw_prompt_content,
    CAST(full_command IS NOT NULL OR arguments IS NOT NULL AS INT) AS raw_tool_content,
    CAST(COALESCE(tool = 'dangerous_shell', FALSE) OR COALESCE(operation_kind = 'destructive', FALSE)
      OR COALESCE(target = '/outside/x', FALSE) AS INT) AS risky_action
  FROM rec WHERE t IS NOT NULL
)
"""

GUARD = """
guard0 AS (
  SELECT *, CASE WHEN target <> '<redacted>' THEN target END AS tgt,
    CASE WHEN progress <> '<redacted>' THEN progress END AS prog,
    COALESCE(operation_kind, 'tool') AS op
  FROM rec WHERE slot < 3 AND is_tool AND t IS NOT NULL
),
guard AS (
  SELECT *,
    harness || '|' || session_id || '|' || op || '|' || COALESCE(tool, 'unknown') || '|' ||
      COALESCE(tgt, CASE WHEN target IS NULL THEN full_command END, 'unknown') AS action_fp,
    COALESCE(tgt, CASE WHEN target IS NULL THEN full_command END) AS target_seen,
    COALESCE(prog, 'unknown') AS progress_fp, prog IS NOT NULL AS progress_seen,
    CASE WHEN session_known AND tool IS NOT NULL THEN 'observed' ELSE 'unknown' END AS tool_coverage,
    CASE WHEN COALESCE(tgt, CASE WHEN target IS NULL THEN full_command END) IS NOT NULL THEN 'observed' ELSE 'unknown' END AS target_coverage,
    CASE WHEN NOT session_known THEN 'session identity absent' WHEN tool IS NOT NULL THEN 'session and tool identity observed'
      ELSE 'tool identity absent, gated, or redacted' END AS tool_reason,
    CASE WHEN COALESCE(tgt, CASE WHEN target IS NULL THEN full_command END) IS NOT NULL THEN 'tool target observed'
      ELSE 'tool target absent, gated, or redacted' END AS target_reason,
    CASE WHEN prog IS NOT NULL THEN 'progress fingerprint observed'
      ELSE 'progress fingerprint absent, gated, or redacted' END AS progress_reason
  FROM guard0
)
"""

RUNS = """
r0 AS (
  SELECT *, lag(action_fp) OVER w AS prev_action, lag(progress_fp) OVER w AS prev_progress,
    row_number() OVER w AS rn
  FROM guard WINDOW w AS (PARTITION BY harness, session_id ORDER BY position)
),
r1 AS (
  SELECT *, CAST(rn = 1 OR action_fp <> prev_action AS INT) AS brk,
    CAST(rn > 1 AND progress_seen AND progress_fp = prev_progress AS INT) AS same,
    CAST(progress_seen AND NOT (rn > 1 AND progress_fp = prev_progress) AS INT) AS reset
  FROM r0
),
r2 AS (
  SELECT *, sum(brk) OVER w AS brk_group, sum(reset) OVER w AS reset_group,
    sum(CAST(COALESCE(success, FALSE) AS INT)) OVER w AS success_group
  FROM r1 WINDOW w AS (PARTITION BY harness, session_id ORDER BY position)
),
runs AS (
  SELECT *,
    CAST(row_number() OVER (PARTITION BY harness, session_id, brk_group ORDER BY position) AS BIGINT) AS repeat_count,
    CAST(sum(same) OVER (PARTITION BY harness, session_id, reset_group ORDER BY position) AS BIGINT) AS no_progress_count,
    CAST(sum(CAST(success IS NOT NULL AND NOT success AS INT)) OVER (PARTITION BY harness, session_id, success_group ORDER BY position) AS BIGINT) AS consecutive_failures,
    first_value(t) OVER (PARTITION BY harness, session_id ORDER BY position) AS first_time,
    last_value(CASE WHEN rn = 1 OR reset = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY harness, session_id ORDER BY position) AS distinct_time
  FROM r2
)
"""

POLICY = """
policy0 AS (
  SELECT *, CASE WHEN tool = 'dangerous_shell' THEN 'denied-tool' WHEN op = 'destructive' THEN 'denied-operation'
    WHEN target_seen = '/outside/x' THEN 'target-boundary'
    WHEN tool_coverage <> 'observed' OR target_coverage <> 'observed' THEN 'insufficient-telemetry' END AS rule_id
  FROM guard
),
policy1 AS (
  SELECT *, CASE WHEN rule_id = 'insufficient-telemetry' THEN 'policy|insufficient-telemetry|' || harness || '|' || session_id
    ELSE 'policy|' || harness || '|' || session_id || '|' || position END AS finding_id,
    CASE WHEN tool_coverage <> 'observed' THEN tool_reason WHEN target_coverage <> 'observed' THEN target_reason
      ELSE 'required policy fields observed' END AS coverage_reason
  FROM policy0 WHERE rule_id IS NOT NULL
),
policy_findings AS (
  SELECT finding_id, rule_id, CASE WHEN rule_id = 'insufficient-telemetry' THEN 'unknown' ELSE 'high' END AS severity,
    harness, session_id, position AS source_position, t AS observed_unix_nano,
    CASE rule_id WHEN 'denied-tool' THEN 'Observed a denied tool' WHEN 'denied-operation' THEN 'Observed a denied operation kind'
      WHEN 'target-boundary' THEN 'Observed an out-of-bound target'
      ELSE 'Required policy telemetry was absent or redacted' END AS summary,
    CAST(json_object('tool', tool, 'operation_kind', op, 'target', target_seen, 'argument_digest',
      'sha256:' || sha256(CAST(event_id AS VARCHAR)), 'coverage_reason', coverage_reason) AS VARCHAR) AS evidence,
    CASE WHEN tool_coverage <> 'observed' OR target_coverage <> 'observed' THEN 'unknown' ELSE 'observed' END AS coverage_state
  FROM policy1
  QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY position DESC) = 1
)
"""

URL = """
p0 AS (
  SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
    regexp_extract(url, '^https?://[^/?#]+/[a-z]+', 0) AS section,
    CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN url ELSE '' END AS whole, unnest([0, 1, 2]) AS part
  FROM pages
),
p1 AS (
  SELECT *, page_id * 3 + part + 1 AS position,
    CAST(1704067200000000000 + page_id * 3600000000000 + part AS VARCHAR) AS t
  FROM p0 WHERE part = 0 OR (part = 1 AND page_id % 3 = 0) OR (part = 2 AND page_id % 10 = 0)
),
urls AS (
  SELECT position AS source_position, page_id,
    CASE part WHEN 0 THEN 'observation' WHEN 1 THEN 'reputation' ELSE 'exclusion' END AS event_family,
    t AS event_time_unix_nano, CAST(floor(CAST(t AS DOUBLE) / 86400000000000) AS BIGINT) AS day_utc,
    CASE WHEN part < 2 THEN whole END AS observed_full, CASE WHEN part = 0 THEN host END AS host,
    CASE WHEN part = 0 THEN CASE WHEN page_id % 6 = 0 THEN 'codex' WHEN page_id % 2 = 0 THEN 'opencode' ELSE 'codex_exec' END END AS harness,
    CASE WHEN part = 0 AND page_id % 4 <> 3 THEN 'session-number-' || (page_id % 7) END AS session_id,
    CASE WHEN part = 0 AND page_id % 2 = 0 THEN 'web_fetch' END AS tool_name,
    -- an empty project is not truthy, so the chain ends in the missing cwd
    CASE WHEN part = 0 AND page_id % 9 <> 0 THEN '/w/' || (page_id % 3) END AS project,
    CASE WHEN part = 2 THEN CASE WHEN page_id % 50 = 10 THEN 'builtin:local' ELSE 'operator:' || (page_id % 4) END END AS exclusion_id,
    CASE WHEN part = 2 THEN CASE page_id % 3 WHEN 0 THEN 'host-exact' WHEN 1 THEN 'host-suffix' ELSE 'url-prefix' END END AS exclusion_kind,
    CASE WHEN part = 2 THEN CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN '.' ELSE '' END || regexp_extract(host, '([^.]+\\.[^.]+)$', 1) ELSE section END END AS exclusion_pattern,
    CASE WHEN part = 2 THEN CAST(page_id % 20 = 0 AS INT) END AS exclusion_enabled,
    CASE WHEN part = 1 THEN CASE WHEN page_id % 2 = 0 THEN 'safe-browsing-v5' ELSE 'web-risk' END END AS provider,
    CASE WHEN part = 1 THEN whole END AS checked_full,
    CASE WHEN part = 1 THEN CASE page_id % 9 WHEN 0 THEN 'clean' WHEN 3 THEN 'suspected' ELSE 'error' END END AS verdict,
    CASE WHEN part = 1 AND page_id % 9 = 3 THEN '["MALWARE"]' END AS threat_types,
    CAST(NULL AS VARCHAR) AS provider_reference,
    CASE WHEN part = 1 AND page_id % 9 = 6 THEN 'provider timeout' END AS error,
    CASE WHEN part = 1 THEN t END AS checked_unix_nano,
    CASE WHEN part = 1 THEN CAST(CAST(t AS BIGINT) + 86400000000000 * (1 + page_id % 5) AS VARCHAR) END AS valid_until_unix_nano
  FROM p1
  WHERE (part = 0 AND page_id % 5 <> 0) OR part = 1 OR (part = 2 AND page_id % 40 <> 30)
)
"""
