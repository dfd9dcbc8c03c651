"""Adapters that read ordinary tables as canonical records.

Attributes become a typed struct, so the scan reads only the columns a normalizer uses
and every alias the table lacks disappears at plan time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

#: Positions reserved for the turns of one conversation.
TURN_POSITIONS = 1 << 20


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than cores over all cores.

    Normalizing costs far more than moving the few columns of a small input.  A large
    input has more splits than cores and is left as it is, without a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def emit(frame: DataFrame, *columns: Column) -> DataFrame:
    """One record per row, as generator output: each derived column is computed once."""
    return frame.select(F.struct(*columns).alias("_record")).select(F.inline(F.array(F.col("_record"))))


def _typed_struct(values: dict[str, Column]) -> Column:
    return F.struct(*[value.alias(name) for name, value in values.items()])


def event_parts(events: DataFrame) -> DataFrame:
    """The derived quantities of the event rule, as columns next to the event."""
    staged = events.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS micros",
        "user_id % 4 AS slot",
        "event_type IN ('click', 'error') AS is_tool",
        "event_type = 'error' AS failed",
        "user_id % 7 = 0 AS calm",
    )
    return staged.selectExpr(
        "*",
        """CASE WHEN is_tool THEN 'tool_result' WHEN event_type = 'view' THEN 'user_prompt'
             WHEN event_type = 'purchase' AND k % 9 = 0 THEN 'websocket_request'
             WHEN event_type = 'purchase' THEN 'api_request'
             WHEN k % 3 = 0 THEN 'assistant_response' WHEN k % 3 = 1 THEN 'turn_ttft'
             WHEN slot = 1 THEN 'sse_event' ELSE 'other' END AS kind""",
    )


# Attribute expressions over the event parts; NULL means the record lacks the attribute.
EVENT_ATTRIBUTES = {
    "event.name": "CASE slot WHEN 0 THEN kind WHEN 1 THEN full_name END",
    "session.id": "CASE WHEN slot IN (0, 3) THEN session END",
    "conversation.id": "CASE WHEN slot = 1 THEN session END",
    "session_id": "CASE WHEN slot = 2 THEN session END",
    "tool_name": "CASE WHEN slot = 0 THEN upper(tool) ELSE tool END",
    "target": "target",
    "operation_kind": "CASE WHEN is_tool AND k % 23 = 0 THEN 'destructive' END",
    "success": "CASE WHEN failed THEN false WHEN event_type = 'click' AND k % 7 <> 0 THEN true END",
    "status_code": "CAST(CASE WHEN api THEN CASE k % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 END END AS BIGINT)",
    "status": "CASE WHEN api AND k % 5 = 3 THEN 'OK' END",
    "duration_ms": "CASE WHEN timed AND slot <> 1 THEN duration END",
    "latency_ms": "CASE WHEN timed AND slot = 1 THEN duration END",
    "ttft_ms": "CASE WHEN kind = 'turn_ttft' THEN duration END",
    "endpoint": "CASE WHEN api THEN CASE k % 4 WHEN 0 THEN '/v1/responses' WHEN 1 THEN 'chat/completions' WHEN 2 THEN '/v1/other' END END",
    "input_tokens": "CASE WHEN counted AND slot <> 1 THEN k END",
    "input_token_count": "CASE WHEN counted AND slot = 1 THEN k END",
    "output_tokens": "CASE WHEN counted AND slot <> 1 THEN k % 13 END",
    "output_token_count": "CASE WHEN counted AND slot = 1 THEN k % 13 END",
    "cache_read_tokens": "CASE WHEN counted AND slot = 0 THEN k * 2 END",
    "cached_token_count": "CASE WHEN counted AND slot = 1 THEN k END",
    "reasoning_tokens": "CASE WHEN counted AND slot = 2 THEN k % 5 END",
    "reasoning_token_count": "CASE WHEN counted AND slot = 1 THEN k % 3 END",
    "cost_microusd": "CASE WHEN counted AND slot IN (0, 3) THEN floor(value * 100) END",
    "cost_usd": "CASE WHEN counted AND slot = 2 THEN value / 1000 END",
    "prompt_length": "CASE WHEN kind = 'user_prompt' THEN k * 3 END",
    "response_length": "CASE WHEN kind = 'assistant_response' AND k % 11 <> 0 THEN k * 7 END",
    "model": "CASE WHEN slot <> 2 THEN model END",
    "gen_ai.request.model": "CASE WHEN slot = 2 THEN model END",
    "project": "CASE WHEN slot = 0 THEN project END",
    "cwd": "CASE WHEN slot <> 0 THEN project END",
    "progress_fingerprint": "progress",
    "full_command": "CASE WHEN failed AND k % 3 = 0 THEN concat('run ', k) END",
    "arguments": "CASE WHEN failed AND k % 4 = 0 THEN concat('args ', k) END",
    "error.message": "CASE WHEN failed AND k % 2 = 0 THEN concat('failed ', k) END",
    "user.email": "CASE WHEN user_id % 10 = 0 THEN 'person@example.com' END",
    "auth_mode": "CASE WHEN user_id % 10 = 1 THEN 'token' END",
    "prompt": "CASE WHEN kind = 'user_prompt' AND k % 2 = 0 THEN 'text' END",
}
EVENT_RESOURCE = {
    "service.name": "source",
    "service.instance.id": "CASE WHEN slot = 2 AND event_id % 17 = 0 THEN concat('i', user_id % 3) END",
}


def _struct_text(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {text}" for name, text in fields.items()) + ")"


def events_as_records(events: DataFrame, attributes: dict[str, str] | None = None) -> DataFrame:
    """``events`` rows as canonical records of four sources in three signals.

    ``attributes`` overrides or adds attribute expressions.
    """
    staged = event_parts(events).selectExpr(
        "*",
        """CASE WHEN kind = 'other' THEN 'other.event' WHEN slot = 2 AND is_tool THEN 'opencode.tool.execute.after'
             ELSE concat(element_at(array('claude_code.', 'codex.', 'opencode.', 'agent.'), CAST(slot + 1 AS INT)), kind) END AS full_name""",
        "element_at(array('claude-code', 'codex_exec', 'opencode', 'demo-agent'), CAST(slot + 1 AS INT)) AS source",
        "CASE WHEN event_id % 97 <> 0 THEN CAST(micros * 1000 AS STRING) END AS nanos",
        "CASE WHEN event_id % 17 <> 0 THEN concat('s', user_id) END AS session",
        """CASE WHEN NOT is_tool THEN NULL WHEN calm THEN 'read' ELSE
             CASE k % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'read' WHEN 2 THEN 'grep' WHEN 3 THEN 'write' WHEN 4 THEN 'dangerous_shell' END END AS tool""",
        """CASE WHEN NOT is_tool THEN NULL WHEN calm THEN '/workspace/a' ELSE
             CASE k % 5 WHEN 0 THEN '/workspace/a' WHEN 1 THEN '/workspace/b' WHEN 2 THEN '/outside/x' WHEN 3 THEN '<redacted>' END END AS target""",
        """CASE WHEN NOT is_tool THEN NULL
             WHEN user_id % 5 = 0 AND event_id % 4 <> 0 THEN concat('p', micros div 86400000000 div 6)
             WHEN user_id % 5 = 0 AND event_id % 8 = 0 THEN '<redacted>' END AS progress""",
        "kind IN ('api_request', 'websocket_request') AS api",
        "(kind = 'api_request' AND k % 12 <> 5) OR kind = 'sse_event' AS counted",
        "(is_tool OR kind IN ('api_request', 'websocket_request')) AND k % 10 <> 9 AS timed",
        "floor(value * 20) AS duration",
        "CASE WHEN k % 11 <> 0 THEN concat('m', user_id % 3) END AS model",
        "CASE WHEN k % 8 <> 3 THEN concat('/w/', user_id % 5) END AS project",
    )
    record = {
        "position": "event_id + 1",
        "event_id": "concat('local:', event_id + 1)",
        "signal": "CASE event_id % 10 WHEN 8 THEN 'span' WHEN 9 THEN 'metric' ELSE 'log' END",
        "name": "CASE slot WHEN 0 THEN kind WHEN 1 THEN 'event callsite' ELSE full_name END",
        "source": "source",
        "time_unix_nano": "CASE WHEN slot <> 1 THEN nanos END",
        "observed_unix_nano": "nanos",
        "content_digest": "concat('sha256:', sha2(CAST(event_id AS STRING), 256))",
        "body": "CASE WHEN slot = 0 THEN full_name END",
        "attributes": _struct_text({**EVENT_ATTRIBUTES, **(attributes or {})}),
        "resource_attributes": _struct_text(EVENT_RESOURCE),
    }
    return staged.selectExpr(f"{_struct_text(record)} AS _record").selectExpr("inline(array(_record))")


def conversations_as_records(conversations: DataFrame) -> DataFrame:
    """Conversation turns as prompt and response logs with their reported length."""
    conversation, turn, role = C("conv_id"), C("turn"), C("role")
    kind = F.when(role == "user", "user_prompt").when(role == "assistant", "assistant_response").otherwise("system_note")
    position = conversation * TURN_POSITIONS + turn + 1
    length = F.char_length("text").cast("bigint")
    nanos = (F.lit(1704067200000000000) + (conversation * 1000 + turn + 1) * 1000000000).cast("string")
    return emit(
        conversations,
        position.alias("position"),
        F.concat(F.lit("local:"), position.cast("string")).alias("event_id"),
        F.lit("log").alias("signal"),
        F.concat(F.lit("claude_code."), kind).alias("name"),
        F.lit("claude-code").alias("source"),
        nanos.alias("time_unix_nano"),
        nanos.alias("observed_unix_nano"),
        _typed_struct(
            {
                "session.id": F.concat(F.lit("c"), conversation.cast("string")),
                "prompt_length": F.when(role == "user", length),
                "response_length": F.when(role == "assistant", length),
            }
        ).alias("attributes"),
    )


def pages_as_url_records(pages: DataFrame, namespace: str = "agent") -> DataFrame:
    """Web pages as URL observations, verdicts and operator exclusions."""
    page = C("page_id")
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    section = F.regexp_extract("url", r"^https?://[^/?#]+/[a-z]+", 0)
    whole = F.when(C("url").rlike(r"^https?://[^/?#]+"), C("url")).otherwise("")
    staged = pages.select("page_id", host.alias("host"), section.alias("section"), whole.alias("whole")).select(
        "*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part")
    )
    staged = staged.where(
        (C("part") == 0) | ((C("part") == 1) & (page % 3 == 0)) | ((C("part") == 2) & (page % 10 == 0))
    ).withColumn("at", F.lit(1704067200000000000) + page * 3600000000000 + C("part"))
    observation, verdict, exclusion = (C("part") == i for i in range(3))
    url = f"{namespace}.url"
    stem = F.when(observation, "observed").when(verdict, "reputation").otherwise("exclusion")
    declared = F.when(page % 5 == 0, F.concat(F.lit("evil."), C("host"))).when(page % 4 == 1, F.upper("host")).otherwise(
        C("host")
    )
    exclusion_id = F.when(page % 50 == 10, "builtin:local").otherwise(
        F.concat(F.lit("operator:"), (page % 4).cast("string"))
    )
    kind = (
        F.when(page % 40 == 30, "regex")
        .when(page % 3 == 0, "host-exact")
        .when(page % 3 == 1, "host-suffix")
        .otherwise("url-prefix")
    )
    pattern = (
        F.when(page % 3 == 0, F.upper("host"))
        .when(page % 3 == 1, F.concat(F.when(page % 2 == 0, ".").otherwise(""), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
        .otherwise(C("section"))
    )
    attributes = {
        "event.name": F.concat(F.lit(f"{url}."), stem),
        f"{url}.observed_full": F.when(~exclusion, C("whole")),
        f"{url}.host": F.when(observation, declared),
        f"{namespace}.harness": F.when(observation & (page % 6 == 0), "codex"),
        "session.id": F.when(observation & (page % 4 != 3), F.concat(F.lit("session-number-"), (page % 7).cast("string"))),
        "tool_name": F.when(observation & (page % 2 == 0), "web_fetch"),
        "project": F.when(observation & (page % 9 != 0), F.concat(F.lit("/w/"), (page % 3).cast("string"))).when(
            observation, ""
        ),
        f"{url}.exclusion.id": F.when(exclusion, exclusion_id),
        f"{url}.exclusion.kind": F.when(exclusion, kind),
        f"{url}.exclusion.pattern": F.when(exclusion, pattern),
        f"{url}.exclusion.enabled": F.when(exclusion, page % 20 == 0),
        f"{url}.checked_full": F.when(verdict, C("whole")),
        f"{url}.provider": F.when(verdict, F.when(page % 2 == 0, "safe-browsing-v5").otherwise("web-risk")),
        f"{url}.verdict": F.when(
            verdict, F.when(page % 9 == 0, "clean").when(page % 9 == 3, "suspected").otherwise("error")
        ),
        f"{url}.threat_types": F.when(verdict & (page % 9 == 3), '["MALWARE"]'),
        f"{url}.error": F.when(verdict & (page % 9 == 6), "provider timeout"),
        f"{url}.checked_unix_nano": F.when(verdict, C("at").cast("string")),
        f"{url}.valid_until_unix_nano": F.when(
            verdict, (C("at") + F.lit(86400000000000) * (1 + page % 5)).cast("string")
        ),
    }
    position = page * 3 + C("part") + 1
    return emit(
        staged,
        position.alias("position"),
        F.concat(F.lit("local:"), position.cast("string")).alias("event_id"),
        F.lit("log").alias("signal"),
        F.lit("url record").alias("name"),
        F.when(page % 2 == 0, "opencode").otherwise("codex_exec").alias("source"),
        C("at").cast("string").alias("time_unix_nano"),
        C("at").cast("string").alias("observed_unix_nano"),
        _typed_struct(attributes).alias("attributes"),
    )


def with_variant_attributes(records: DataFrame) -> DataFrame:
    """The same records with open VARIANT attributes; NULL fields become missing keys."""

    def opened(column: str) -> Column:
        fields = records.schema[column].dataType.fieldNames()
        entries = F.array(
            *[
                F.struct(F.lit(name).alias("key"), C(column).getField(name).cast("variant").alias("value"))
                for name in fields
            ]
        )
        return F.to_variant_object(
            F.map_from_entries(F.filter(entries, lambda entry: entry["value"].isNotNull()))
        ).alias(column)

    columns = [name for name in ("attributes", "resource_attributes") if name in records.columns]
    return records.withColumns({name: opened(name) for name in columns})
