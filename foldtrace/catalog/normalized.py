"""Registered queries of the normalizers (N) and the value helpers they use (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as values_kit
from ..functions.values import Attributes, first_existing, first_truthy
from ..operators import normalize_activity, normalize_guard, normalize_review, normalize_signal, normalize_url, normalize_usage
from ..operators.record_view import RecordView, effective_events
from ..session import tune
from ..sources.tables import read_table, with_variant_attributes
from . import oracle_base as O
from .folded import with_ctes
from .inputs import event_records, page_records

C = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NORMALIZERS = {
    "usage": normalize_usage,
    "activity": normalize_activity,
    "review": normalize_review,
    "guard": normalize_guard,
    "signal": normalize_signal,
}


def events(kind: str, *columns: str):
    def run(spark, directory) -> DataFrame:
        accepted = effective_events(NORMALIZERS[kind].normalize(event_records(spark, directory)))
        return accepted.select("position", *columns)

    return run


def register(name: str, query, *ctes_and_select: str) -> None:
    QUERIES[name] = query
    if ctes_and_select:
        *ctes, select = ctes_and_select
        ORACLE[name] = (with_ctes(*ctes) if ctes else "") + select


def _view(columns: list[str]):
    def run(spark, directory) -> DataFrame:
        view = RecordView(event_records(spark, directory))
        return view.frame.selectExpr("position", *columns)

    return run


register(
    "n01_semantic_name",
    _view(["_name AS event_name"]),
    O.REC,
    "SELECT position, CASE WHEN slot = 0 AND kind = 'other' THEN kind WHEN slot IN (0, 1) THEN full_name ELSE name END AS event_name FROM rec",
)
register("n02_harness", _view(["source", "harness"]), O.REC, "SELECT position, source, harness FROM rec")
register("n03_event_time", _view(["_time AS event_time"]), O.REC, "SELECT position, t AS event_time FROM rec")
register(
    "n04_session_identity",
    _view(["session_id", "_session_known AS session_known", "left(session_id, 12) AS session_id_prefix"]),
    O.REC,
    "SELECT position, session_id, session_known, left(session_id, 12) AS session_id_prefix FROM rec",
)
for key, columns in {
    "n05_event_family": ["event_family"],
    "n06_tool_bucket": ["tool_bucket"],
    "n07_endpoint_bucket": ["endpoint_bucket"],
    "n08_reported_length": ["reported_length", "length_coverage"],
    "n09_duration_truthy_chain": ["duration_milliseconds", "duration_coverage", "performance_event"],
    "n10_outcome": ["success_state"],
    "n12_token_coverage": ["token_coverage", "session_coverage"],
}.items():
    register(key, events("activity", *columns), O.REC, O.ACTIVITY, f"SELECT position, {', '.join(columns)} FROM activity")
register(
    "n09_duration_exists_chain",
    events("review", "duration_observed", "duration_milliseconds"),
    O.REC,
    O.REVIEW,
    "SELECT position, CAST(duration IS NOT NULL AS BIGINT) AS duration_observed, COALESCE(duration, 0) AS duration_milliseconds FROM review",
)
register(
    "n10_review_outcome",
    events("review", "success_state", "tool_event", "api_event"),
    O.REC,
    O.REVIEW,
    "SELECT position, success_state, CAST(tool_event AS BIGINT) AS tool_event, CAST(api_event AS BIGINT) AS api_event FROM review",
)
USAGE_COLUMNS = ["input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens", "cost_microusd"]
register(
    "n11_usage_counters",
    events("usage", *USAGE_COLUMNS),
    O.REC,
    O.USAGE,
    "SELECT position, input_tokens, output_tokens, COALESCE(cached, 0) AS cached_input_tokens, "
    "COALESCE(reasoning, 0) AS reasoning_output_tokens, cost AS cost_microusd FROM usage",
)
register(
    "n13_model_project",
    events("usage", "model", "project", "model_coverage", "project_coverage"),
    O.REC,
    O.USAGE,
    "SELECT position, COALESCE(model, 'unknown') AS model, COALESCE(project, 'unknown') AS project, "
    "CASE WHEN model IS NULL THEN 'unknown' ELSE 'observed' END AS model_coverage, "
    "CASE WHEN project IS NULL THEN 'unknown' ELSE 'observed' END AS project_coverage FROM usage",
)
register(
    "n14_guard_action",
    events(
        "guard",
        "tool",
        "target",
        "operation_kind",
        "success",
        "action_fingerprint",
        "progress_fingerprint",
        "progress_coverage",
        "tool_coverage",
        "target_coverage",
        "coverage_reason",
        "argument_digest",
    ),
    O.REC,
    O.GUARD,
    "SELECT position, tool, target_seen AS target, op AS operation_kind, success, action_fp AS action_fingerprint, "
    "progress_fp AS progress_fingerprint, CASE WHEN progress_seen THEN 'observed' ELSE 'unknown' END AS progress_coverage, "
    "tool_coverage, target_coverage, CASE WHEN tool_coverage <> 'observed' THEN tool_reason "
    "WHEN target_coverage <> 'observed' THEN target_reason ELSE 'required policy fields observed' END AS coverage_reason, "
    "'sha256:' || sha256(CAST(event_id AS VARCHAR)) AS argument_digest FROM guard",
)
register(
    "n15_failure_payload",
    events("guard", "command", "tool_arguments", "failure_detail"),
    O.REC,
    O.GUARD,
    "SELECT position, CASE WHEN success = FALSE THEN COALESCE(full_command, '') ELSE '' END AS command, "
    "CASE WHEN success = FALSE THEN COALESCE(arguments, '') ELSE '' END AS tool_arguments, "
    "CASE WHEN success = FALSE THEN COALESCE(error_message, '') ELSE '' END AS failure_detail FROM guard",
)
for key, columns in {
    "n16_utc_day": ["day_utc"],
    "n17_presence_flags": ["identity_metadata", "auth_metadata", "raw_prompt_content", "raw_tool_content"],
    "n18_risky_action": ["risky_action"],
}.items():
    register(
        key,
        events("review", *columns),
        O.REC,
        O.REVIEW,
        f"SELECT position, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)} FROM review",
    )


def _urls(family: str | None, *columns: str):
    def run(spark, directory) -> DataFrame:
        accepted = effective_events(normalize_url.normalize(page_records(spark, directory)))
        if family is not None:
            accepted = accepted.where(C("event_family") == family)
        return accepted.select("source_position", *columns)

    return run


URL_COLUMNS = {
    "n19_url_observation": ("observation", ["observed_full", "host", "harness", "session_id", "tool_name", "project"]),
    "n20_url_exclusion": ("exclusion", ["exclusion_id", "exclusion_kind", "exclusion_pattern", "exclusion_enabled"]),
    "n21_url_reputation": (
        "reputation",
        ["observed_full", "provider", "checked_full", "verdict", "threat_types", "error", "valid_until_unix_nano"],
    ),
    "n22_url_union": (None, ["event_family", "day_utc", "observed_full", "exclusion_id", "verdict", "event_time_unix_nano"]),
}
for key, (family, columns) in URL_COLUMNS.items():
    where = f" WHERE event_family = '{family}'" if family else ""
    register(key, _urls(family, *columns), O.URL, f"SELECT source_position, {', '.join(columns)} FROM urls{where}")
register(
    "n23_signal_passthrough",
    events("signal", "source", "signal", "event_name", "event_time_unix_nano"),
    O.REC,
    "SELECT position, source, signal, name AS event_name, t AS event_time_unix_nano FROM rec",
)


def _split(spark, directory) -> DataFrame:
    return (
        normalize_activity.normalize(event_records(spark, directory))
        .groupBy("signal")
        .agg(
            F.count(F.lit(1)).alias("consumed"),
            F.count_if(~C("effective")).alias("ineffective"),
            F.count_if("effective").alias("emitted"),
        )
    )


register(
    "n24_effective_split",
    _split,
    O.REC,
    O.ACTIVITY,
    "SELECT r.signal, count(*) AS consumed, count(*) - count(a.position) AS ineffective, count(a.position) AS emitted "
    "FROM rec r LEFT JOIN activity a ON a.position = r.position GROUP BY r.signal",
)


def per_unit_events(records: DataFrame) -> DataFrame:
    """A user normalizer that emits several events per record: one per counter it carries."""
    attrs = Attributes(records, "attributes")
    pairs = [
        F.when(attrs[key].exists, F.struct(F.lit(key).alias("counter"), attrs[key].number.alias("amount")))
        for key in ("input_tokens", "output_tokens", "cost_microusd")
    ]
    staged = records.select("position", "event_id", F.array_compact(F.array(*pairs)).alias("_events"))
    return staged.select("position", "event_id", F.posexplode("_events").alias("ordinal", "_event")).select(
        "position",
        F.concat_ws("#", "event_id", C("ordinal").cast("string")).alias("event_id"),
        "ordinal",
        "_event.counter",
        "_event.amount",
    )


register(
    "n25_user_normalizer",
    lambda spark, directory: per_unit_events(event_records(spark, directory)),
    O.REC,
    "SELECT position, 'local:' || position || '#' || ordinal AS event_id, ordinal, counter, amount FROM ("
    "SELECT position, counter, CAST(amount AS DOUBLE) AS amount, CAST(row_number() OVER (PARTITION BY position ORDER BY o) - 1 AS INT) AS ordinal FROM ("
    "SELECT position, 0 AS o, 'input_tokens' AS counter, input_tokens AS amount FROM rec WHERE slot <> 1 "
    "UNION ALL SELECT position, 1, 'output_tokens', output_tokens FROM rec WHERE slot <> 1 "
    "UNION ALL SELECT position, 2, 'cost_microusd', cost_micro FROM rec) WHERE amount IS NOT NULL)",
)


# -- value helpers over open attributes ----------------------------------------------


def _open(spark, directory) -> tuple[DataFrame, Attributes]:
    records = with_variant_attributes(event_records(spark, directory))
    return records, Attributes(records, "attributes")


def helper(build):
    def run(spark, directory) -> DataFrame:
        records, attrs = _open(spark, directory)
        return records.select("position", *[column.alias(name) for name, column in build(attrs).items()])

    return run


register(
    "x01_lookup",
    helper(lambda a: {"tool": a["tool_name"].text, "k": a["input_tokens"].number}),
    O.REC,
    "SELECT position, CASE WHEN slot = 0 THEN upper(tool) ELSE tool END AS tool, "
    "CASE WHEN slot <> 1 THEN CAST(input_tokens AS DOUBLE) END AS k FROM rec",
)
register(
    "x02_exists_chain",
    helper(
        lambda a: {
            "has_success": a["success"].exists,
            "duration": first_existing(a["duration_ms"], a["latency_ms"], a["ttft_ms"]).number,
        }
    ),
    O.REC,
    "SELECT position, success IS NOT NULL AS has_success, CAST(duration AS DOUBLE) AS duration FROM rec",
)
register(
    "x03_truthy_chain",
    helper(
        lambda a: {
            "has_length": a["prompt_length"].truthy,
            "succeeded": a["success"].truthy,
            "session": first_truthy(a["session.id"], a["conversation.id"], a["session_id"]).text,
        }
    ),
    O.REC,
    "SELECT position, COALESCE(kind = 'user_prompt' AND k <> 0, FALSE) AS has_length, COALESCE(success, FALSE) AS succeeded, "
    "sess AS session FROM rec",
)
register(
    "x04_text",
    helper(lambda a: {"success": a["success"].text, "tokens": a["output_tokens"].text, "model": a["model"].text}),
    O.REC,
    "SELECT position, CAST(success AS VARCHAR) AS success, CASE WHEN slot <> 1 THEN CAST(output_tokens AS VARCHAR) END AS tokens, "
    "CASE WHEN slot <> 2 THEN model END AS model FROM rec",
)
register(
    "x05_number",
    helper(
        lambda a: {
            "flag": a["success"].number,
            "bad": F.coalesce(a["tool_name"].number_error, F.lit(False)),
            "usd": a["cost_usd"].number,
        }
    ),
    O.REC,
    "SELECT position, CASE WHEN success THEN 1.0::DOUBLE WHEN NOT success THEN 0.0::DOUBLE END AS flag, tool IS NOT NULL AS bad, cost_usd AS usd FROM rec",
)


def _numbers(spark, directory) -> DataFrame:
    tune(spark)
    return read_table(spark, directory, "events")


register(
    "x06_round_half_even",
    lambda spark, directory: _numbers(spark, directory).select(
        "event_id",
        values_kit.round_half_even(F.floor(C("value") * 4) / 4).alias("quarter_rounded"),
        values_kit.round_half_even(C("value") / F.lit(0.000001)).alias("micros"),
    ),
    "SELECT event_id, round_even(floor(value * 4) / 4, 0) AS quarter_rounded, round_even(value / 0.000001::DOUBLE, 0) AS micros FROM events",
)
register(
    "x07_floor_ceil_abs",
    lambda spark, directory: _numbers(spark, directory).select(
        "event_id",
        F.floor("value").alias("low"),
        F.ceil("value").alias("high"),
        F.abs(C("value") - 100).alias("distance"),
    ),
    "SELECT event_id, CAST(floor(value) AS BIGINT) AS low, CAST(ceil(value) AS BIGINT) AS high, abs(value - 100) AS distance FROM events",
)
register(
    "x08_text_functions",
    lambda spark, directory: _numbers(spark, directory).select(
        "event_id",
        F.char_length("props").alias("size"),
        F.substring("event_type", 1, 3).alias("head"),
        F.upper("event_type").alias("upper"),
        C("props").contains("9").alias("has_nine"),
        C("props").rlike(r'"k": [0-9]}$').alias("one_digit"),
    ),
    "SELECT event_id, CAST(length(props) AS INT) AS size, left(event_type, 3) AS head, upper(event_type) AS upper, "
    "contains(props, '9') AS has_nine, regexp_matches(props, '\"k\": [0-9]}$') AS one_digit FROM events",
)


def _word_arrays(spark, directory) -> DataFrame:
    tune(spark)
    return read_table(spark, directory, "conversations").select(
        "conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.char_length(w).cast("bigint")).alias("sizes")
    )


register(
    "x09_array_totals",
    lambda spark, directory: _word_arrays(spark, directory).select(
        "conv_id",
        "turn",
        F.size("sizes").cast("bigint").alias("n"),
        F.aggregate("sizes", F.lit(0).cast("bigint"), lambda total, x: total + x).alias("total"),
        F.array_max("sizes").alias("longest"),
        F.array_min("sizes").alias("shortest"),
    ),
    "SELECT conv_id, turn, len(s) AS n, CAST(list_sum(s) AS BIGINT) AS total, CAST(list_max(s) AS BIGINT) AS longest, "
    "CAST(list_min(s) AS BIGINT) AS shortest FROM (SELECT conv_id, turn, [length(x) FOR x IN string_split(text, ' ')] AS s FROM conversations)",
)
register(
    "x10_predicate_filter",
    lambda spark, directory: _word_arrays(spark, directory).select(
        "conv_id",
        "turn",
        F.array_join(
            F.transform(F.filter("sizes", lambda x: x > 8), lambda x: (x * 2).cast("string")), ","
        ).alias("doubled"),
    ),
    "SELECT conv_id, turn, array_to_string([CAST(length(x) * 2 AS VARCHAR) FOR x IN string_split(text, ' ') IF length(x) > 8], ',') AS doubled FROM conversations",
)
register(
    "x11_concat_arithmetic",
    lambda spark, directory: _numbers(spark, directory).select(
        "event_id",
        F.concat(F.lit("unknown:"), "event_type").alias("label"),
        (C("value") / F.lit(4.0) + 1 - C("user_id")).alias("mixed"),
    ),
    "SELECT event_id, 'unknown:' || event_type AS label, value / 4.0::DOUBLE + 1 - user_id AS mixed FROM events",
)
register(
    "x12_codec",
    lambda spark, directory: _numbers(spark, directory).select(
        "event_id",
        values_kit.wrap_integer(values_kit.exact_product(C("event_id"), 3000000000000)).alias("wrapped"),
        values_kit.wrap_bytes(C("event_type").cast("binary")).alias("bytes"),
        values_kit.finite(C("value") / F.nullif(C("event_id") % 2, F.lit(0))).alias("finite"),
    ),
    "SELECT event_id, CASE WHEN event_id * 3000000000000 > 9007199254740991 THEN '{\"integer_decimal\":\"' || (event_id * 3000000000000) || '\"}' "
    "ELSE CAST(event_id * 3000000000000 AS VARCHAR) END AS wrapped, '{\"bytes_base64\":\"' || to_base64(encode(event_type)) || '\"}' AS bytes, "
    "CASE WHEN event_id % 2 = 1 THEN value END AS finite FROM events",
)
