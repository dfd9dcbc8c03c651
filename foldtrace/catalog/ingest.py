"""Registered queries of ingest (S): requests are built from the events table, then decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import apps
from ..session import tune
from ..sources import otlp
from ..sources.tables import read_table
from .inputs import event_records

C = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PER_REQUEST = 50

# One request holds 50 events.  Of damaged requests every 7th is cut off, and every 11th repeats
# an attribute key.  A protocol integer has 64 bits: a product beyond them is sent as text.
_PRODUCT = "CAST(event_id AS DECIMAL(19, 0)) * 3000000000000"
_VALUES = {
    "'session.id'": "named_struct('stringValue', concat('s', user_id))",
    "'event.name'": "named_struct('stringValue', event_type)",
    "'k'": "named_struct('intValue', get_json_object(props, '$.k'))",
    "'big'": f"map(IF({_PRODUCT} BETWEEN {-(2**63)}BD AND {2**63 - 1}BD, 'intValue', 'stringValue'), CAST({_PRODUCT} AS STRING))",
    "'value'": "named_struct('doubleValue', value)",
    "'odd'": "named_struct('boolValue', event_id % 2 = 1)",
    "'pair'": "named_struct('arrayValue', named_struct('values', array(named_struct('intValue', CAST(user_id AS STRING)), "
    "named_struct('intValue', '7'))))",
    "'bytes'": "named_struct('bytesValue', base64(CAST(event_type AS BINARY)))",
}


def _listed(values: dict[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('key', {key}, 'value', to_variant_object({value}))" for key, value in values.items()) + ")"


ATTRIBUTES = _listed(_VALUES)
TWICE = ATTRIBUTES.replace("'key', 'bytes'", "'key', IF(event_id div 50 % 11 = 5 AND event_id % 50 = 9, 'k', 'bytes')")


def _nested(levels: int) -> str:
    value = "named_struct('intValue', CAST(user_id AS STRING))"
    for _ in range(levels):
        value = f"named_struct('arrayValue', named_struct('values', array({value})))"
        value = f"named_struct('kvlistValue', named_struct('values', array(named_struct('key', 'in', 'value', {value}))))"
    return value


# Six containers in each other.
DEEP = _listed({"'deep'": _nested(3)})
NANOS = "CAST(unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS STRING)"
ITEMS = {
    "log": (
        "resourceLogs",
        "scopeLogs",
        "logRecords",
        f"named_struct('timeUnixNano', IF(event_id % 5 = 0, '0', {NANOS}), 'observedTimeUnixNano', {NANOS}, "
        "'eventName', IF(event_id % 3 = 0, concat('log.', event_type), ''), 'severityNumber', event_id % 25, "
        "'body', named_struct('stringValue', props), 'attributes', attributes)",
    ),
    "span": (
        "resourceSpans",
        "scopeSpans",
        "spans",
        "named_struct('traceId', base64(unhex(lpad(hex(event_id), 32, '0'))), 'spanId', base64(unhex(lpad(hex(user_id), 16, '0'))), "
        f"'name', concat('run ', event_type), 'kind', event_id % 6, 'startTimeUnixNano', {NANOS}, 'attributes', attributes)",
    ),
    "metric": (
        "resourceMetrics",
        "scopeMetrics",
        "metrics",
        "IF(event_id % 2 = 0, to_json(named_struct('name', event_type, 'unit', 'u', 'sum', named_struct('aggregationTemporality', 2, 'isMonotonic', true, "
        f"'dataPoints', array(named_struct('timeUnixNano', {NANOS}, 'asInt', '1', 'attributes', attributes))))), "
        "to_json(named_struct('name', event_type, 'gauge', named_struct('dataPoints', array("
        f"named_struct('timeUnixNano', {NANOS}, 'asDouble', value, 'attributes', attributes), named_struct('timeUnixNano', '0', 'asDouble', 0.5D, 'attributes', slice(attributes, 1, 0)))))))",
    ),
}
_POINT = f"'timeUnixNano', {NANOS}, 'count', CAST(user_id AS STRING), 'sum', value, 'attributes', attributes"
_BUCKETS = "named_struct('offset', 1, 'bucketCounts', array(CAST(user_id AS STRING)))"
_KINDS = {
    0: f"named_struct('name', event_type, 'histogram', named_struct('aggregationTemporality', 'AGGREGATION_TEMPORALITY_DELTA', 'dataPoints', "
    f"array(named_struct({_POINT}, 'bucketCounts', array('0', CAST(user_id AS STRING)), 'explicitBounds', array(value)))))",
    1: f"named_struct('name', event_type, 'exponentialHistogram', named_struct('aggregationTemporality', 2, 'dataPoints', array(named_struct({_POINT}, 'scale', -1, 'positive', {_BUCKETS}))))",
    2: f"named_struct('name', event_type, 'summary', named_struct('dataPoints', array(named_struct({_POINT}, 'quantileValues', array(named_struct('quantile', 0.5D, 'value', value))))))",
}
DISTRIBUTIONS = "CASE event_id % 3 " + " ".join(f"WHEN {k} THEN to_json({item})" for k, item in _KINDS.items()) + " END"


def event_requests(
    spark, directory: str, signal: str, attributes: str = ATTRIBUTES, item: str | None = None, line: str = "event_id div 50", damaged: bool = False
) -> DataFrame:
    """OTLP request texts made of the events."""
    tune(spark)
    groups, scopes, items, standard = ITEMS[signal]
    text = item or (standard if signal == "metric" else f"to_json({standard})")
    events = read_table(spark, directory, "events").selectExpr("*", f"{attributes} AS attributes")
    lines = events.selectExpr(f"{line} AS request_line", "event_id", f"{text} AS item")
    bodies = lines.groupBy("request_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]), ",").alias("items")
    )
    resource = F.when(C("request_line") % 4 == 3, F.lit("{}")).otherwise(
        F.concat(
            F.lit('{"attributes":[{"key":"service.name","value":{"stringValue":"svc'),
            (C("request_line") % 3).cast("string"),
            F.lit('"}}]}'),
        )
    )
    body = F.concat(
        F.lit(f'{{"{groups}":[{{"resource":'), resource, F.lit(f',"{scopes}":[{{"scope":{{"name":"demo"}},"{items}":['), C("items"), F.lit("]}]}]}")
    )
    cut = F.when(C("request_line") % 7 == 3, F.substring(body, 1, 40)).otherwise(body) if damaged else body
    # Blocks of 64 requests stand for input splits.
    return bodies.select(
        F.lpad(F.expr("request_line div 64").cast("string"), 12, "0").alias("request_block"),
        "request_line",
        F.lit(signal).alias("signal"),
        cut.alias("body"),
    )


def canonical(spark, directory: str, signal: str = "log", **built) -> DataFrame:
    return otlp.canonicalize(event_requests(spark, directory, signal, **built), (signal,))


def damaged(spark, directory: str) -> DataFrame:
    return canonical(spark, directory, attributes=TWICE, damaged=True)


def positioned(spark, directory: str, signal: str = "log", **built) -> DataFrame:
    return otlp.positioned_records(canonical(spark, directory, signal, **built))


def attribute(key: str, kind: str = "string"):
    return F.try_variant_get("attributes", f'$["{key}"]', kind)


GOOD = """good AS (
  SELECT *, event_id // 50 AS request, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS nanos
  FROM events)"""
SOURCE = "CASE WHEN request % 4 = 3 THEN 'unknown' ELSE 'svc' || (request % 3) END"


def register(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE[name] = oracle


register(
    "s01_log_records",
    lambda s, d: positioned(s, d).select(
        "position", "event_id", "signal", "name", "source", "time_unix_nano", "observed_unix_nano",
        attribute("session.id").alias("session"), F.try_variant_get("body", "$", "string").alias("body"),
        F.try_variant_get("record", "$.severity_number", "string").alias("severity"),
    ),
    f"WITH {GOOD} SELECT row_number() OVER (ORDER BY event_id) AS position, 'local:' || row_number() OVER (ORDER BY event_id) AS event_id, 'log' AS signal, "
    f"CASE WHEN g.event_id % 3 = 0 THEN 'log.' || event_type ELSE event_type END AS name, {SOURCE} AS source, "
    "CASE WHEN g.event_id % 5 <> 0 THEN nanos END AS time_unix_nano, nanos AS observed_unix_nano, 's' || user_id AS session, props AS body, "
    "CASE WHEN g.event_id % 25 = 0 THEN 'SEVERITY_NUMBER_UNSPECIFIED' ELSE 'SEVERITY_NUMBER_' || "
    "['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][CAST((g.event_id % 25 - 1) // 4 + 1 AS INT)] || "
    "['', '2', '3', '4'][CAST((g.event_id % 25 - 1) % 4 + 1 AS INT)] END AS severity FROM good g".replace(
        "ORDER BY event_id", "ORDER BY g.event_id"
    ),
)
ORACLE["s01_log_records"] = ORACLE["s01_log_records"].replace("ORDER BY event_id", "ORDER BY g.event_id")
register(
    "s02_span_records",
    lambda s, d: positioned(s, d, "span").select(
        "position", "name", "source", "time_unix_nano", "trace_id", "span_id",
        F.try_variant_get("record", "$.kind", "string").alias("kind"),
    ),
    f"WITH {GOOD} SELECT row_number() OVER (ORDER BY event_id) AS position, 'run ' || event_type AS name, {SOURCE} AS source, nanos AS time_unix_nano, "
    "lower(lpad(hex(event_id), 32, '0')) AS trace_id, lower(lpad(hex(user_id), 16, '0')) AS span_id, "
    "'SPAN_KIND_' || ['UNSPECIFIED', 'INTERNAL', 'SERVER', 'CLIENT', 'PRODUCER', 'CONSUMER'][CAST(event_id % 6 + 1 AS INT)] AS kind FROM good",
)
register(
    "s03_metric_points",
    lambda s, d: otlp.admitted(canonical(s, d, "metric")).select(
        "request_line", "name", "time_unix_nano",
        *[F.try_variant_get("record", f"$.metric.{key}", "string").alias(key) for key in ("point_type", "unit", "aggregation_temporality", "is_monotonic")],
    ),
    f"WITH {GOOD} SELECT request AS request_line, event_type AS name, nanos AS time_unix_nano, CASE WHEN event_id % 2 = 0 THEN 'sum' ELSE 'gauge' END AS point_type, "
    "CASE WHEN event_id % 2 = 0 THEN 'u' ELSE '' END AS unit, CASE WHEN event_id % 2 = 0 THEN 'AGGREGATION_TEMPORALITY_CUMULATIVE' END AS aggregation_temporality, "
    "CASE WHEN event_id % 2 = 0 THEN 'true' END AS is_monotonic FROM good "
    "UNION ALL SELECT request, event_type, NULL, 'gauge', '', NULL, NULL FROM good WHERE event_id % 2 = 1",
)
register(
    "s04_any_values",
    lambda s, d: positioned(s, d).select(
        "position",
        attribute("k", "bigint").alias("k"),
        attribute("value", "double").alias("value"),
        attribute("odd", "boolean").alias("odd"),
        F.coalesce(F.try_variant_get("attributes", "$.big.integer_decimal", "string"), attribute("big")).alias("big"),
        F.to_json(F.try_variant_get("attributes", "$.pair", "variant")).alias("pair"),
        F.try_variant_get("attributes", "$.bytes.bytes_base64", "string").alias("bytes"),
    ),
    f"WITH {GOOD} SELECT row_number() OVER (ORDER BY event_id) AS position, k, value, event_id % 2 = 1 AS odd, CAST(event_id * 3000000000000 AS VARCHAR) AS big, "
    "'[' || user_id || ',7]' AS pair, to_base64(encode(event_type)) AS bytes FROM good",
)
register(
    "s03_distribution_points",
    lambda s, d: otlp.admitted(canonical(s, d, "metric", item=DISTRIBUTIONS)).select(
        "request_line", "name", "time_unix_nano",
        *[F.try_variant_get("record", f"$.metric.{key}", "string").alias(key) for key in ("point_type", "aggregation_temporality")],
        F.try_variant_get("record", "$.otel.count", "bigint").alias("count"), F.try_variant_get("record", "$.otel.sum", "double").alias("sum"),
    ),
    f"WITH {GOOD} SELECT request AS request_line, event_type AS name, nanos AS time_unix_nano, ['histogram', 'exponential_histogram', 'summary'][event_id % 3 + 1] AS point_type, "
    "['AGGREGATION_TEMPORALITY_DELTA', 'AGGREGATION_TEMPORALITY_CUMULATIVE', NULL][event_id % 3 + 1] AS aggregation_temporality, nullif(user_id, 0) AS count, "
    "CASE WHEN event_id % 3 = 2 THEN nullif(value, 0) ELSE value END AS sum FROM good",
)
register(
    "s04_deep_values",
    lambda s, d: positioned(s, d, attributes=DEEP).select("position", F.to_json(F.try_variant_get("attributes", "$.deep", "variant")).alias("deep")),
    """SELECT row_number() OVER (ORDER BY event_id) AS position, '{"in":[{"in":[{"in":[' || user_id || ']}]}]}' AS deep FROM events""",
)
register(
    "s05_rejected_attributes",
    lambda s, d: otlp.rejected(damaged(s, d)).where("rejected LIKE 'record:%'").select("request_line", "rejected"),
    "SELECT DISTINCT event_id // 50 AS request_line, 'record: attribute key is duplicated' AS rejected FROM events "
    "WHERE event_id // 50 % 11 = 5 AND event_id // 50 % 7 <> 3",
)
register(
    "s06_resource_scope",
    lambda s, d: positioned(s, d).select(
        "position",
        F.to_json(F.try_variant_get("record", "$.resource", "variant")).alias("resource"),
        F.to_json(F.try_variant_get("record", "$.scope", "variant")).alias("scope"),
    ),
    f"""WITH {GOOD} SELECT row_number() OVER (ORDER BY event_id) AS position, '{{"attributes":' || CASE WHEN request % 4 = 3 THEN '{{}}'
      ELSE '{{"service.name":"svc' || (request % 3) || '"}}' END || ',"dropped_attributes_count":0,"schema_url":""}}' AS resource,
      '{{"attributes":{{}},"dropped_attributes_count":0,"name":"demo","schema_url":"","version":""}}' AS scope FROM good""",
)
register(
    "s07_source_names",
    lambda s, d: positioned(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("records")),
    f"WITH {GOOD} SELECT {SOURCE} AS source, count(*) AS records FROM good GROUP BY 1",
)
register(
    "s08_log_event_names",
    lambda s, d: positioned(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("records")),
    f"WITH {GOOD} SELECT CASE WHEN event_id % 3 = 0 THEN 'log.' || event_type ELSE event_type END AS name, count(*) AS records FROM good GROUP BY 1",
)
register(
    "s09_optional_times",
    lambda s, d: positioned(s, d).agg(F.count("time_unix_nano").alias("timed"), F.count("observed_unix_nano").alias("observed"), F.count("trace_id").alias("traced")),
    f"WITH {GOOD} SELECT count(*) FILTER (event_id % 5 <> 0) AS timed, count(*) AS observed, 0 AS traced FROM good",
)
_SEVERITY = (
    "'SEVERITY_NUMBER_' || ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][CAST((event_id % 25 - 1) // 4 + 1 AS INT)] || "
    "['', '2', '3', '4'][CAST((event_id % 25 - 1) % 4 + 1 AS INT)]"
)
_BIG = "CASE WHEN event_id * 3000000000000 > 9007199254740991 THEN '{\"integer_decimal\":\"' || event_id * 3000000000000 || '\"}' ELSE (event_id * 3000000000000)::VARCHAR END"
register(
    "s10_content_digest",
    lambda s, d: positioned(s, d).select("position", "content_digest", "canonical_bytes"),
    f"""WITH {GOOD}, part AS (SELECT *, to_base64(encode(event_type)) AS b64, CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END AS odd, to_json(props)::VARCHAR AS body,
        CASE WHEN event_id % 25 > 0 THEN {_SEVERITY} END AS severity FROM good),
    texts AS (SELECT event_id, '{{"attributes":{{"big":' || {_BIG} || ',"bytes":{{"bytes_base64":"' || b64 || '"}},"event.name":"' || event_type || '","k":' || k ||
        ',"odd":' || odd || ',"pair":[' || user_id || ',7],"session.id":"s' || user_id || '","value":' || value || '}},"body":' || body ||
        ',"dropped_attributes_count":0,"flags":0,"otel":{{"attributes":[' ||
        '{{"key":"session.id","value":{{"string_value":"s' || user_id || '"}}}},{{"key":"event.name","value":{{"string_value":"' || event_type || '"}}}},' ||
        '{{"key":"k","value":{{"int_value":"' || k || '"}}}},{{"key":"big","value":{{"int_value":"' || event_id * 3000000000000 || '"}}}},' ||
        '{{"key":"value","value":{{"double_value":' || value || '}}}},{{"key":"odd","value":{{"bool_value":' || odd || '}}}},' ||
        '{{"key":"pair","value":{{"array_value":{{"values":[{{"int_value":"' || user_id || '"}},{{"int_value":"7"}}]}}}}}},' ||
        '{{"key":"bytes","value":{{"bytes_value":"' || b64 || '"}}}}],"body":{{"string_value":' || body || '}}' ||
        CASE WHEN event_id % 3 = 0 THEN ',"event_name":"log.' || event_type || '"' ELSE '' END || ',"observed_time_unix_nano":"' || nanos || '"' ||
        coalesce(',"severity_number":"' || severity || '"', '') || CASE WHEN event_id % 5 <> 0 THEN ',"time_unix_nano":"' || nanos || '"' ELSE '' END ||
        '}},"resource":{{"attributes":' || CASE WHEN request % 4 = 3 THEN '{{}}' ELSE '{{"service.name":"svc' || (request % 3) || '"}}' END ||
        ',"dropped_attributes_count":0,"schema_url":""}},"scope":{{"attributes":{{}},"dropped_attributes_count":0,"name":"demo","schema_url":"","version":""}},' ||
        '"severity_number":"' || coalesce(severity, 'SEVERITY_NUMBER_UNSPECIFIED') || '","severity_text":""}}' AS j FROM part)
    SELECT row_number() OVER (ORDER BY event_id) AS position, 'sha256:' || sha256(j) AS content_digest, strlen(j)::BIGINT AS canonical_bytes FROM texts""",
)
# A request per user: some hold more records than this bound, some do not.
FEW = 60
register(
    "s11_record_bounds",
    lambda s, d: otlp.canonicalize(event_requests(s, d, "log", line="user_id"), ("log",), otlp.Limits(request_records=FEW)).select(
        "request_line", F.coalesce(F.size("records"), F.lit(0)).cast("bigint").alias("records"), "rejected"
    ),
    f"SELECT user_id AS request_line, CASE WHEN count(*) > {FEW} THEN 0 ELSE count(*) END AS records, "
    f"CASE WHEN count(*) > {FEW} THEN 'request exceeds the record limit' END AS rejected FROM events GROUP BY 1",
)
register(
    "s12_atomic_admission",
    lambda s, d: damaged(s, d).groupBy("rejected").agg(F.count(F.lit(1)).alias("requests")),
    "SELECT CASE WHEN r % 7 = 3 THEN 'malformed request' WHEN r % 11 = 5 THEN 'record: attribute key is duplicated' END AS rejected, count(*) AS requests "
    "FROM (SELECT DISTINCT event_id // 50 AS r FROM events) GROUP BY 1",
)
register(
    "s13_positions",
    lambda s, d: otlp.assign_positions(damaged(s, d), base=1000).select("request_line", "first_position"),
    "WITH n AS (SELECT event_id // 50 AS request_line, CASE WHEN event_id // 50 % 7 = 3 OR event_id // 50 % 11 = 5 THEN 0 ELSE count(*) END AS c FROM events GROUP BY 1) "
    "SELECT request_line, CAST(1001 + COALESCE(sum(c) OVER (ORDER BY request_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_position FROM n",
)


def fan_out(spark, directory) -> DataFrame:
    """Records every app used, of the same records."""
    records = event_records(spark, directory)
    parts = []
    for name in ("signal-counts", "session-cost", "daily-review", "agent-guard"):
        used = apps.SHIPPED[name]().normalize(records)
        parts.append(used.agg(F.lit(name).alias("app"), F.count(F.lit(1)).alias("consumed"), F.count_if("effective").alias("emitted")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.select("app", "consumed", "emitted")


QUERIES["s14_fan_out"] = fan_out


def _fan_out_oracle() -> str:
    from . import oracle_base as O
    from .folded import with_ctes

    counts = {"signal-counts": "rec", "session-cost": "usage", "daily-review": "review", "agent-guard": "guard"}
    return with_ctes(O.REC, O.USAGE, O.REVIEW, O.GUARD) + " UNION ALL ".join(
        f"SELECT '{app}' AS app, (SELECT count(*) FROM rec) AS consumed, (SELECT count(*) FROM {cte}) AS emitted"
        for app, cte in counts.items()
    )


ORACLE["s14_fan_out"] = _fan_out_oracle()
