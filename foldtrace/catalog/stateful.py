"""Registered queries of generic folds (G), lifecycle (L) and the query surface (Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as values_kit
from ..operators import app_folds, changes, custom, guard_folds, normalize_activity, normalize_guard, normalize_usage, validate
from ..operators.record_view import effective_events
from ..plans import apps, serve
from ..session import tune
from ..sources.tables import events_as_records, read_table
from ..streaming import lifecycle
from . import oracle_base as O
from .folded import BASES, ORACLE as FOLDED_ORACLE, oracle, with_ctes
from .inputs import event_records, tables_of

C = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = query
    if text is not None:
        ORACLE[name] = text


# -- generic folds -----------------------------------------------------------------

OPS = "CASE event_type WHEN 'purchase' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'upsert' END"
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def ledger(spark, directory: str, op: str = OPS) -> DataFrame:
    """Events as ordered changes of a table keyed by user."""
    tune(spark)
    return read_table(spark, directory, "events").selectExpr(
        "user_id AS key",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS balance",
        "event_id + 1 AS position",
        "0 AS ordinal",
        "0 AS step",
        f"{op} AS op",
    )


CHANGES = f"changes AS (SELECT user_id AS key, {K} AS balance, event_id + 1 AS position, {OPS} AS op FROM events)"
CUSTOMER = "c_custkey AS user_id, c_nationkey AS nation, c_acctbal AS balance"


def _events_and_customers(spark, directory):
    tune(spark)
    events = read_table(spark, directory, "events").select("event_id", "user_id")
    return events, read_table(spark, directory, "customer").selectExpr(*[part.strip() for part in CUSTOMER.split(",")])


def _optional(spark, directory):
    events, customers = _events_and_customers(spark, directory)
    return changes.lookup(events, customers.select("user_id", "nation"), ["user_id"])


def _exactly_one(spark, directory):
    events, customers = _events_and_customers(spark, directory)
    return changes.lookup_one(events, customers, ["user_id"]).select("event_id", "error_reason")


def _view_read(spark, directory):
    events, customers = _events_and_customers(spark, directory)
    return changes.lookup(events, customers.where("balance > 0").select("user_id", "nation"), ["user_id"])


register(
    "g01_optional_read",
    _optional,
    "SELECT e.event_id, e.user_id, c.c_custkey IS NOT NULL AS read_found, c.c_nationkey AS read_nation FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id",
)
register(
    "g02_read_one",
    _exactly_one,
    "SELECT e.event_id, CASE WHEN c.c_custkey IS NULL THEN 'read ONE: expected exactly one row' END AS error_reason FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id",
)


def _many(spark, directory):
    rows = ledger(spark, directory)
    return changes.many_read(rows, rows, ["key"], "balance", 5).select(
        "key", "position", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values")
    )


register(
    "g03_many_read",
    _many,
    f"WITH {CHANGES} SELECT key, position, COALESCE(array_to_string(list_sort(list(balance) OVER (PARTITION BY key ORDER BY position "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))[1:5], ','), '') AS values FROM changes",
)
register(
    "g04_view_read",
    _view_read,
    "SELECT e.event_id, e.user_id, c.c_custkey IS NOT NULL AS read_found, c.c_nationkey AS read_nation FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0",
)
register(
    "g05_upsert",
    lambda s, d: changes.apply_changes(ledger(s, d, "'upsert'"), ["key"]),
    f"WITH {CHANGES} SELECT key, arg_max(balance, position) AS balance FROM changes GROUP BY key",
)
register(
    "g06_insert_conflicts",
    lambda s, d: changes.insert_conflicts(ledger(s, d), ["key"]),
    f"WITH {CHANGES} SELECT position, key, 'insert: UNIQUE constraint failed' AS reason FROM "
    "(SELECT *, lag(op) OVER (PARTITION BY key ORDER BY position) AS before FROM changes) WHERE op = 'insert' AND before <> 'delete'",
)
register(
    "g07_delete",
    lambda s, d: changes.apply_changes(ledger(s, d), ["key"]),
    f"WITH {CHANGES} SELECT key, balance FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY position DESC) = 1 AND op <> 'delete'",
)


def _ordered_ops(spark, directory):
    rows = ledger(spark, directory, "'upsert'")
    removal = rows.where("balance % 10 = 0").withColumn("op", F.lit("delete"))
    return changes.apply_changes(rows.unionByName(removal), ["key"])


register(
    "g08_change_order",
    _ordered_ops,
    f"WITH {CHANGES} SELECT key, balance FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY position DESC) = 1 AND balance % 10 <> 0",
)


def _validated(spark, directory):
    tune(spark)
    rows = read_table(spark, directory, "events").selectExpr(
        "event_id",
        "CAST(event_type AS VARIANT) AS label",
        "IF(event_type = 'view', CAST(value AS VARIANT), CAST(user_id AS VARIANT)) AS amount",
        "IF(event_type = 'error', CAST(event_type AS VARIANT), CAST(value > 100 AS VARIANT)) AS flag",
    )
    declared = {"label": ("TEXT", True), "amount": ("INTEGER", True), "flag": ("BOOLEAN", False)}
    return validate.validate_rows(rows, declared).select("event_id", "error_reason")


register(
    "g09_row_validation",
    _validated,
    "SELECT event_id, CASE WHEN event_type = 'view' AND value <> floor(value) THEN 'column \"amount\": must be an exactly representable JSON integer' "
    "WHEN event_type = 'error' THEN 'column \"flag\": must be boolean' END AS error_reason FROM events",
)
register(
    "g10_input_bounds",
    lambda s, d: read_table(tune(s), d, "documents").select("doc_id", validate.oversized(C("text"), 8192).alias("error_reason")),
    "SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'input exceeds 8192 bytes' END AS error_reason FROM documents",
)


def count_switches(state, event):
    last, switches = state or (None, 0)
    return event["op"], switches + (last is not None and last != event["op"])


register(
    "g12_ordered_user_fold",
    lambda s, d: custom.ordered_fold(
        ledger(s, d), ["key"], ["position"], count_switches, lambda state: {"switches": state[1], "last_op": state[0]},
        "key long, switches long, last_op string", ["op"],
    ),
    f"WITH {CHANGES} SELECT key, count(*) FILTER (op <> before) AS switches, arg_max(op, position) AS last_op FROM "
    "(SELECT *, lag(op) OVER (PARTITION BY key ORDER BY position) AS before FROM changes) GROUP BY key",
)
register(
    "g13_check_violations",
    lambda s, d: changes.running_total(ledger(s, d).withColumn("delta", C("balance") - 50), ["key"], "delta", "position")
    .where("_running < 0")
    .select("key", "position", C("_running").alias("running")),
    f"WITH {CHANGES} SELECT key, position, running FROM (SELECT key, position, CAST(sum(balance - 50) OVER (PARTITION BY key ORDER BY position) AS BIGINT) AS running FROM changes) WHERE running < 0",
)

# -- lifecycle ---------------------------------------------------------------------

FRONTIER_SCHEMA = (
    "app string, position long, complete boolean, gap_position long, consumed long, ineffective long, emitted long, detached long"
)
# Durations above this value arrive with a fraction, which the activity app cannot hold.
FRACTIONAL = {"duration_ms": "CASE WHEN timed AND slot <> 1 THEN IF(value > 400, value * 20 + 0.25, floor(value * 20)) END"}


def _frontiers(spark, directory, **attributes):
    tune(spark)
    records = events_as_records(read_table(spark, directory, "events"), attributes or None)
    rows = []
    for app in (apps.activity_stats(), apps.session_cost()):
        normalized = app.normalize(records).persist()
        _, frontier = lifecycle.advance(app, normalized, lifecycle.Frontier(), {})
        normalized.unpersist()
        state = frontier.as_dict()
        rows.append((app.name, *[state[name] for name in ("position", "complete", "gap_position", "consumed", "ineffective", "emitted", "detached")]))
    return spark.createDataFrame(rows, FRONTIER_SCHEMA)


_BAD = "(SELECT min(position) FROM activity WHERE has_duration AND slot <> 1 AND kind <> 'turn_ttft' AND duration IS NOT NULL AND value > 400)"


def _frontier_oracle(limit: str) -> str:
    return with_ctes(O.REC, O.USAGE, O.ACTIVITY) + (
        f"SELECT 'activity-stats' AS app, COALESCE({limit} - 1, count(*)) AS position, {limit} IS NULL AS complete, {limit} AS gap_position, "
        f"count(*) FILTER (position < COALESCE({limit}, 9007199254740991)) AS consumed, "
        f"count(*) FILTER (position < COALESCE({limit}, 9007199254740991) AND position NOT IN (SELECT position FROM activity)) AS ineffective, "
        f"count(*) FILTER (position < COALESCE({limit}, 9007199254740991) AND position IN (SELECT position FROM activity)) AS emitted, "
        f"count(*) FILTER (position >= COALESCE({limit}, 9007199254740991)) AS detached FROM rec "
        "UNION ALL SELECT 'session-cost', count(*), TRUE, NULL, count(*), count(*) - (SELECT count(*) FROM usage), (SELECT count(*) FROM usage), 0 FROM rec"
    )


register("l06_app_statistics", lambda s, d: _frontiers(s, d), _frontier_oracle("CAST(NULL AS BIGINT)"))
register("l03_gap_frontier", lambda s, d: _frontiers(s, d, **FRACTIONAL), _frontier_oracle(_BAD))


def _detached(spark, directory):
    return _frontiers(spark, directory, **FRACTIONAL).groupBy(F.when(C("gap_position").isNotNull(), "projection_gap").otherwise("none").alias("reason")).agg(
        F.sum("detached").alias("records")
    )


register(
    "l05_detached_work",
    _detached,
    with_ctes(O.REC, O.ACTIVITY)
    + f"SELECT 'projection_gap' AS reason, count(*) AS records FROM rec WHERE position >= {_BAD} UNION ALL SELECT 'none', 0",
)


def _halves(records: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records before and after the middle position, as two batches."""
    middle = events.agg(F.expr("max(event_id) div 2").alias("_middle"))
    marked = records.crossJoin(F.broadcast(middle))
    return marked.where("position <= _middle").drop("_middle"), marked.where("position > _middle").drop("_middle")


def _continued_cost(spark, directory):
    records = event_records(spark, directory)
    first, second = _halves(records, read_table(spark, directory, "events"))
    fold = app_folds.session_cost_detail()
    stored = fold.apply(effective_events(normalize_usage.normalize(first)))
    return fold.apply(effective_events(normalize_usage.normalize(second)), stored)


register("l10_continued_table", _continued_cost, FOLDED_ORACLE["f03_session_cost_detail"])


def _continued_runs(spark, directory):
    records = event_records(spark, directory)
    first, second = _halves(records, read_table(spark, directory, "events"))
    stored, _ = guard_folds.session_tables(effective_events(normalize_guard.normalize(first)), chunk=512)
    continued, _ = guard_folds.session_tables(effective_events(normalize_guard.normalize(second)), stored, chunk=512)
    return continued


register("l01_continued_runs", _continued_runs, FOLDED_ORACLE["f08_session_progress"])


def _replayed(spark, directory):
    """A batch that overlaps an applied one contributes only what is new."""
    records = event_records(spark, directory)
    first, second = _halves(records, read_table(spark, directory, "events"))
    frontier = first.agg(F.max("position").alias("_frontier"))
    overlapping = records.unionByName(first).crossJoin(F.broadcast(frontier)).where(C("position") > C("_frontier")).drop("_frontier")
    fold = app_folds.signal_counts()
    from ..operators import normalize_signal

    stored = fold.apply(effective_events(normalize_signal.normalize(first)))
    return fold.apply(effective_events(normalize_signal.normalize(overlapping)), stored)


register("l02_idempotent_replay", _replayed, FOLDED_ORACLE["f01_signal_counts"])


def _sample(spark, directory):
    records = event_records(spark, directory)
    return lifecycle.ineffective_sample(records, normalize_activity.normalize(records), "attributes").select(
        "position", "event_id", "signal", "name", "source", "payload_omitted"
    )


register(
    "l07_ineffective_sample",
    _sample,
    with_ctes(O.REC, O.ACTIVITY)
    + "SELECT position, 'local:' || position AS event_id, signal, name, source, FALSE AS payload_omitted FROM rec "
    "WHERE position NOT IN (SELECT position FROM activity) ORDER BY position DESC LIMIT 16",
)


def _boundary(spark, directory):
    _, later = _halves(event_records(spark, directory), read_table(spark, directory, "events"))
    return apps.signal_counts().tables(later)["signal_counts"].select("source", "signal", "event_name", "event_count")


register(
    "l08_start_boundary",
    _boundary,
    with_ctes(O.REC)
    + "SELECT source, signal, name AS event_name, count(*) AS event_count FROM rec WHERE position > (SELECT max(event_id) // 2 FROM events) GROUP BY 1, 2, 3",
)
register("l09_rebuild", lambda s, d: tables_of(s, d, "session-cost")["session_cost"], FOLDED_ORACLE["f02_session_cost"])


def _lag(spark, directory):
    head = event_records(spark, directory).agg(F.max("position").alias("head"))
    return _frontiers(spark, directory, **FRACTIONAL).crossJoin(F.broadcast(head)).select(
        "app", "head", (C("head") - C("position")).alias("lag"), (C("complete") & (C("head") == C("position"))).alias("aligned")
    )


register(
    "l12_lag",
    _lag,
    with_ctes(O.REC, O.ACTIVITY)
    + f"SELECT 'activity-stats' AS app, max(position) AS head, max(position) - COALESCE({_BAD} - 1, max(position)) AS lag, {_BAD} IS NULL AS aligned FROM rec "
    "UNION ALL SELECT 'session-cost', max(position), 0, TRUE FROM rec",
)
register(
    "l15_intake_counters",
    lambda s, d: lifecycle.intake(event_records(s, d)).select("signal", "records"),
    with_ctes(O.REC) + "SELECT signal, count(*) AS records FROM rec GROUP BY signal",
)


def _sized(spark, directory) -> DataFrame:
    """Records whose canonical text is the properties of the event."""
    rows = event_records(spark, directory).join(read_table(spark, directory, "events").select((C("event_id") + 1).alias("position"), "props"), "position")
    return rows.withColumn("canonical_bytes", F.octet_length("props").cast("bigint"))


register(
    "l15_intake_bytes",
    lambda s, d: lifecycle.intake(_sized(s, d)),
    with_ctes(O.REC)
    + "SELECT signal, count(*) AS records, CAST(sum(strlen(e.props)) AS BIGINT) AS bytes, max(position) AS last_position "
    "FROM rec JOIN events e ON e.event_id + 1 = rec.position GROUP BY signal",
)

# -- query surface -------------------------------------------------------------------

register(
    "q02_open_findings_view",
    lambda s, d: s.sql(
        "SELECT finding_id, rule_id, severity, session_id FROM {violations} UNION ALL SELECT finding_id, rule_id, severity, session_id FROM {gaps}",
        violations=tables_of(s, d, "agent-guard")["policy_violations"],
        gaps=tables_of(s, d, "agent-guard")["policy_gaps"],
    ),
    oracle("SELECT finding_id, rule_id, severity, session_id FROM policy_findings", "policy_findings"),
)
register(
    "q04_parameters",
    lambda s, d: s.sql(
        "SELECT finding_id, summary FROM {policy_violations} WHERE harness = ? AND source_position > ?",
        args=["codex", 100],
        policy_violations=tables_of(s, d, "agent-guard")["policy_violations"],
    ),
    oracle(
        "SELECT finding_id, summary FROM policy_findings WHERE harness = 'codex' AND source_position > 100 AND rule_id <> 'insufficient-telemetry'",
        "policy_findings",
    ),
)
register(
    "q05_mounted_join",
    lambda s, d: s.sql(
        "SELECT p.harness, p.session_id, p.repeat_count, c.cost_microusd FROM {session_progress} p "
        "JOIN {cost_session_cost} c ON c.harness = p.harness AND c.session_id = p.session_id",
        session_progress=tables_of(s, d, "agent-guard")["session_progress"],
        cost_session_cost=tables_of(s, d, "session-cost")["session_cost"],
    ),
    oracle(
        "SELECT p.harness, p.session_id, p.repeat_count, c.cost_microusd FROM session_progress p JOIN session_cost c "
        "ON c.harness = p.harness AND c.session_id = p.session_id",
        "session_progress",
        "session_cost",
    ),
)
register(
    "q07_row_limit",
    lambda s, d: serve.bounded(
        tables_of(s, d, "agent-guard")["tool_failure_detail"].select("source_position", "tool").orderBy(C("source_position").desc()), 100
    ),
    oracle("SELECT source_position, tool FROM tool_failure_detail ORDER BY source_position DESC LIMIT 101", "tool_failure_detail"),
)
register(
    "q08_result_typing",
    lambda s, d: tables_of(s, d, "session-cost")["session_cost"].select(
        "session_id",
        values_kit.wrap_integer(values_kit.exact_product(C("cost_microusd"), 1000000000000)).alias("scaled"),
        values_kit.wrap_bytes(C("harness").cast("binary")).alias("raw"),
    ),
    oracle(
        "SELECT session_id, CASE WHEN cost_microusd * 1000000000000 > 9007199254740991 THEN '{\"integer_decimal\":\"' || (cost_microusd * 1000000000000) || '\"}' "
        "ELSE CAST(cost_microusd * 1000000000000 AS VARCHAR) END AS scaled, '{\"bytes_base64\":\"' || to_base64(encode(harness)) || '\"}' AS raw FROM session_cost",
        "session_cost",
    ),
)


def _typed(spark, directory) -> DataFrame:
    """Columns typed by declaration: JSON under another name, a text named like a JSON column, a computed column."""
    tune(spark)
    events = serve.declared(read_table(spark, directory, "events").selectExpr("event_id", "user_id", "event_type AS evidence", "props", "value"), {"props": "JSON"})
    accounts = read_table(spark, directory, "customer").select("c_custkey", values_kit.exact_product(C("c_custkey"), 1000000000000000).alias("account"))
    customers = serve.declared(accounts, {"account": "INTEGER"})
    joined = spark.sql(
        "SELECT e.event_id, e.evidence, e.props AS detail, c.account, e.value > 50 AS high FROM {e} e LEFT JOIN {c} c ON c.c_custkey = e.user_id", e=events, c=customers
    )
    kinds = [F.lit(serve.logical_type(item)).alias(f"{item.name}_type") for item in joined.schema]
    return serve.encoded(joined).select("*", *kinds)


register(
    "q08_typed_by_contract",
    _typed,
    "SELECT CAST(event_id AS VARCHAR) AS event_id, '\"' || event_type || '\"' AS evidence, props AS detail, "
    "CASE WHEN c_custkey * 1000000000000000 > 9007199254740991 THEN '{\"integer_decimal\":\"' || (c_custkey * 1000000000000000) || '\"}' "
    "ELSE CAST(c_custkey * 1000000000000000 AS VARCHAR) END AS account, CAST(value > 50 AS VARCHAR) AS high, 'INTEGER' AS event_id_type, 'TEXT' AS evidence_type, "
    "'JSON' AS detail_type, 'INTEGER' AS account_type, 'DYNAMIC' AS high_type FROM events LEFT JOIN customer ON c_custkey = user_id",
)
