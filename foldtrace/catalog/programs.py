"""Registered queries of apps made of programs: several events per record, own tables, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, constraints
from ..operators.constraints import Rules
from ..operators.envelope import Envelope, Field
from ..operators.record_view import effective_events, event_count, finish_many
from ..plans.programs import program_app
from ..session import tune
from ..sources.tables import read_table
from ..streaming import lifecycle
from .stateful import CHANGES, K, ledger

C = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, query, text: str) -> None:
    QUERIES[name] = query
    ORACLE[name] = text


def unit_records(spark, directory: str) -> DataFrame:
    tune(spark)
    return read_table(spark, directory, "events").selectExpr(
        "event_id + 1 AS position", "concat('local:', event_id + 1) AS event_id", "'log' AS signal", "event_type AS name", "'shop' AS source",
        "user_id", "value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    )


UNITS = (
    "IF(k % 4 = 0, NULL, transform(sequence(1, CAST(k % 4 AS INT)), i -> "
    "named_struct('user', user_id, 'unit', i, 'code', CAST(round(value * 100) AS BIGINT) * 4 + i, 'amount', k - i)))"
)


def normalize_units(records: DataFrame) -> DataFrame:
    """None to three events per record."""
    return finish_many(records, F.expr(UNITS), kept={"user": C("user_id")})


def units_app():
    """Latest amounts by unit, where a second fold takes some away again; the users seen, kept by
    the normalizer itself; and codes that one user holds at a time."""
    amounts = lambda events: events.select("user", "unit", "amount", F.lit("upsert").alias("op"), "position", "ordinal")
    taken = lambda events: amounts(events).where("amount % 5 = 0").withColumn("op", F.lit("delete"))
    codes = lambda events: events.select("user", "code", F.lit("upsert").alias("op"), "position", "ordinal")
    seen = lambda records: records.select("user", C("position").alias("last_position"), F.lit("upsert").alias("op"), "position")
    rules = {"amounts": Rules(("user", "unit")), "codes": Rules(("user",), ("code",), {"code > 0": "code > 0"}, (("code",),)), "users": Rules(("user",))}
    return program_app("units", normalize_units, rules, [{"amounts": amounts, "codes": codes}, {"amounts": taken}], {"users": seen})


_UNITS = (
    f"units AS (SELECT event_id + 1 AS position, user_id AS user, i AS unit, i - 1 AS ordinal, CAST(round(value * 100) AS BIGINT) * 4 + i AS code, k - i AS amount FROM "
    f"(SELECT *, unnest(range(1, k % 4 + 1)) AS i FROM (SELECT *, {K} AS k FROM events)))"
)
_HELD = (
    "held AS (SELECT position, user, code, position * 256 + ordinal AS since, "
    "coalesce(lead(position * 256 + ordinal) OVER (PARTITION BY user ORDER BY position, ordinal), 9223372036854775807) AS until FROM units), "
    "bad AS (SELECT DISTINCT b.position, b.since FROM held a JOIN held b ON a.code = b.code AND a.user <> b.user AND a.since < b.since AND b.since < a.until)"
)
_CODE_REASON = "'UNIQUE constraint failed: codes.code'"

register(
    "n24_several_events",
    lambda s, d: effective_events(normalize_units(unit_records(s, d))).select("position", "event_id", C("ordinal").cast("bigint").alias("ordinal"), "user", C("unit").cast("bigint").alias("unit"), "code", "amount"),
    f"WITH {_UNITS} SELECT position, 'local:' || position || '#' || ordinal AS event_id, ordinal, user, unit, code, amount FROM units",
)
register(
    "n25_program_tables",
    lambda s, d: units_app().tables(unit_records(s, d), "amounts")["amounts"].select("user", C("unit").cast("bigint").alias("unit"), "amount"),
    f"WITH {_UNITS} SELECT user, unit, amount FROM units QUALIFY row_number() OVER (PARTITION BY user, unit ORDER BY position DESC) = 1 AND amount % 5 <> 0",
)
register(
    "n25_normalizer_table",
    lambda s, d: units_app().tables(unit_records(s, d), "users")["users"],
    "SELECT user_id AS user, max(event_id) + 1 AS last_position FROM events GROUP BY 1",
)


def _unit_changes(spark, directory) -> DataFrame:
    events = effective_events(normalize_units(unit_records(spark, directory)))
    return events.select("user", "code", F.lit("upsert").alias("op"), "position", "ordinal", F.lit(0).alias("step"))


register(
    "g13_unique_violations",
    lambda s, d: constraints.unique_conflicts(_unit_changes(s, d), ["user"], ["code"], "codes").select("position", C("at.o").cast("bigint").alias("ordinal"), "reason"),
    f"WITH {_UNITS}, {_HELD} SELECT position, since % 256 AS ordinal, {_CODE_REASON} AS reason FROM bad",
)


def _row_rules(spark, directory) -> DataFrame:
    rows = ledger(spark, directory).withColumn("balance", F.when(C("balance") < 95, C("balance")))
    rules = Rules(("key",), ("balance",), {"balance <> 7": "balance <> 7", "balance * 2 < 180": "balance * 2 < 180"})
    return constraints.violations("ledger", rows, rules).select("position", "reason")


register(
    "g13_row_violations",
    _row_rules,
    f"WITH {CHANGES} SELECT position, CASE WHEN balance >= 95 THEN 'NOT NULL constraint failed: ledger.balance' WHEN balance = 7 THEN 'CHECK constraint failed: balance <> 7' "
    "ELSE 'CHECK constraint failed: balance * 2 < 180' END AS reason FROM changes WHERE op <> 'delete' AND (balance = 7 OR balance >= 90) "
    "UNION ALL SELECT position, 'insert: UNIQUE constraint failed' FROM "
    "(SELECT *, lag(op) OVER (PARTITION BY key ORDER BY position) AS before FROM changes) WHERE op = 'insert' AND before <> 'delete'",
)


def _stopped(spark, directory) -> DataFrame:
    """Where the app stops by its own constraints, and what it used until then."""
    app, records = units_app(), unit_records(spark, directory)
    normalized = app.normalize(records)
    gap = lifecycle.gap_frame(app, normalized, {})
    before = F.coalesce(C("position") < C("gap_position"), F.lit(True))
    joined = normalized.crossJoin(F.broadcast(gap.select(C("position").alias("gap_position"), C("reason").alias("gap_reason"))))  # one row
    return joined.groupBy("gap_position", "gap_reason").agg(
        F.count_if(before).alias("consumed"), F.sum(F.when(before, event_count(normalized)).otherwise(0)).alias("emitted"),
        F.count_if(before & ~C("effective")).alias("ineffective"), F.count_if(~before).alias("detached"),
    )


register(
    "g13_constraint_frontier",
    _stopped,
    f"WITH {_UNITS}, {_HELD}, g AS (SELECT min(position) AS gap_position FROM bad), r AS (SELECT event_id + 1 AS position, {K} % 4 AS n FROM events) "
    f"SELECT gap_position, CASE WHEN gap_position IS NOT NULL THEN {_CODE_REASON} END AS gap_reason, count(*) FILTER (coalesce(position < gap_position, TRUE)) AS consumed, "
    "CAST(coalesce(sum(n) FILTER (coalesce(position < gap_position, TRUE)), 0) AS BIGINT) AS emitted, count(*) FILTER (coalesce(position < gap_position, TRUE) AND n = 0) AS ineffective, "
    "count(*) FILTER (position >= gap_position) AS detached FROM r, g GROUP BY 1, 2",
)


def _numbered_changes(spark, directory) -> DataFrame:
    """Inserts, upserts and deletes of several events and programs in one record."""
    rows = ledger(spark, directory).select("key", "balance", "position", F.explode(F.expr(
        "array(named_struct('ordinal', 1, 'step', 0, 'op', 'delete'), named_struct('ordinal', 0, 'step', 1, 'op', 'upsert'), "
        "named_struct('ordinal', IF(balance % 3 = 0, 1, 0), 'step', IF(balance % 2 = 0, 1, 0), 'op', 'insert'))")).alias("c"))  # fmt: skip
    value = F.when(C("c.op") == "insert", C("balance") + 1000).otherwise(C("balance"))
    return rows.select("key", value.alias("balance"), "position", "c.*")


register(
    "g08_ordinals_and_steps",
    lambda s, d: changes.apply_changes(_numbered_changes(s, d), ["key"]),
    f"WITH {CHANGES} SELECT key, balance + 1000 AS balance FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY position DESC) = 1 AND balance % 6 = 0",
)
register(
    "g02_read_one_columns",
    lambda s, d: changes.lookup_one(
        read_table(tune(s), d, "events").select("event_id", C("user_id").alias("nation")), read_table(s, d, "nation").select(C("n_nationkey").alias("nation"), C("n_name").alias("label")), ["nation"]
    ).select("event_id", "read_label", "error_reason"),
    "SELECT e.event_id, n.n_name AS read_label, CASE WHEN n.n_nationkey IS NULL THEN 'read ONE: expected exactly one row' END AS error_reason FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id",
)


INPUT = Envelope(
    meta=(Field("position", "INTEGER"),),
    event=(Field("user", "INTEGER"), Field("kind", "TEXT"), Field("value", "REAL"), Field("props", "document"), Field("note", "JSON", nullable=True)),
    max_bytes=512,
    max_depth=32,
)


def _inputs(spark, directory) -> DataFrame:
    """A program input per event; some are too long or too deep, lack a field, hold one of a wrong type or one too many."""
    tune(spark)
    return read_table(spark, directory, "events").selectExpr("*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k").selectExpr(
        "event_id",
        "concat('{\"meta\":{\"position\":', event_id + 1, '},\"event\":{', IF(event_type = 'view' AND k % 4 = 0, '', concat('\"user\":', user_id, ',')), "
        "'\"kind\":\"', event_type, '\",\"value\":', IF(event_type = 'purchase' AND k % 5 = 0, concat('\"', k, '\"'), CAST(k AS STRING)), ',\"props\":', props, "
        "IF(event_type = 'error' AND k % 3 = 0, ',\"debug\":true', ''), ',\"note\":', "
        "CASE WHEN k % 11 = 0 THEN concat('\"', repeat('x', 600), '\"') WHEN k % 13 = 0 THEN concat(repeat('[', 40), repeat(']', 40)) ELSE 'null' END, '}}') AS input",
    )


register(
    "g10_closed_envelope",
    lambda s, d: _inputs(s, d).select("event_id", INPUT.error(C("input")).alias("error_reason")),
    f"SELECT event_id, CASE WHEN k % 11 = 0 THEN 'evaluation input exceeds 512 bytes' WHEN k % 13 = 0 THEN 'evaluation input exceeds depth 32' "
    "WHEN event_type = 'view' AND k % 4 = 0 THEN 'input event: field \"user\" is required' "
    "WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'input event: field \"value\": must be a finite number' "
    f"WHEN event_type = 'error' AND k % 3 = 0 THEN 'input event: unknown field \"debug\"' END AS error_reason FROM (SELECT *, {K} AS k FROM events)",
)


def _tags_app(limit: int):
    """A fold that writes a row per ten of the value, and one that marks the user."""
    normalize = lambda records: finish_many(records, F.expr("array(named_struct('user', user_id, 'n', CAST(value AS INT) div 10 + 1))"))
    tags = lambda events: events.select("user", F.explode(F.expr("sequence(1, n)")).alias("tag"), F.lit("upsert").alias("op"), "position", "ordinal")
    seen = lambda events: events.select("user", F.lit("upsert").alias("op"), "position", "ordinal")
    rules = {"tags": Rules(("user", "tag")), "seen": Rules(("user",))}
    return program_app("tags", normalize, rules, [{"tags": tags, "seen": seen}], max_changes=limit)


def _too_many_changes(spark, directory) -> DataFrame:
    app = _tags_app(20)
    return app.violations(app.normalize(unit_records(spark, directory)), {}).select("position", C("at.o").cast("bigint").alias("ordinal"), "reason")


register(
    "g09_change_limit",
    _too_many_changes,
    "SELECT event_id + 1 AS position, 0::BIGINT AS ordinal, 'row changes exceed 20' AS reason FROM events WHERE trunc(value)::BIGINT // 10 + 2 > 20",
)
