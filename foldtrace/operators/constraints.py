"""Declared constraints over ordered changes: NOT NULL, CHECK, primary keys and UNIQUE columns.

A change is tested against the rows as they are when it is applied.  Only the first violation of
an app counts, since the app stops there; so up to it every unique value has one holder at most,
and a violation is a change whose value another key still holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .changes import CHUNK_POSITIONS, _chunked, _same_keys, change_order, insert_conflicts

C = F.col
#: Stored rows stand before all positions.
STORED = -1


@dataclass(frozen=True)
class Rules:
    """``checks`` are SQL conditions by name; as in SQL, one that is NULL holds."""

    keys: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    checks: Mapping[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()


def _row_problem(table: str, rules: Rules) -> Column:
    missing = [F.when(C(name).isNull(), f"NOT NULL constraint failed: {table}.{name}") for name in rules.not_null]
    failed = [F.when(~F.expr(condition), f"CHECK constraint failed: {name}") for name, condition in rules.checks.items()]
    return F.when(C("op") != "delete", F.coalesce(F.lit(None).cast("string"), *missing, *failed))


def following_order(frame: DataFrame, keys: Sequence[str], order: str, position: str = "position", chunk: int = CHUNK_POSITIONS) -> DataFrame:
    """The frame with the order of the key's next row as ``_until``, NULL for the last one."""
    rows = _chunked(frame, position, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    edges = rows.groupBy(*keys, "_chunk").agg(F.min(order).alias("_first"))
    edges = edges.select(*keys, "_chunk", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_next"))
    led = rows.withColumn("_lead", F.lead(order).over(inside))
    return _same_keys(led, edges, [*keys, "_chunk"]).withColumn("_until", F.coalesce("_lead", "_next")).drop("_lead", "_next", "_chunk")


def greatest_before(frame: DataFrame, keys: Sequence[str], value: str, order: str, position: str = "position", chunk: int = CHUNK_POSITIONS) -> DataFrame:
    """The frame with the greatest ``value`` of the key's earlier rows as ``_before``."""
    rows = _chunked(frame, position, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_chunk").agg(F.max(value).alias("_most"))
    carried = carried.select(*keys, "_chunk", F.max("_most").over(before).alias("_carry"))
    local = rows.withColumn("_local", F.max(value).over(inside))
    return _same_keys(local, carried, [*keys, "_chunk"]).withColumn("_before", F.greatest("_carry", "_local")).drop("_carry", "_local", "_chunk")


def unique_conflicts(
    changes: DataFrame, keys: Sequence[str], columns: Sequence[str], table: str, prior: DataFrame | None = None, chunk: int = CHUNK_POSITIONS
) -> DataFrame:
    """Changes that write a value which another key holds at that point: (position, at, reason).

    A change holds its value until the key's next change.  Values with a NULL are held by nobody.
    """
    wanted = list(dict.fromkeys([*keys, *columns, "op", "position"]))
    rows = changes.withColumn("_at", change_order()).select(*wanted, "_at")
    if prior is not None:
        first = F.struct(*[F.lit(STORED).cast(part.dataType).alias(part.name) for part in rows.schema["_at"].dataType.fields])
        older = prior.withColumns({"op": F.lit("upsert"), "position": F.lit(STORED).cast("long")}).withColumn("_at", first)
        rows = rows.unionByName(older.select(*wanted, "_at"))
    never = F.struct(*[F.lit(2**31 - 1 if part.name != "p" else 2**63 - 1).cast(part.dataType).alias(part.name) for part in rows.schema["_at"].dataType.fields])
    held = following_order(rows, keys, "_at", chunk=chunk).withColumn("_until", F.coalesce("_until", never))
    held = held.where((C("op") != "delete") & ~F.greatest(*[C(name).isNull() for name in columns], F.lit(False)))
    found = greatest_before(held, columns, "_until", "_at", chunk=chunk).where((C("_before") > C("_at")) & (C("position") > STORED))
    reason = "UNIQUE constraint failed: " + ", ".join(f"{table}.{name}" for name in columns)
    return found.select("position", C("_at").alias("at"), F.lit(reason).alias("reason"))


def violations(table: str, changes: DataFrame, rules: Rules, prior: DataFrame | None = None, chunk: int = CHUNK_POSITIONS) -> DataFrame:
    """(position, at, reason) of every change that breaks a rule; ``at`` orders them inside a position."""
    at = change_order().alias("at")
    bad = changes.select("position", at, _row_problem(table, rules).alias("reason")).where("reason IS NOT NULL")
    inserted = insert_conflicts(changes, rules.keys, prior, chunk, at=True)
    bad = bad.unionByName(inserted.select("position", "at", "reason"))
    for columns in rules.unique:
        bad = bad.unionByName(unique_conflicts(changes, rules.keys, columns, table, prior, chunk))
    return bad
