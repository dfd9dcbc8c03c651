"""Bounded read-only queries over one published version, with other apps mounted by alias."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import wrap_bytes, wrap_integer
from ..streaming.store import Store
from .apps import App, contract_digest

# Fixed values.
DEFAULT_ROWS = 256
MAX_ROWS = 1000
MAX_RESULT_BYTES = 1 << 20
MAX_PARAMETERS = 64
MAX_SQL_BYTES = 16 << 10
LOGICAL = "logical"


class FrontierChanged(RuntimeError):
    """The published version is not the one the caller expects."""


@dataclass(frozen=True)
class Result:
    app: str
    revision: str
    head: int
    position: int
    ineffective: int
    complete: bool
    mounts: list[dict]
    columns: list[dict]
    rows: list[list]
    truncated: bool


def bounded(frame: DataFrame, limit: int = DEFAULT_ROWS) -> DataFrame:
    """One row more than the limit, which tells a full answer from a cut one."""
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"row limit must be 1..{MAX_ROWS}")
    return frame.limit(limit + 1)


_LOGICAL = {T.StringType: "TEXT", T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.BooleanType: "BOOLEAN", T.BinaryType: "BLOB"}


def declared(frame: DataFrame, logical: Mapping[str, str] | None = None) -> DataFrame:
    """A table whose columns carry their logical type as metadata.

    Spark hands metadata on with a column, through aliases, joins, unions and grouping, and gives
    none to a computed one.
    """
    for item in frame.schema:
        kind = (logical or {}).get(item.name) or _LOGICAL.get(type(item.dataType))
        if kind is not None:
            frame = frame.withMetadata(item.name, {**item.metadata, LOGICAL: kind})
    return frame


def logical_type(column: T.StructField) -> str:
    """Declared type of a result column; a computed one is DYNAMIC, typed by each value."""
    return column.metadata.get(LOGICAL, "DYNAMIC")


def _encoded(item: T.StructField) -> Column:
    value, kind = F.col(f"`{item.name.replace('`', '``')}`"), type(item.dataType)
    if logical_type(item) == "JSON":
        broken = F.raise_error(F.lit(f"column {item.name}: not JSON"))
        return F.when(value.isNotNull() & F.try_parse_json(value).isNull(), broken).otherwise(value)
    if kind is T.DecimalType and item.dataType.scale == 0 and logical_type(item) == "INTEGER":
        return wrap_integer(value)
    if issubclass(kind, T.IntegralType):
        return wrap_integer(value.cast("bigint"))
    if issubclass(kind, T.FractionalType) and kind is not T.DecimalType:
        broken = F.raise_error(F.lit(f"column {item.name}: non-finite number"))
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), broken).otherwise(value.cast("string"))
    if kind is T.BinaryType:
        return wrap_bytes(value)
    if kind is T.BooleanType:
        return value.cast("string")
    return F.to_json(value.cast("string").cast("variant"))


def encoded(frame: DataFrame) -> DataFrame:
    """Every value as a JSON text (SQL NULL stays NULL): integers beyond 2^53 and bytes wrapped, JSON columns as they are.

    A decimal without fraction that is declared INTEGER is an integer, also beyond 64 bits."""
    names = [f"`{name.replace('`', '``')}`" for name in frame.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"result columns {frame.columns} repeat a name")
    return frame.select(*[_encoded(item).alias(item.name) for item in frame.schema])


class Snapshot:
    """Tables of the version published when the snapshot was taken."""

    def __init__(self, spark: SparkSession, root: str, apps: Sequence[App]) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.state = self.store.read()
        self.apps = {app.name: app for app in apps}

    def frames(self, app: str) -> dict[str, DataFrame]:
        """Tables and views of an app, with their logical types."""
        types = self.apps[app].logical
        frames = {name: declared(frame, types.get(name)) for name, frame in self.store.tables(self.state, app).items()}
        for view, text in self.apps[app].views.items():
            for name in frames:
                text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
            used = {name: frame for name, frame in frames.items() if f"{{{name}}}" in text}
            frames[view] = self.spark.sql(text, **used)
        return frames

    def query(
        self,
        app: str,
        sql: str,
        parameters: Sequence[Any] = (),
        mounts: Mapping[str, str] | None = None,
        expected_revision: str | None = None,
        expected_position: int | None = None,
        limit: int = DEFAULT_ROWS,
    ) -> Result:
        """Run SQL with ``{table}`` for own tables and ``{alias_table}`` for mounted ones."""
        if len(sql.encode()) > MAX_SQL_BYTES or len(parameters) > MAX_PARAMETERS:
            raise ValueError("query text or parameters exceed the limit")
        entry = self.state["apps"][app]
        frontier = entry["frontier"]
        if expected_revision not in (None, entry["revision"]) or expected_position not in (None, frontier["position"]):
            raise FrontierChanged(f"{app} is at revision {entry['revision']}, position {frontier['position']}")
        frames = self.frames(app)
        described = []
        for alias, other in (mounts or {}).items():
            mounted = self.state["apps"][other]
            if not mounted["frontier"]["complete"] or mounted["frontier"]["position"] != frontier["position"]:
                raise FrontierChanged(f"mount {alias}: {other} is not at position {frontier['position']}")
            shown = self.apps[other].exports
            exports = {name: frame for name, frame in self.frames(other).items() if shown is None or name in shown}
            frames |= {f"{alias}_{name}": frame for name, frame in exports.items()}
            described.append(
                {
                    "alias": alias,
                    "app": other,
                    "revision": mounted["revision"],
                    "position": mounted["frontier"]["position"],
                    "contract": {name: contract_digest(frame) for name, frame in exports.items()},
                }
            )
        used = {name: frame for name, frame in frames.items() if f"{{{name}}}" in sql}
        args = list(parameters)
        frame = self.spark.sql(sql, args=args, **used) if args else self.spark.sql(sql, **used)
        found = encoded(bounded(frame, limit)).collect()
        rows, size, truncated = [], 0, len(found) > limit
        for row in found[:limit]:
            size += sum(len(value or "null") + 1 for value in row) + 1
            if size > MAX_RESULT_BYTES:
                truncated = True
                break
            rows.append([None if value is None else json.loads(value) for value in row])
        return Result(
            app,
            entry["revision"],
            self.state["head"],
            frontier["position"],
            frontier["ineffective"],
            frontier["complete"],
            described,
            [{"name": item.name, "type": logical_type(item)} for item in frame.schema],
            rows,
            truncated,
        )

    def create_views(self, app: str, prefix: str = "") -> list[str]:
        """Register an app's tables and views as temporary views, optionally under an alias."""
        names = []
        for name, frame in self.frames(app).items():
            frame.createOrReplaceTempView(f"{prefix}{name}")
            names.append(f"{prefix}{name}")
        return names
