"""Generic keyed changes: ordered inserts, upserts and deletes, and bounded ordered reads.

Nothing here orders a whole key in one task.  Neighbours and running totals are taken
inside (key, position chunk) partitions and completed from one small row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .folds import latest_rows

C = F.col
CHUNK_POSITIONS = 1 << 20


def change_order(op: str = "op", position: str = "position", ordinal: str = "ordinal", step: str = "step") -> Column:
    """Position, then event, then program, then insert before upsert before delete."""
    rank = F.when(C(op) == "insert", 0).when(C(op) == "upsert", 1).otherwise(2)
    return F.struct(C(position).alias("p"), C(ordinal).alias("o"), C(step).alias("s"), rank.alias("r"))


def _same_keys(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is one; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    on = [left[name].eqNullSafe(renamed[f"_r_{name}"]) for name in names]
    return left.join(renamed, on, how).drop(*[f"_r_{name}" for name in names])


def _chunked(frame: DataFrame, position: str, chunk: int) -> DataFrame:
    return frame.withColumn("_chunk", F.expr(f"{position} div {chunk}"))


def running_total(
    frame: DataFrame, keys: Sequence[str], column: str, position: str, chunk: int = CHUNK_POSITIONS
) -> DataFrame:
    """Keys, position and the key's running sum of ``column`` as ``_running``."""
    rows = _chunked(frame.select(*keys, position, C(column).alias("_x")), position, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_x").alias("_t"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    )
    return (
        _same_keys(rows.withColumn("_local", F.sum("_x").over(inside)), carried, [*keys, "_chunk"])
        .select(*keys, position, (C("_carry") + C("_local")).alias("_running"))
    )


def previous_value(
    frame: DataFrame, keys: Sequence[str], order: Column, value: Column, position: str = "position", chunk: int = CHUNK_POSITIONS
) -> DataFrame:
    """The frame with the value of the key's preceding row as ``_previous``."""
    rows = _chunked(frame.withColumns({"_order": order, "_value": value}), position, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_order")
    edges = rows.groupBy(*keys, "_chunk").agg(F.max_by("_value", "_order").alias("_last"))
    edges = edges.select(
        *keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_before")
    )
    numbered = rows.withColumns({"_n": F.row_number().over(inside), "_lag": F.lag("_value").over(inside)})
    return (
        _same_keys(numbered, edges, [*keys, "_chunk"])
        .withColumn("_previous", F.when(C("_n") == 1, C("_before")).otherwise(C("_lag")))
        .drop("_n", "_lag", "_before", "_chunk", "_order", "_value")
    )


def apply_changes(changes: DataFrame, keys: Sequence[str], prior: DataFrame | None = None) -> DataFrame:
    """Table after ordered changes: the latest change of a key decides, a delete removes it."""
    values = [name for name in changes.columns if name not in ("op", "position", "ordinal", "step")]
    rows = changes.select(*values, (C("op") != "delete").alias("_kept"), change_order().alias("_at"))
    older = None
    if prior is not None:
        never = F.lit(None).cast(rows.schema["_at"].dataType)
        older = prior.select(*values, F.lit(True).alias("_kept"), never.alias("_at"))
    return latest_rows(rows, keys, C("_at"), older).where("_kept").select(*values)


def insert_conflicts(
    changes: DataFrame, keys: Sequence[str], prior: DataFrame | None = None, chunk: int = CHUNK_POSITIONS, at: bool = False
) -> DataFrame:
    """Inserts of a key that exists at that point: each is an error of its record."""
    rows = previous_value(changes, keys, change_order(), C("op"), chunk=chunk)
    if prior is None:
        stored = F.lit(False)
    else:
        rows = _same_keys(rows, prior.select(*keys).withColumn("_stored", F.lit(True)), keys, "left")
        stored = F.coalesce("_stored", F.lit(False))
    present = F.when(C("_previous").isNull(), stored).otherwise(C("_previous") != "delete")
    return rows.where((C("op") == "insert") & present).select(
        "position", *([change_order().alias("at")] if at else []), *keys, F.lit("insert: UNIQUE constraint failed").alias("reason")
    )


def lookup(events: DataFrame, rows: DataFrame, on: Sequence[str], prefix: str = "read_") -> DataFrame:
    """OPTIONAL ONE read of a keyed table or view: its columns, NULL when there is no row."""
    renamed = rows.select(*on, F.lit(True).alias(f"{prefix}found"), *[C(n).alias(prefix + n) for n in rows.columns if n not in on])
    found = _same_keys(events, renamed, on, "left")
    return found.withColumn(f"{prefix}found", F.coalesce(f"{prefix}found", F.lit(False)))


def lookup_one(events: DataFrame, rows: DataFrame, on: Sequence[str], prefix: str = "read_") -> DataFrame:
    """ONE read: the columns of the row, with an error where there is not exactly one."""
    others = [name for name in rows.columns if name not in on]
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias(f"{prefix}rows"), *[F.any_value(name).alias(prefix + name) for name in others])
    found = _same_keys(events, counted, on, "left")
    one = F.coalesce(f"{prefix}rows", F.lit(0)) == 1
    found = found.withColumns({prefix + name: F.when(one, C(prefix + name)) for name in others})
    return found.withColumn("error_reason", F.when(~one, F.lit("read ONE: expected exactly one row")))


def many_read(
    events: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    order_by: str,
    limit: int,
    position: str = "position",
    chunk: int = CHUNK_POSITIONS,
) -> DataFrame:
    """MANY read: for each event the first ``limit`` values of ``order_by`` among the key's earlier rows.

    The smallest values of a union are the smallest of the parts' smallest, so every chunk
    keeps at most ``limit`` values, chunks are combined per key from those, and each chunk
    then replays its own events on top of what came before.
    """
    names = list(keys)
    rows = history.select(*names, C(position), C(order_by).alias("_value"), F.lit(1).alias("_kind"))
    reads = events.select(*names, position, F.lit(None).cast(dict(rows.dtypes)["_value"]).alias("_value"), F.lit(0).alias("_kind"))
    merged = _chunked(rows.unionByName(reads), position, chunk)
    ranked = rows.transform(lambda f: _chunked(f, position, chunk)).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*names, "_chunk").orderBy(C("_value").asc_nulls_first()))
    )
    tops = ranked.where(C("_rank") <= limit).select(*names, "_chunk", "_value")
    starts = merged.select(*names, "_chunk").distinct().withColumns({"_value": F.lit(None).cast(dict(rows.dtypes)["_value"]), "_kind": F.lit(0)})
    entries = starts.unionByName(tops.withColumn("_kind", F.lit(1)))
    carry_schema = T.StructType(
        [*[merged.schema[name] for name in names], merged.schema["_chunk"], T.StructField("_carry", T.ArrayType(merged.schema["_value"].dataType))]
    )
    carry_layout = to_arrow_schema(carry_schema)

    def least(values: list) -> list:
        """The first ``limit`` values in order, NULL before all others."""
        return sorted(values, key=lambda v: (v is not None, v) if v is not None else (False,))[:limit]

    def carry_forward(batches):
        """One ordered pass over the chunk tops of each key, holding ``limit`` values."""
        current, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[name] for name in names)
                if key != current:
                    current, held = key, []
                if row["_kind"] == 0:
                    out.append({**dict(zip(names, key)), "_chunk": row["_chunk"], "_carry": list(held)})
                else:
                    held = least([*held, row["_value"]])
            yield pa.RecordBatch.from_pylist(out, carry_layout)

    carry = entries.repartition(*names).sortWithinPartitions(*names, "_chunk", "_kind").mapInArrow(carry_forward, carry_schema)
    value_type = merged.schema["_value"].dataType
    key_fields = [merged.schema[name] for name in names]
    output = T.StructType([*key_fields, T.StructField(position, T.LongType()), T.StructField("values", T.ArrayType(value_type))])
    output_layout = to_arrow_schema(output)

    def replay(rows_and_carry: pa.Table, carried: pa.Table) -> pa.Table:
        """Every read of a chunk on top of the values carried into it."""
        starts_with = carried.column("_carry").to_pylist() if carried.num_rows else [None]
        held, found = list(starts_with[0] or []), []
        for row in sorted(rows_and_carry.to_pylist(), key=lambda r: (r[position], r["_kind"])):
            if row["_kind"] == 0:
                found.append({**{name: row[name] for name in names}, position: row[position], "values": list(held)})
            else:
                held = least([*held, row["_value"]])
        return pa.Table.from_pylist(found, output_layout)

    # The carry arrives once per chunk, beside the chunk's rows instead of on each of them.
    return merged.groupBy(*names, "_chunk").cogroup(carry.groupBy(*names, "_chunk")).applyInArrow(replay, output)
