"""Row rules as columns: declared types, NOT NULL and size bounds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import not_integral

# Fixed values.
MAX_INPUT_BYTES = 256 * 1024


def value_error(value: Column, logical: str, required: bool) -> Column:
    """Reason a loosely typed (VARIANT) value does not fit its declared type, NULL when it fits."""
    kind = F.schema_of_variant(value)
    missing = value.isNull() | (kind == "VOID")
    number = F.try_variant_get(value, "$", "double")
    numeric = ~kind.isin("STRING", "BOOLEAN") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & number.isNotNull()
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    fits = {
        "TEXT": kind == "STRING",
        "INTEGER": numeric & ~F.coalesce(not_integral(number), F.lit(True)),
        "REAL": numeric,
        "BOOLEAN": kind == "BOOLEAN",
        "BLOB": F.try_to_binary(text, F.lit("base64")).isNotNull(),
        "JSON": F.lit(True),
    }[logical]
    expected = {
        "TEXT": "must be string",
        "INTEGER": "must be an exactly representable JSON integer",
        "REAL": "must be a finite number",
        "BOOLEAN": "must be boolean",
        "BLOB": "must be base64 text",
        "JSON": "",
    }[logical]
    absent = F.when(F.lit(required), "must not be null")
    return F.when(missing, absent).when(~F.coalesce(fits, F.lit(False)), expected)


def column_error(name: str, logical: str, required: bool) -> Column:
    """The same for a column, which the reason names."""
    return F.concat(F.lit(f'column "{name}": '), value_error(F.col(name), logical, required))


def validate_rows(rows: DataFrame, declared: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Rows with the first violated rule as ``error_reason``."""
    errors = [column_error(name, logical, required) for name, (logical, required) in declared.items()]
    return rows.withColumn("error_reason", F.coalesce(*errors))


def oversized(text: Column, limit: int = MAX_INPUT_BYTES) -> Column:
    return F.when(F.octet_length(text) > limit, f"input exceeds {limit} bytes")

