"""Column helpers for loosely typed attribute values.

Harness attributes carry any JSON value, and the apps care about the difference
between *missing*, *null*, *empty* and *zero*.  ``Value`` pairs a column with how it
is typed so that the same normalizer runs over two layouts:

* ``VARIANT`` attributes, where a missing key is SQL NULL and a JSON null is a
  non-null variant holding null, and
* typed struct attributes (promoted columns), where a field the schema lacks is
  absent at plan time, so whole alias chains fold away before Catalyst sees them.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exact-integer range of a JSON number, and the text form of a number.
MAX_EXACT_INTEGER = 9007199254740991
NUMERIC_TEXT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"

_TYPED = {
    T.StringType: "string",
    T.ByteType: "long",
    T.ShortType: "long",
    T.IntegerType: "long",
    T.LongType: "long",
    T.FloatType: "double",
    T.DoubleType: "double",
    T.BooleanType: "boolean",
    T.VariantType: "variant",
}


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return "double"
    return _TYPED.get(type(data_type), "nested")


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; false when there are none."""
    result = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return F.lit(False) if result is None else result


class Value:
    """One attribute value: a column and its kind (``absent`` when the schema lacks it)."""

    __slots__ = ("col", "kind")

    def __init__(self, col: Column | None, kind: str) -> None:
        if kind == "nested":
            col, kind = F.to_variant_object(col), "variant"
        self.col, self.kind = col, kind

    @classmethod
    def absent(cls) -> Value:
        return cls(None, "absent")

    @property
    def is_absent(self) -> bool:
        return self.kind == "absent"

    # -- presence ---------------------------------------------------------------
    @property
    def exists(self) -> Column:
        """Present in the record; an explicit null counts as present."""
        return F.lit(False) if self.is_absent else self.col.isNotNull()

    @property
    def truthy(self) -> Column:
        """False for missing, null, ``""``, ``0``, ``false`` and empty containers."""
        if self.is_absent:
            return F.lit(False)
        if self.kind == "variant":
            return F.coalesce(_variant_truthy(self.col), F.lit(False))
        if self.kind == "string":
            test = self.col != ""
        elif self.kind == "boolean":
            test = self.col
        else:
            test = self.col != 0
        return F.coalesce(test, F.lit(False))

    # -- conversions --------------------------------------------------------------
    @property
    def text(self) -> Column:
        """Text form: strings as they are, anything else as JSON text, null as ``null``."""
        if self.is_absent:
            return F.lit(None).cast("string")
        if self.kind == "variant":
            return F.coalesce(
                F.try_variant_get(self.col, "$", "string"),
                F.when(self.col.isNotNull(), F.lit("null")),
            )
        return self.col if self.kind == "string" else self.col.cast("string")

    @property
    def filled(self) -> Column:
        """Present with non-empty text."""
        return F.lit(False) if self.is_absent else F.coalesce(self.text != "", F.lit(False))

    @property
    def number(self) -> Column:
        """Numeric form as DOUBLE; NULL when missing or when it has none (see ``number_error``)."""
        if self.is_absent:
            return F.lit(None).cast("double")
        if self.kind == "variant":
            kind = F.schema_of_variant(self.col)
            raw = F.try_variant_get(self.col, "$", "string")
            return (
                F.when(kind == "STRING", F.when(raw.rlike(NUMERIC_TEXT), raw.try_cast("double")))
                .when(kind == "BOOLEAN", F.try_variant_get(self.col, "$", "boolean").cast("double"))
                .otherwise(F.try_variant_get(self.col, "$", "double"))
            )
        if self.kind == "string":
            return F.when(self.col.rlike(NUMERIC_TEXT), self.col.try_cast("double"))
        return self.col.cast("double")

    @property
    def number_error(self) -> Column | None:
        """Condition under which the value is present but not numeric; None when it cannot be."""
        if self.kind in ("absent", "long", "double", "boolean"):
            return None
        return self.exists & self.number.isNull()

    @property
    def is_true(self) -> Column:
        """Boolean true, or the text ``true``."""
        if self.is_absent:
            return F.lit(False)
        if self.kind == "boolean":
            return F.coalesce(self.col, F.lit(False))
        return F.coalesce(self.text == "true", F.lit(False))

    @property
    def boolean(self) -> Column:
        """The value when it is a JSON boolean, NULL otherwise."""
        if self.kind == "boolean":
            return self.col
        if self.kind == "variant":
            return F.when(F.schema_of_variant(self.col) == "BOOLEAN", F.try_variant_get(self.col, "$", "boolean"))
        return F.lit(None).cast("boolean")

    def as_variant(self) -> Value:
        return self if self.kind == "variant" else Value(self.col.cast("variant"), "variant")


# JSON text of an array that holds nothing but empty texts, zeros, false, null, {} and such arrays.
_EMPTY_MEMBERS = r"^(\[|\]|,|null|false|-?0(\.0+)?([eE][+-]?[0-9]+)?|\"\"|\{\})*$"


def _variant_truthy(col: Column) -> Column:
    kind = F.schema_of_variant(col)
    text = F.try_variant_get(col, "$", "string")
    return (
        F.when(kind == "STRING", text != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(col, "$", "boolean"))
        .when(kind.startswith("OBJECT"), text != "{}")
        .when(kind.startswith("ARRAY"), ~F.to_json(col).rlike(_EMPTY_MEMBERS))
        .otherwise(F.coalesce(F.try_variant_get(col, "$", "double") != 0, F.lit(False)))
    )


def _same_kind(values: list[Value]) -> list[Value]:
    if len({value.kind for value in values}) == 1:
        return values
    return [value.as_variant() for value in values]


def first_existing(*values: Value) -> Value:
    """First value that is present; an explicit null stops the chain."""
    present = [value for value in values if not value.is_absent]
    if not present:
        return Value.absent()
    present = _same_kind(present)
    if len(present) == 1:
        return present[0]
    return Value(F.coalesce(*[value.col for value in present]), present[0].kind)


def first_truthy(*values: Value) -> Value:
    """First truthy value, otherwise the last alternative as it is."""
    *heads, last = values
    chain = [value for value in heads if not value.is_absent]
    if not chain:
        return last
    if last.is_absent:
        chain = _same_kind(chain)
        return Value(F.coalesce(*[F.when(v.truthy, v.col) for v in chain]), chain[0].kind)
    chain = _same_kind([*chain, last])
    picked = [F.when(v.truthy, v.col) for v in chain[:-1]]
    return Value(F.coalesce(*picked, chain[-1].col), chain[0].kind)


class Attributes:
    """Keyed access to an attribute column, chosen by the column's type at plan time."""

    def __init__(self, frame: DataFrame, column: str) -> None:
        self._column = column
        self._type = frame.schema[column].dataType if column in frame.columns else None
        self._cached: dict[str, Value] = {}

    def __getitem__(self, key: str) -> Value:
        if key in self._cached:
            return self._cached[key]
        if isinstance(self._type, T.StructType):
            if key not in self._type.fieldNames():
                return Value.absent()
            return Value(F.col(self._column).getField(key), kind_of(self._type[key].dataType))
        if isinstance(self._type, T.MapType):
            return Value(F.element_at(F.col(self._column), F.lit(key)), kind_of(self._type.valueType))
        if isinstance(self._type, T.VariantType):
            return Value(F.try_variant_get(F.col(self._column), path_of(key), "variant"), "variant")
        return Value.absent()

    def any_present(self, keys: Iterable[str]) -> Column:
        return any_of(self[key].exists for key in keys if not self[key].is_absent)

    def first_existing(self, keys: Iterable[str]) -> Value:
        return first_existing(*[self[key] for key in keys])

    def first_truthy(self, keys: Iterable[str]) -> Value:
        return first_truthy(*[self[key] for key in keys])


def path_of(*keys: str) -> str:
    """Variant path of nested object keys; keys may contain dots."""
    return "$" + "".join(f'["{key}"]' for key in keys)


# -- integers and the JSON-safe codec ---------------------------------------------


def counter(value: Value) -> Column:
    """Numeric value, zero when missing."""
    if value.is_absent:
        return F.lit(0).cast("bigint")
    if value.kind == "long":
        return F.coalesce(value.col.cast("bigint"), F.lit(0))
    return F.when(value.exists, value.number).otherwise(F.lit(0.0))


def not_integral(number: Column) -> Column:
    """True when a number breaks the INTEGER rule: not whole, or outside +-(2^53-1)."""
    wide = number.cast("double")
    return (wide != F.floor(wide)) | (F.abs(wide) > F.lit(float(MAX_EXACT_INTEGER))) | F.isnan(wide)


def to_integer(number: Column) -> Column:
    return number.try_cast("bigint")


def round_half_even(number: Column) -> Column:
    return F.rint(number)


def exact_product(number: Column, factor: int) -> Column:
    """A 64-bit integer times a 64-bit factor, as a decimal: it holds any such product."""
    return number.cast("decimal(19,0)") * F.lit(Decimal(factor))


def wrap_integer(number: Column) -> Column:
    """JSON text of an integer: bare inside the exact range, a decimal-text wrapper outside."""
    digits = number.cast("string")
    outside = (number > MAX_EXACT_INTEGER) | (number < -MAX_EXACT_INTEGER)
    return F.when(outside, F.concat(F.lit('{"integer_decimal":"'), digits, F.lit('"}'))).otherwise(digits)


def wrap_bytes(data: Column) -> Column:
    """JSON text of raw bytes: a base64 wrapper."""
    return F.when(
        data.isNotNull(), F.concat(F.lit('{"bytes_base64":"'), F.base64(data), F.lit('"}'))
    )


def finite(number: Column) -> Column:
    """The number itself, NULL when it is NaN or infinite."""
    infinity = float("inf")
    return F.when(~F.isnan(number) & (F.abs(number) != infinity), number)


# -- unsigned 64-bit nanosecond texts -----------------------------------------------


def pack_nanos(text: Column) -> Column:
    """Unsigned 64-bit decimal text as LONG bits.

    A LONG buffer keeps first/last aggregation in hash aggregation with code
    generation; text buffers would force a sort of every partition.
    """
    return F.coalesce(
        text.try_cast("bigint"),
        (text.try_cast("decimal(20,0)") - F.lit("18446744073709551616").cast("decimal(20,0)")).try_cast("bigint"),
    )


def unpack_nanos(bits: Column) -> Column:
    return F.when(bits >= 0, bits.cast("string")).otherwise(
        (bits.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)"))
        .cast("decimal(20,0)")
        .cast("string")
    )


def utc_day(nanos: Column) -> Column:
    """Day number, computed in double precision."""
    return F.floor(nanos.cast("double") / F.lit(86400000000000.0))


def promote(frame: DataFrame, column: str, keys: Iterable[str], prefix: str) -> tuple[DataFrame, Attributes]:
    """Pull the named keys of an attribute column into columns of their own, once each.

    Alias chains refer to a key many times; as a column it is extracted once per record.
    Keys the schema lacks stay absent.
    """
    attributes = Attributes(frame, column)
    found = {key: attributes[key] for key in dict.fromkeys(keys)}
    found = {key: value for key, value in found.items() if not value.is_absent}
    names = {key: f"{prefix}{index}" for index, key in enumerate(found)}
    if found:
        frame = frame.withColumns({names[key]: value.col for key, value in found.items()})
    attributes._cached = {key: Value(F.col(names[key]), value.kind) for key, value in found.items()}
    return frame, attributes
