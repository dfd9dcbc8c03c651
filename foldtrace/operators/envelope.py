"""Closed input envelopes: what a program may read, declared once and compiled to one expression.

An input is a JSON text with the members ``meta``, ``event`` and, for folds that read tables,
``rows``.  An ``Envelope`` declares every member; ``Envelope.error`` is a column with the reason
why a text does not fit, NULL when it does.  Checked in this order: size, depth, JSON, then
``meta``, ``event`` and ``rows``; inside an object first the declared fields by name (required,
null, type), then fields nobody declared.

An object is read by one cast to a map of VARIANT, which gives members and names at once, so
nothing is exploded and no row is shuffled.  Repeated keys are no valid JSON here.  The parser
stops at 1,000 containers; texts nested deeper, up to ``MAX_DEPTH``, are refused as not decodable.
A null text is not decodable.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .record_view import Problem
from .validate import MAX_INPUT_BYTES, oversized, value_error

# Fixed values.
MAX_DEPTH = 1024
SCALARS = ("TEXT", "INTEGER", "REAL", "BOOLEAN", "BLOB", "JSON")


@dataclass(frozen=True)
class Field:
    """A declared member.

    ``kind`` is a scalar type of ``SCALARS``, ``strings`` (an array of texts), ``object`` (with
    ``members``), ``rows`` (an array of objects with ``members``) or ``document`` (any object).
    """

    name: str
    kind: str
    optional: bool = False
    nullable: bool = False
    members: tuple[Field, ...] = ()


def _first(errors: Sequence[Column]) -> Column:
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


def _is_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, as the variable of a lambda.

    Branches of a condition share nothing in generated code: each would parse and cast again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _field_error(value: Column, declared: Field) -> Column:
    if declared.kind in SCALARS:
        return value_error(value, declared.kind, not declared.nullable)
    if declared.kind == "strings":
        items = _as(value, "array<variant>")
        other = F.exists(items, lambda item: F.schema_of_variant(item) != "STRING")
        error = F.when(items.isNull(), "must be a non-null string array").when(other, "must contain only strings")
    elif declared.kind == "document":
        error = F.when(_as(value, "map<string,variant>").isNull(), "must be a non-null JSON object")
    elif declared.kind == "object":
        error = object_error(value, declared.members)
    elif declared.kind == "rows":
        items = _as(value, "array<variant>")
        reasons = F.transform(items, lambda item, at: F.concat(F.lit("row "), at.cast("string"), F.lit(": "), object_error(item, declared.members)))
        error = F.when(items.isNull(), "must be an array of rows").otherwise(F.get(F.filter(reasons, lambda reason: reason.isNotNull()), F.lit(0)))
    else:
        raise ValueError(f"field {declared.name}: unknown kind {declared.kind}")
    return F.when(_is_null(value), None).otherwise(error) if declared.nullable else error


def object_error(value: Column, fields: Sequence[Field]) -> Column:
    """Reason why a VARIANT is not an object with exactly these members."""
    names = [declared.name for declared in fields]
    if len(set(names)) != len(names):
        raise ValueError(f"fields {names} repeat a name")
    return _once(_as(value, "map<string,variant>"), lambda members: _members_error(members, fields))


def _members_error(members: Column, fields: Sequence[Field]) -> Column:
    names = [declared.name for declared in fields]
    errors = [F.when(members.isNull(), "must be a non-null object")]
    for declared in sorted(fields, key=lambda item: item.name):
        member = F.try_element_at(members, F.lit(declared.name))
        absent = F.lit(None) if declared.optional else F.lit(f'field "{declared.name}" is required')
        wrong = F.concat(F.lit(f'field "{declared.name}": '), _field_error(member, declared))
        errors.append(F.when(members.isNotNull(), F.when(~F.map_contains_key(members, declared.name), absent).otherwise(wrong)))
    unknown = F.array_min(F.array_except(F.map_keys(members), F.array(*[F.lit(name) for name in names]).cast("array<string>")))
    errors.append(F.concat(F.lit('unknown field "'), unknown, F.lit('"')))
    return _first(errors)


def depth_error(text: Column, limit: int = MAX_DEPTH) -> Column:
    """Reason why a JSON text nests too many containers.

    Only brackets outside quotes count.  Their order is followed only where a text opens more
    than ``limit`` of them at all.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")
    brackets = F.regexp_replace(plain, r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def follow(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    opened = F.length(F.regexp_replace(brackets, r"[\]}]+", ""))
    most = F.aggregate(F.split(brackets, "", -1), start, lambda state, mark: F.when(mark == "", state).otherwise(follow(state, mark)), lambda state: state["most"])
    return F.when((opened > limit) & F.when(opened > limit, most > limit), f"evaluation input exceeds depth {limit}")


@dataclass(frozen=True)
class Envelope:
    """Declared input of a program; ``event`` may be null where ``event_nullable``."""

    meta: tuple[Field, ...]
    event: tuple[Field, ...]
    rows: Mapping[str, tuple[Field, ...]] = field(default_factory=dict)
    event_nullable: bool = False
    max_bytes: int = MAX_INPUT_BYTES
    max_depth: int = MAX_DEPTH

    def _fields(self) -> list[Field]:
        fields = [Field("meta", "object", members=self.meta), Field("event", "object", nullable=self.event_nullable, members=self.event)]
        if self.rows:
            reads = tuple(Field(name, "rows", members=members) for name, members in self.rows.items())
            fields.append(Field("rows", "object", members=reads))
        return fields

    def error(self, text: Column) -> Column:
        """Reason why a text does not fit."""
        too_long = F.when(F.octet_length(text) > self.max_bytes, F.concat(F.lit("evaluation "), oversized(text, self.max_bytes)))
        members = _as(F.try_parse_json(text), "map<string,variant>")
        return _first([too_long, depth_error(text, self.max_depth), _once(members, self._error)])

    def _error(self, members: Column) -> Column:
        errors = [F.when(members.isNull(), "evaluation input is not a JSON object")]
        fields = self._fields()
        for declared in fields:
            member = F.try_element_at(members, F.lit(declared.name))
            absent = F.when(~F.map_contains_key(members, declared.name), f"input {declared.name}: is required")
            errors += [absent, F.concat(F.lit(f"input {declared.name}: "), _field_error(member, declared))]
        known = F.array(*[F.lit(declared.name) for declared in fields])
        unknown = F.array_min(F.array_except(F.map_keys(members), known))
        return _first([*errors, F.concat(F.lit('input: unknown field "'), unknown, F.lit('"'))])

    def problems(self, text: Column) -> list[Problem]:
        """The same as problems of a normalizer: an app stops at a record whose input does not fit."""
        reason = self.error(text)
        return [(reason.isNotNull(), reason)]
