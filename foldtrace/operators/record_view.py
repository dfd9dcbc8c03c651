"""What every normalizer derives first: event name, harness, time and session."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.values import Attributes, Value, any_of, first_truthy, not_integral, promote, to_integer

Problem = tuple[Column, str]


def mapped(key: Column, table: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """Look a text up in a small fixed table, as one CASE over grouped values."""
    groups: dict[str, list[str]] = {}
    for name, bucket in table.items():
        groups.setdefault(bucket, []).append(name)
    case = None
    for bucket, names in groups.items():
        test = key.isin(*names)
        case = F.when(test, bucket) if case is None else case.when(test, bucket)
    return case if otherwise is None else case.otherwise(otherwise)


def harness_of(source: Column) -> Column:
    return mapped(source, V.HARNESS_OF_SOURCE, source)


def event_time_of(records: DataFrame) -> Column:
    """Event time, else observed time, else NULL; empty text counts as missing."""
    return F.coalesce(F.nullif("time_unix_nano", F.lit("")), F.nullif("observed_unix_nano", F.lit("")))


def semantic_name(records: DataFrame, attributes: Attributes) -> Column:
    """Name the record goes by: a qualifying body, else ``event.name``, else the envelope name."""
    named = attributes["event.name"]
    envelope = F.col("name")
    name = F.when(named.filled, named.text).otherwise(envelope) if not named.is_absent else envelope
    if "body" not in records.columns:
        return name
    from ..functions.values import kind_of

    body = Value(F.col("body"), kind_of(records.schema["body"].dataType)).text
    takes_body = (F.col("source") == V.BODY_NAMED_SOURCE) & body.startswith(V.BODY_NAME_PREFIX)
    return F.when(takes_body, body).otherwise(name)


class RecordView:
    """Canonical records with the shared derivations as columns.

    ``attrs`` and ``resource`` give attribute access; ``_name``, ``harness``, ``_time``,
    ``session_id`` and ``_session_known`` are columns of ``frame``.
    """

    def __init__(self, records: DataFrame, keys: Iterable[str] = ()) -> None:
        wanted = ["event.name", *V.SESSION_KEYS, *keys]
        frame, self.attrs = promote(records, "attributes", wanted, "_a")
        frame, self.resource = promote(frame, "resource_attributes", V.SESSION_RESOURCE_KEYS, "_r")
        session = first_truthy(
            *[self.attrs[key] for key in V.SESSION_KEYS],
            *[self.resource[key] for key in V.SESSION_RESOURCE_KEYS],
        )
        harness = harness_of(F.col("source"))
        frame = frame.withColumns(
            {
                "_name": semantic_name(records, self.attrs),
                "harness": harness,
                "_time": event_time_of(records),
                "_session_known": session.filled,
                "_session": session.text,
            }
        )
        self.frame = frame.withColumn(
            "session_id",
            F.when(F.col("_session_known"), F.col("_session")).otherwise(
                F.concat(F.lit("unknown:"), F.col("harness"))
            ),
        )
        self.name = F.col("_name")
        self.has_time = F.col("_time").isNotNull()
        self.session_known = F.col("_session_known")

    def is_log_of(self, names: Mapping[str, str]) -> Column:
        """A log of one of these harnesses carrying that harness's unqualified name."""
        log = F.col("signal") == "log"
        return log & any_of(
            (F.col("harness") == harness) & (self.name == name) for harness, name in names.items()
        )

    @property
    def is_tool(self) -> Column:
        return self.name.isin(*V.TOOL_RESULT_EVENTS) | self.is_log_of(V.LOG_TOOL_EVENTS)

    @property
    def is_api_request(self) -> Column:
        return self.name.isin(*V.API_REQUEST_EVENTS) | self.is_log_of(V.LOG_API_EVENTS)


def outcome(success: Value, status_code: Value, status: Value) -> Column:
    """``success`` attribute first, then status text or number, else unknown."""
    number = F.coalesce(status_code.number, F.lit(0.0))
    text = F.lower(F.coalesce(status.text, F.lit("")))
    return (
        F.when(success.is_true, "success")
        .when(success.exists, "failure")
        .when(text.isin(*V.SUCCESS_TEXTS) | ((number >= 200) & (number < 400)), "success")
        .when(text.isin(*V.FAILURE_TEXTS) | (number >= 400), "failure")
        .otherwise("unknown")
    )


def covered_text(value: Value, default: str = "unknown", chars: int | None = None) -> Column:
    text = value.text if chars is None else F.substring(value.text, 1, chars)
    return F.when(value.filled, text).otherwise(default)


def coverage(known: Column, applicable: Column | None = None) -> Column:
    state = F.when(known, "observed").otherwise("unknown")
    return state if applicable is None else F.when(applicable, state).otherwise("not-applicable")


def first_problem(problems: Sequence[Problem]) -> Column:
    """Reason of the first condition that holds, NULL when none does."""
    if not problems:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in problems])


def number_problems(values: Mapping[str, Value], guard: Column | None = None) -> list[Problem]:
    """A value used as a number that has no numeric form stops the app at that record."""
    problems = []
    for name, value in values.items():
        if value.number_error is not None:
            test = value.number_error if guard is None else guard & value.number_error
            problems.append((test, f"{name}: must be numeric"))
    return problems


def integer_problems(columns: Mapping[str, Column], effective: Column) -> list[Problem]:
    return [
        (effective & F.coalesce(not_integral(column), F.lit(False)), f'column "{name}": must be an exactly representable integer')
        for name, column in columns.items()
    ]


def finish(
    frame: DataFrame,
    effective: Column,
    problems: Sequence[Problem],
    columns: Mapping[str, Column],
    integers: Sequence[str] = (),
) -> DataFrame:
    """Emit the event columns next to the decision and the error reason.

    Integers are checked on their numeric form before the narrowing cast.
    """
    effective = F.coalesce(effective, F.lit(False))
    staged = frame.select(
        "position",
        "event_id",
        "signal",
        "name",
        "source",
        effective.alias("effective"),
        first_problem(problems).alias("_early"),
        *[column.alias(name) for name, column in columns.items()],
    )
    kinds = {field.name: field.dataType.typeName() for field in staged.schema}
    checked = {name: F.col(name) for name in integers}
    late = first_problem(integer_problems(checked, F.col("effective")))
    return staged.select(
        "position",
        "event_id",
        "signal",
        "name",
        "source",
        "effective",
        F.coalesce(F.col("_early"), late).alias("error_reason"),
        *[
            (to_integer(F.col(name)).alias(name) if name in checked and kinds[name] != "long" else F.col(name))
            for name in columns
        ],
    )


MAX_EVENTS = 256


def finish_many(frame: DataFrame, events: Column, problems: Sequence[Problem] = (), kept: Mapping[str, Column] | None = None) -> DataFrame:
    """Decision of a normalizer that gives an array of event structs per record.

    A record without events is ineffective, one with more than ``MAX_EVENTS`` an error.
    ``kept`` are further columns for tables of the normalizer.
    """
    staged = frame.select(
        "position", "event_id", "signal", "name", "source", first_problem(problems).alias("_early"), events.alias("events"),
        *[column.alias(name) for name, column in (kept or {}).items()],
    )
    size = F.coalesce(F.size("events"), F.lit(0))
    too_many = F.when(size > MAX_EVENTS, F.lit(f"more than {MAX_EVENTS} events"))
    return staged.select(
        "position", "event_id", "signal", "name", "source", (size > 0).alias("effective"), F.coalesce("_early", too_many).alias("error_reason"),
        "events", *(kept or {}),
    )


def event_count(normalized: DataFrame) -> Column:
    """How many events a record gives."""
    if "events" in normalized.columns:
        return F.coalesce(F.size("events"), F.lit(0))
    return F.col("effective").cast("int")


def accepted_records(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("error_reason").isNull())


def effective_events(normalized: DataFrame) -> DataFrame:
    """Events of the records that were accepted without error.

    A record yields a list of events, empty when it was not accepted, and the list is
    expanded.  Being generator output, event columns stay computed once: a later filter
    on them is not pushed below, where the optimizer would repeat the whole alias chains
    inside the predicate.
    """
    accepted = F.col("effective") & F.col("error_reason").isNull()
    if "events" in normalized.columns:
        listed = normalized.select("position", "event_id", "signal", "name", "source", F.posexplode(F.when(accepted, F.col("events"))).alias("ordinal", "_event"))
        numbered = F.concat_ws("#", "event_id", F.col("ordinal").cast("string")).alias("event_id")
        return listed.select("position", numbered, "signal", "name", "source", "ordinal", "_event.*")
    columns = [name for name in normalized.columns if name not in ("effective", "error_reason")]
    staged = normalized.select(accepted.alias("_accepted"), F.struct(*columns).alias("_event"))
    return staged.select(F.inline(F.when(F.col("_accepted"), F.array(F.col("_event")))))
