"""One app, one batch: gap rule, counters, sample, and the tables that follow."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.changes import running_total
from ..operators.record_view import effective_events, event_count
from ..plans.apps import App

C = F.col

# Fixed values.
SAMPLE_SIZE = 16
SAMPLE_PAYLOAD_BYTES = 32 * 1024
REASON_CHARS = 1024


@dataclass
class Frontier:
    """Progress of an app: what it has interpreted, and where it stopped."""

    boundary: int = 0
    position: int = 0
    complete: bool = True
    gap_position: int | None = None
    gap_reason: str | None = None
    consumed: int = 0
    ineffective: int = 0
    emitted: int = 0
    detached: int = 0

    @classmethod
    def of(cls, state: Mapping | None) -> Frontier:
        return cls(**state) if state else cls()

    def as_dict(self) -> dict:
        return asdict(self)


def check_violations(app: App, events: DataFrame, prior: Mapping[str, DataFrame]) -> DataFrame | None:
    """Events after which a kept total would be negative.

    Only totals fed by a negative value can fall below zero, so the ordered running sums
    are planned for the columns that hold one, which one small aggregate finds out.
    """
    wanted = sorted({column for columns in app.non_negative.values() for _, column in columns})
    if not wanted:
        return None
    lows = events.agg(*[F.min(column).alias(column) for column in wanted]).first()
    negative = {column for column in wanted if lows[column] is not None and lows[column] < 0}
    found = None
    for table, columns in app.non_negative.items():
        for total, column in columns:
            if column not in negative:
                continue
            sums = running_total(events, app.keys[table], column, "source_position")
            if table in prior:
                sums = sums.join(prior[table].select(*app.keys[table], C(total).alias("_stored")), list(app.keys[table]), "left")
            else:
                sums = sums.withColumn("_stored", F.lit(0))
            bad = sums.where(C("_running") + F.coalesce("_stored", F.lit(0)) < 0).select(
                C("source_position").alias("position"), F.lit(f"CHECK constraint failed: {total} >= 0").alias("reason")
            )
            found = bad if found is None else found.unionByName(bad)
    return found


def gap_frame(app: App, normalized: DataFrame, prior: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the earliest record that cannot be applied, and why (NULLs when there is none).

    Inside a record, what the normalizer refuses comes first, then changes in their order.
    """
    problems = normalized.where(C("error_reason").isNotNull()).select("position", C("error_reason").alias("reason"))
    checks = check_violations(app, effective_events(normalized), prior) if app.non_negative else None
    if checks is not None:
        problems = problems.unionByName(checks)
    broken = app.violations(normalized, prior) if app.violations is not None else None
    if broken is not None:
        kind = broken.schema["at"].dataType
        problems = problems.withColumn("at", F.lit(None).cast(kind)).unionByName(broken)
    else:
        problems = problems.withColumn("at", F.lit(None).cast("int"))
    first = F.min_by("reason", F.struct("position", "at", "reason"))
    return problems.agg(F.min("position").alias("position"), F.substring(first, 1, REASON_CHARS).alias("reason"))


def first_gap(app: App, normalized: DataFrame, prior: Mapping[str, DataFrame]) -> tuple[int, str] | None:
    """Earliest record that cannot be applied."""
    row = gap_frame(app, normalized, prior).first()
    return None if row.position is None else (row.position, row.reason)


def advance(
    app: App, normalized: DataFrame, frontier: Frontier, prior: Mapping[str, DataFrame]
) -> tuple[dict[str, DataFrame], Frontier]:
    """Tables and frontier after a batch; ``normalized`` should be persisted by the caller.

    Records at or before the frontier were applied already.  The first record that fails
    stops the app: earlier ones count, later ones are detached.
    """
    fresh = normalized.where(C("position") > max(frontier.position, frontier.boundary))
    if frontier.gap_position is not None:
        frontier.detached += fresh.count()
        return {}, frontier
    span = fresh.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("low"), F.max("position").alias("high")).first()
    if span.n == 0:
        return {}, frontier
    if span.low != max(frontier.position, frontier.boundary) + 1 or span.high - span.low + 1 != span.n:
        raise ValueError(f"{app.name}: positions {span.low}..{span.high} ({span.n} records) do not continue {frontier.position}")
    gap = first_gap(app, fresh, prior)
    applied = fresh if gap is None else fresh.where(C("position") < gap[0])
    counts = applied.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~C("effective")).alias("ineffective"), F.sum(event_count(applied)).alias("emitted")
    ).first()
    frontier.consumed += counts.n
    frontier.ineffective += counts.ineffective
    frontier.emitted += counts.emitted or 0
    frontier.position = span.high if gap is None else gap[0] - 1
    if gap is not None:
        frontier.complete, (frontier.gap_position, frontier.gap_reason) = False, gap
        frontier.detached += span.n - counts.n
    plans = app.plans(applied, prior)
    return {name: plan() for name, plan in plans.items()}, frontier


def ineffective_sample(
    records: DataFrame, normalized: DataFrame, payload: str = "record", earlier: DataFrame | None = None
) -> DataFrame:
    """Latest records an app did not use; large payloads are left out.

    ``records`` hold the normalized positions.  Their payloads are looked up by at most
    ``SAMPLE_SIZE`` broadcast rows, so no payload but those is moved or written as text.
    """
    latest = (
        normalized.where(~C("effective") & C("error_reason").isNull())
        .select("position", "event_id", "signal", "name", "source")
        .orderBy(C("position").desc())
        .limit(SAMPLE_SIZE)
    )
    kept = [C(payload).alias("_payload")] if payload in records.columns else []
    found = records.select("position", *kept).join(F.broadcast(latest), "position")
    text = F.to_json(F.struct(C("_payload").alias(payload))) if kept else F.lit(None).cast("string")
    size = F.octet_length("_text")
    rows = found.withColumn("_text", text).select(
        *latest.columns,
        F.when(size <= SAMPLE_PAYLOAD_BYTES, C("_text")).alias("payload"),
        F.coalesce(size > SAMPLE_PAYLOAD_BYTES, F.lit(False)).alias("payload_omitted"),
    )
    if earlier is not None:
        rows = rows.unionByName(earlier)
    return rows.orderBy(C("position").desc()).limit(SAMPLE_SIZE)


def intake(records: DataFrame) -> DataFrame:
    """Records, canonical bytes and last position per signal: all counters of a batch in one pass.

    An aggregate and not observed metrics, which count a task's rows again when a lost executor
    makes it run twice.
    """
    size = C("canonical_bytes") if "canonical_bytes" in records.columns else F.octet_length(F.to_json(F.struct("attributes")))
    return records.groupBy("signal").agg(F.count(F.lit(1)).alias("records"), F.sum(size.cast("bigint")).alias("bytes"), F.max("position").alias("last_position"))


def shape_change(app: App, entry: Mapping, planned: Mapping[str, DataFrame]) -> str | None:
    """Why the stored tables of an app cannot be continued by another revision of it."""
    shapes = app.shape()
    for name, stored in entry["schemas"].items():
        if name not in planned:
            return f"{app.name}.{name}: stored table was removed"
        if not same_shape(stored, planned[name]):
            return f"{app.name}.{name}: stored table has another shape; rebuild it"
        before = entry.get("shape", {}).get(name, shapes[name])
        if before != shapes[name]:
            parts = sorted(part for part in shapes[name] if before.get(part) != shapes[name][part])
            return f"{app.name}.{name}: stored table has other {', '.join(parts)}; rebuild it"
    return None


def same_shape(stored: str, frame: DataFrame) -> bool:
    """Whether a stored table can be continued by this plan."""

    def shape(fields: list[dict]) -> list[tuple[str, str]]:
        return [(item["name"], json.dumps(item["type"])) for item in fields]

    return shape(json.loads(stored)["fields"]) == shape(json.loads(frame.schema.json())["fields"])
