"""The shipped apps: a normalizer and the tables folded from its events."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import (
    app_folds,
    guard_folds,
    normalize_activity,
    normalize_guard,
    normalize_review,
    normalize_signal,
    normalize_url,
    normalize_usage,
    url_folds,
)
from ..operators.record_view import effective_events

Tables = dict[str, DataFrame]
Plans = dict[str, Callable[[], DataFrame]]


@dataclass(frozen=True)
class App:
    """A normalizer, the fold from (events, stored tables) to tables, and the table keys.

    ``append_only`` tables are keyed by position: a batch only adds rows to them, so
    their stored files are kept and extended instead of rewritten.
    """

    name: str
    normalize: Callable[[DataFrame], DataFrame]
    fold: Callable[[DataFrame, Mapping[str, DataFrame]], Plans]
    keys: Mapping[str, tuple[str, ...]]
    append_only: frozenset[str] = field(default_factory=frozenset)
    views: Mapping[str, str] = field(default_factory=dict)
    revision: str = "1"
    # Totals that must never be negative: table -> ((total column, event column), ...).
    non_negative: Mapping[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    # Instead of ``fold``, from normalized records; and what these break: (position, at, reason).
    apply: Callable[[DataFrame, Mapping[str, DataFrame]], Plans] | None = None
    violations: Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame | None] | None = None
    # Declared rules of a table in words, part of its stored shape.
    rules: Mapping[str, str] = field(default_factory=dict)
    # Logical types that a column's Spark type does not tell: table -> column -> type.
    logical: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    # Tables and views that other apps may mount; None for all.
    exports: tuple[str, ...] | None = None

    def plans(self, normalized: DataFrame, prior: Mapping[str, DataFrame]) -> Plans:
        if self.apply is not None:
            return self.apply(normalized, prior)
        return self.fold(effective_events(normalized), prior)

    def events(self, records: DataFrame) -> DataFrame:
        return effective_events(self.normalize(records))

    def tables(self, records: DataFrame, only: str | None = None) -> Tables:
        """Tables of a batch that starts from nothing; ``only`` plans a single one.

        Records that the normalizer refuses are left out and the rest is folded; ``refused``
        returns them.  A stream stops before the first of them instead (``Runner``), so the two
        agree where nothing is refused.
        """
        plans = self.plans(self.normalize(records), {})
        return {name: plan() for name, plan in plans.items() if only is None or name == only}

    def refused(self, records: DataFrame) -> DataFrame:
        """(position, reason) of the records that cannot be applied."""
        return self.normalize(records).where(F.col("error_reason").isNotNull()).select("position", F.col("error_reason").alias("reason"))

    def shape(self) -> dict[str, dict]:
        """Keys and rules of every table, as they are stored beside its columns."""
        return {
            name: {
                "keys": list(keys),
                "non_negative": sorted(total for total, _ in self.non_negative.get(name, ())),
                "rules": self.rules.get(name, ""),
                "append_only": name in self.append_only,
            }
            for name, keys in self.keys.items()
        }

    def planned(self, records: DataFrame) -> Tables:
        """The empty tables, planned over no record; keys and declarations are checked against them."""
        tables = self.tables(records.limit(0))
        if set(tables) != set(self.keys):
            raise ValueError(f"{self.name}: keys are declared for {sorted(self.keys)}, tables are {sorted(tables)}")
        for name, declared in self.logical.items():
            if name not in tables or not set(declared) <= set(tables[name].columns):
                raise ValueError(f"{self.name}.{name}: logical types {dict(declared)} do not fit its columns")
        for name in self.exports or ():
            if name not in tables and name not in self.views:
                raise ValueError(f"{self.name}: export {name} is no table or view")
        self.contracts(tables)
        return tables

    def validate(self, records: DataFrame) -> dict[str, str]:
        """Check keys against analysed schemas; returns the contract digest of every export."""
        return self.contracts(self.planned(records))

    def contracts(self, tables: Tables) -> dict[str, str]:
        contracts = {}
        for name, keys in self.keys.items():
            columns = tables[name].columns
            if not keys or len(set(keys)) != len(keys) or any(key not in columns for key in keys):
                raise ValueError(f"{self.name}.{name}: primary key {keys} does not fit columns {columns}")
            contracts[name] = contract_digest(tables[name])
        return contracts


def contract_digest(frame: DataFrame) -> str:
    return "sha256:" + hashlib.sha256(frame.schema.json().encode()).hexdigest()


def _folded(*folds) -> Callable[[DataFrame, Mapping[str, DataFrame]], Plans]:
    def run(events: DataFrame, prior: Mapping[str, DataFrame]) -> Plans:
        return {fold.table: partial(fold.apply, events, prior.get(fold.table)) for fold in folds}

    return run


def signal_counts() -> App:
    fold = app_folds.signal_counts()
    return App("signal-counts", normalize_signal.normalize, _folded(fold), {fold.table: fold.keys})


def session_cost() -> App:
    folds = (app_folds.session_cost(), app_folds.session_cost_detail())
    return App("session-cost", normalize_usage.normalize, _folded(*folds), {f.table: f.keys for f in folds})


def activity_stats() -> App:
    folds = (app_folds.event_inventory(), app_folds.session_activity(), app_folds.request_performance())
    usage = tuple((name, name) for name in app_folds.USAGE)
    length = ("reported_length_total", "reported_length")
    duration = ("duration_milliseconds_total", "duration_milliseconds")
    return App(
        "activity-stats",
        normalize_activity.normalize,
        _folded(*folds),
        {f.table: f.keys for f in folds},
        non_negative={"event_inventory": (length, duration), "session_activity": (length, *usage)},
    )


def daily_review() -> App:
    fold = app_folds.daily_review()
    return App("daily-review", normalize_review.normalize, _folded(fold), {fold.table: fold.keys})


def agent_guard(chunk: int = guard_folds.runs.CHUNK_POSITIONS) -> App:
    def run(events: DataFrame, prior: Mapping[str, DataFrame]) -> Plans:
        @cache
        def sessions() -> tuple[DataFrame, DataFrame]:
            return guard_folds.session_tables(events, prior.get("session_progress"), prior.get("loop_findings"), chunk)

        return {
            "telemetry_coverage": partial(guard_folds.telemetry_coverage, events, prior.get("telemetry_coverage")),
            "session_progress": lambda: sessions()[0],
            "policy_violations": partial(guard_folds.policy_violations, events),
            "policy_gaps": partial(guard_folds.policy_gaps, events, prior.get("policy_gaps")),
            "loop_findings": lambda: sessions()[1],
            "tool_failure_detail": partial(guard_folds.tool_failure_detail, events),
        }

    findings = "SELECT * FROM policy_violations UNION ALL SELECT * FROM policy_gaps"
    return App(
        "agent-guard",
        normalize_guard.normalize,
        run,
        {
            "telemetry_coverage": ("harness", "capability"),
            "session_progress": ("harness", "session_id"),
            "policy_violations": ("finding_id",),
            "policy_gaps": ("finding_id",),
            "loop_findings": ("finding_id",),
            "tool_failure_detail": ("source_position",),
        },
        append_only=frozenset({"policy_violations", "tool_failure_detail"}),
        views={"policy_findings": findings, "open_guard_findings": findings},
        logical={name: {"evidence": "JSON"} for name in ("policy_violations", "policy_gaps", "loop_findings")},
    )


def url_reputation(namespace: str = normalize_url.DEFAULT_NAMESPACE, keep_prior_on_null: bool = False) -> App:
    observations = url_folds.url_observations(keep_prior_on_null)
    counts = url_folds.url_family_counts()

    def run(events: DataFrame, prior: Mapping[str, DataFrame]) -> Plans:
        return {
            observations.table: partial(observations.apply, events, prior.get(observations.table)),
            "url_exclusions": partial(url_folds.url_exclusions, events, prior.get("url_exclusions")),
            "url_verdicts": partial(url_folds.url_verdicts, events, prior.get("url_verdicts")),
            counts.table: partial(counts.apply, events, prior.get(counts.table)),
        }

    return App(
        "url-reputation",
        lambda records: normalize_url.normalize(records, namespace),
        run,
        {
            observations.table: observations.keys,
            "url_exclusions": ("exclusion_id",),
            "url_verdicts": ("observed_full", "provider"),
            counts.table: counts.keys,
        },
    )


SHIPPED = {
    "signal-counts": signal_counts,
    "session-cost": session_cost,
    "activity-stats": activity_stats,
    "daily-review": daily_review,
    "agent-guard": agent_guard,
    "url-reputation": url_reputation,
}


def shipped_apps() -> list[App]:
    return [build() for build in SHIPPED.values()]
