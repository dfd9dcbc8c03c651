"""Apps made of programs: a normalizer with 0 to 256 events per record and tables of its own,
and folds that turn events into ordered changes of constrained tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import constraints
from ..operators.changes import apply_changes
from ..operators.constraints import Rules
from ..operators.record_view import effective_events, accepted_records
from .apps import App

# Fixed value: row changes that one evaluation of a program may give.
MAX_CHANGES = 1024

# Rows of a table with ``op`` (insert, upsert or delete), made from records or from events.
Program = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Programs:
    """``own`` programs read normalized records and come before the folds of their events;
    folds run for each event in the order given."""

    rules: Mapping[str, Rules]
    own: Mapping[str, Program]
    folds: Sequence[Mapping[str, Program]]
    max_changes: int = MAX_CHANGES

    def changes(self, table: str, normalized: DataFrame) -> DataFrame:
        """Ordered changes of a table by the records that were accepted."""
        parts = []
        if table in self.own:
            rows = self.own[table](accepted_records(normalized))
            parts.append(rows.withColumns({"ordinal": F.lit(-1), "step": F.lit(-1)}))
        events = effective_events(normalized)
        for step, fold in enumerate(self.folds):
            if table in fold:
                parts.append(fold[table](events).withColumn("step", F.lit(step)))
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        return merged

    def tables(self, normalized: DataFrame, prior: Mapping[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
        def build(table: str) -> DataFrame:
            return apply_changes(self.changes(table, normalized), list(self.rules[table].keys), prior.get(table))

        return {table: partial(build, table) for table in self.rules}

    def oversized(self, normalized: DataFrame) -> DataFrame:
        """Evaluations with more than ``max_changes`` row changes over all tables: (position, at, reason).

        An evaluation is a program over one record or event.  It is refused whole, so its place in
        the order is before its first change.
        """
        parts = [self.changes(table, normalized).select("position", "ordinal", "step") for table in self.rules]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        found = merged.groupBy("position", "ordinal", "step").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.max_changes)
        at = F.struct(F.col("position").alias("p"), F.col("ordinal").alias("o"), F.col("step").alias("s"), F.lit(-1).alias("r"))
        return found.select("position", at.alias("at"), F.lit(f"row changes exceed {self.max_changes}").alias("reason"))

    def violations(self, normalized: DataFrame, prior: Mapping[str, DataFrame]) -> DataFrame | None:
        found = self.oversized(normalized) if self.rules else None
        for table, rules in self.rules.items():
            bad = constraints.violations(table, self.changes(table, normalized), rules, prior.get(table))
            found = bad if found is None else found.unionByName(bad)
        return found


def program_app(
    name: str,
    normalize: Callable[[DataFrame], DataFrame],
    rules: Mapping[str, Rules],
    folds: Sequence[Mapping[str, Program]] = (),
    own: Mapping[str, Program] | None = None,
    revision: str = "1",
    max_changes: int = MAX_CHANGES,
) -> App:
    """An app whose normalizer gives ``events`` (see ``record_view.finish_many``).

    Every program keeps ``position`` and, for folds, ``ordinal`` of the rows it reads.
    """
    programs = Programs(rules, own or {}, folds, max_changes)
    return App(
        name,
        normalize,
        lambda events, prior: {},
        {table: rule.keys for table, rule in rules.items()},
        revision=revision,
        apply=programs.tables,
        violations=programs.violations,
        rules={table: repr(rule) for table, rule in rules.items()},
    )
