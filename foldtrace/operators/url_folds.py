"""URL ledger tables: observations, exclusions, verdicts and per-day counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .folds import Count, CountIf, First, Fold, Last, LastPosition, LastWhere, latest_rows

C = F.col


def url_observations(keep_prior_on_null: bool = False) -> Fold:
    """Latest context per URL.

    An empty text never replaces a kept value.  A null does, unless
    ``keep_prior_on_null`` asks for the stricter reading.
    """

    def latest(name: str, source: str) -> LastWhere:
        usable = F.coalesce(C(source) != "", F.lit(not keep_prior_on_null))
        return LastWhere(name, C(source), usable)

    time = C("event_time_unix_nano")
    return Fold(
        "url_observations",
        ("observed_full",),
        (
            Last("host", C("host")),
            First("first_observed_unix_nano", time),
            Last("last_observed_unix_nano", time),
            Count("observation_count"),
            latest("latest_harness", "harness"),
            latest("latest_session_id", "session_id"),
            latest("latest_session_id_prefix", "session_id_prefix"),
            latest("latest_tool_name", "tool_name"),
            latest("latest_project", "project"),
            LastPosition("last_source_position", C("source_position")),
        ),
        where=C("event_family") == "observation",
    )


def url_family_counts() -> Fold:
    """Records per UTC day and family."""
    time = C("event_time_unix_nano")
    return Fold(
        "url_pipeline_counts",
        ("day_utc", "event_family"),
        (
            Count("record_count"),
            CountIf("error_count", (C("event_family") == "reputation") & (C("verdict") == "error")),
            First("first_event_time_unix_nano", time),
            Last("last_event_time_unix_nano", time),
            LastPosition("last_source_position", C("source_position")),
        ),
    )


def url_verdicts(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Latest verdict per URL and provider."""
    rows = events.where(C("event_family") == "reputation").select(
        "observed_full",
        "provider",
        "checked_full",
        "verdict",
        "threat_types",
        "provider_reference",
        "error",
        "checked_unix_nano",
        "valid_until_unix_nano",
        C("source_position").alias("last_source_position"),
    )
    return latest_rows(rows, ["observed_full", "provider"], C("last_source_position"), prior)


def url_exclusions(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Latest operator rule per id, with the built-in rules seeded once.

    Seeds carry the time and position of the app's first effective event and rank before
    every operator event, so an operator rule of the same id replaces them.
    """
    first = events.agg(
        F.min_by("event_time_unix_nano", "source_position").alias("updated_unix_nano"),
        F.min("source_position").alias("last_source_position"),
    ).where(C("last_source_position").isNotNull())
    seeds = first.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(exclusion_id).alias("exclusion_id"),
                        F.lit(kind).alias("kind"),
                        F.lit(pattern).alias("pattern"),
                        F.lit(1).alias("enabled"),
                    )
                    for exclusion_id, kind, pattern in V.BUILTIN_EXCLUSIONS
                ]
            )
        ),
        "updated_unix_nano",
        "last_source_position",
    )
    operator = events.where(C("event_family") == "exclusion").select(
        "exclusion_id",
        C("exclusion_kind").alias("kind"),
        C("exclusion_pattern").alias("pattern"),
        C("exclusion_enabled").alias("enabled"),
        C("event_time_unix_nano").alias("updated_unix_nano"),
        C("source_position").alias("last_source_position"),
    )
    rank = F.struct(C("_operator").alias("r"), C("last_source_position").alias("p"))
    tagged = seeds.withColumn("_operator", F.lit(0)).unionByName(operator.withColumn("_operator", F.lit(1)))
    if prior is not None:
        # Once stored, a seed outranks later seeds but not operator rules.
        stored = prior.withColumn("_operator", F.lit(1)).withColumn("_stored", F.lit(0))
        tagged = tagged.withColumn("_stored", F.lit(1)).unionByName(stored)
        rank = F.struct(C("_operator").alias("r"), C("_stored").alias("s"), C("last_source_position").alias("p"))
        return latest_rows(tagged, ["exclusion_id"], rank).drop("_operator", "_stored")
    return latest_rows(tagged, ["exclusion_id"], rank).drop("_operator")
