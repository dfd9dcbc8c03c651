"""Token and cost usage, shared by the cost and activity apps, and the cost normalizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.values import Attributes, Value, counter, round_half_even
from .record_view import RecordView, coverage, covered_text, finish, number_problems

MICRO = 0.000001


class Usage:
    """Counters of one record with their alias precedence."""

    def __init__(self, attrs: Attributes) -> None:
        self.values: dict[str, Value] = {
            "input_tokens": attrs.first_existing(V.INPUT_KEYS),
            "output_tokens": attrs.first_existing(V.OUTPUT_KEYS),
            "cached_input_tokens": attrs.first_existing(V.CACHED_KEYS),
            "reasoning_output_tokens": attrs.first_existing(V.REASONING_KEYS),
        }
        self.cost = attrs.first_existing(V.COST_KEYS)
        self.cost_usd = attrs[V.COST_USD_KEY]

    def cost_microusd(self, usd_allowed: Column) -> Column:
        """Reported micro-dollars, else dollars scaled and rounded where they are allowed."""
        if self.cost_usd.is_absent:
            return counter(self.cost)
        scaled = round_half_even(self.cost_usd.number / F.lit(MICRO))
        usd = F.when(usd_allowed & self.cost_usd.exists, scaled)
        if self.cost.is_absent:
            return F.coalesce(usd, F.lit(0.0))
        return F.when(self.cost.exists, counter(self.cost).cast("double")).otherwise(
            F.coalesce(usd, F.lit(0.0))
        )

    def cost_problems(self, usd_allowed: Column) -> list:
        return number_problems({"cost_microusd": self.cost}) + number_problems(
            {"cost_usd": self.cost_usd}, ~self.cost.exists & usd_allowed
        )


def normalize(records: DataFrame) -> DataFrame:
    view = RecordView(records, [*V.COUNTER_KEYS, *V.MODEL_KEYS, *V.PROJECT_KEYS])
    attrs = view.attrs
    usage = Usage(attrs)
    opencode_log = (F.col("harness") == "opencode") & (F.col("signal") == "log")
    stream = (view.name == V.USAGE_STREAM_EVENT) & attrs.any_present(V.STREAM_COUNTER_KEYS)
    effective = (view.is_api_request | stream) & attrs.any_present(V.COUNTER_KEYS) & view.has_time
    model = attrs.first_existing(V.MODEL_KEYS)
    project = attrs.first_existing(V.PROJECT_KEYS)
    counters = {name: counter(value) for name, value in usage.values.items()}
    counters["cost_microusd"] = usage.cost_microusd(opencode_log)
    return finish(
        view.frame,
        effective,
        number_problems(usage.values) + usage.cost_problems(opencode_log),
        {
            "harness": F.col("harness"),
            "session_id": F.col("session_id"),
            "session_id_prefix": F.substring("session_id", 1, V.SESSION_PREFIX_CHARS),
            "model": covered_text(model),
            "project": covered_text(project),
            "model_coverage": coverage(model.filled),
            "project_coverage": coverage(project.filled),
            **counters,
            "event_time_unix_nano": F.col("_time"),
            "source_position": F.col("position"),
        },
        integers=list(counters),
    )
