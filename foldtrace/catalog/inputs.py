"""Frames the registered queries start from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..plans import apps
from ..session import tune
from ..sources import tables


def event_records(spark: SparkSession, directory: str) -> DataFrame:
    tune(spark)
    return tables.events_as_records(tables.spread(tables.read_table(spark, directory, "events")))


def page_records(spark: SparkSession, directory: str) -> DataFrame:
    tune(spark)
    return tables.pages_as_url_records(tables.spread(tables.read_table(spark, directory, "pages")))


def conversation_records(spark: SparkSession, directory: str) -> DataFrame:
    tune(spark)
    return tables.conversations_as_records(tables.spread(tables.read_table(spark, directory, "conversations")))


def events_of(spark: SparkSession, directory: str, app: str) -> DataFrame:
    """Accepted events of an app over the event or page records."""
    tune(spark)
    chosen = apps.SHIPPED[app]()
    records = page_records if app == "url-reputation" else event_records
    return chosen.events(records(spark, directory))


class TableSource(Mapping):
    """Tables of an app by name, each planned only when asked for."""

    def __init__(self, spark: SparkSession, directory: str, app: str) -> None:
        tune(spark)
        self._app = apps.SHIPPED[app]()
        records = page_records if app == "url-reputation" else event_records
        self._records = records(spark, directory)

    def __getitem__(self, name: str) -> DataFrame:
        return self._app.tables(self._records, name)[name]

    def __iter__(self):
        return iter(self._app.keys)

    def __len__(self) -> int:
        return len(self._app.keys)


def tables_of(spark: SparkSession, directory: str, app: str) -> TableSource:
    return TableSource(spark, directory, app)
