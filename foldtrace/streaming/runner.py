"""Apps over a stream: every micro-batch is one atomic publish."""

from __future__ import annotations

import json
import threading
from collections.abc import Sequence
from urllib.parse import quote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.apps import App
from ..session import tune
from ..sources import otlp
from .lifecycle import REASON_CHARS, Frontier, advance, ineffective_sample, intake, same_shape, shape_change
from .store import Store


class Runner:
    """Folds batches of canonical records into the tables of a store."""

    def __init__(self, spark: SparkSession, root: str, apps: Sequence[App]) -> None:
        self.spark, self.store, self.apps = tune(spark), Store(spark, root), list(apps)
        self._publishing = threading.Lock()

    def install(self, app: App, continue_tables: bool = False, records: DataFrame | None = None) -> None:
        """Start an app at the current head, its tables empty until records arrive.

        Tables are planned over no records (canonical ones, or of the schema of ``records``), so an
        app that cannot be planned is refused here.  ``continue_tables`` keeps what is stored: each
        stored table must keep its columns, keys and rules, or the app is refused and nothing
        changes; tables that are new start empty.
        """
        state = self.store.read()
        planned = app.planned(otlp.no_records(self.spark) if records is None else records)
        entry = state["apps"].get(app.name)
        if entry is None or not continue_tables:
            entry = state["apps"][app.name] = self._entry(app, state["head"])
        else:
            changed = shape_change(app, entry, planned)
            if changed is not None:
                raise ValueError(changed)
            entry["revision"], entry["shape"] = app.revision, app.shape()
        state["version"] += 1
        for name, frame in planned.items():
            if name not in entry["tables"]:
                entry["tables"][name] = [self.store.write(frame, state["version"], app.name, name)]
                entry["schemas"][name] = frame.schema.json()
        self.store.publish(state)

    def process_records(self, records: DataFrame, batch: int, stream: str = "records") -> None:
        """Apply a batch of positioned records once; a repeated batch changes nothing.

        Batches are numbered per ``stream``: several streams feed one store, and each one's
        last batch is kept.  Their records share one sequence of positions.
        """
        state = self.store.read()
        if batch <= state["batches"].get(stream, -1):
            return
        version = state["version"] + 1
        records = records.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            arrived = intake(records).collect()  # a row per signal, and what fills the cache
            for row in arrived:
                total = state["intake"].setdefault(row.signal, {"records": 0, "bytes": 0})
                total["records"] += row.records
                total["bytes"] += row.bytes
            if not self.apps:
                state["unrouted"] += sum(row.records for row in arrived)
            for app in self.apps:
                self._apply_alone(app, records, state, version)
            state["head"] = max([state["head"], *[row.last_position for row in arrived]])
            state["version"], state["batches"][stream] = version, batch
            self.store.publish(state)
        finally:
            records.unpersist()

    def _apply_alone(self, app: App, records: DataFrame, state: dict, version: int) -> None:
        """Apply one app; what it cannot take becomes its gap and does not stop the others.

        Only errors of the app's own rules count (``ValueError``, unresolved columns); a failed
        job still fails the batch, which is then repeated as a whole.
        """
        before = json.dumps(state["apps"].get(app.name))
        try:
            self._apply(app, records, state, version)
        except (ValueError, AnalysisException) as error:
            entry = json.loads(before) or self._entry(app)
            frontier = Frontier.of(entry["frontier"])
            if frontier.gap_position is None:
                frontier.complete = False
                frontier.gap_position = max(frontier.position, frontier.boundary) + 1
                frontier.gap_reason = str(error)[:REASON_CHARS]
            frontier.detached += records.where(F.col("position") > max(frontier.position, frontier.boundary)).count()
            entry["frontier"] = frontier.as_dict()
            state["apps"][app.name] = entry

    @staticmethod
    def _entry(app: App, boundary: int = 0) -> dict:
        """State of an app that starts after a position."""
        frontier = Frontier(boundary=boundary, position=boundary).as_dict()
        return {"frontier": frontier, "tables": {}, "schemas": {}, "shape": app.shape(), "revision": app.revision, "sample": []}

    def _apply(self, app: App, records: DataFrame, state: dict, version: int) -> None:
        entry = state["apps"].setdefault(app.name, self._entry(app))
        prior = self.store.tables(state, app.name)
        normalized = app.normalize(records).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            frontier = Frontier.of(entry["frontier"])
            start = max(frontier.position, frontier.boundary)
            tables, frontier = advance(app, normalized, frontier, prior)
            for name, frame in tables.items():
                stored = entry["schemas"].get(name)
                if stored is not None and not same_shape(stored, frame):
                    raise ValueError(f"{app.name}.{name}: stored table has another shape; rebuild it")
                directory = self.store.write(frame, version, app.name, name)
                kept = entry["tables"].get(name, []) if name in app.append_only else []
                entry["tables"][name] = [*kept, directory]
                entry["schemas"][name] = frame.schema.json()
            seen = normalized.where((F.col("position") > start) & (F.col("position") <= frontier.position))
            latest = [row.asDict() for row in ineffective_sample(records, seen).collect()]
            entry["sample"] = (latest + entry["sample"])[:16]
            entry["frontier"] = frontier.as_dict()
        finally:
            normalized.unpersist()

    def process_requests(self, requests: DataFrame, batch: int, stream: str = "requests") -> None:
        """Canonicalise a batch of OTLP requests, position them after the head, and apply them."""
        state = self.store.read()
        if batch <= state["batches"].get(stream, -1):
            return
        canonical = otlp.canonicalize(otlp.numbered(requests)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            otlp.rejected(canonical).write.mode("overwrite").parquet(f"{self.store.root}/rejects/stream={quote(stream, safe='')}/batch={batch}")
            self.process_records(otlp.positioned_records(canonical, state["head"]), batch, stream)
        finally:
            canonical.unpersist()

    def start(self, requests: DataFrame, checkpoint: str, stream: str | None = None):
        """Streaming query over a request stream (see ``otlp.stream_requests``).

        The stream's name is its checkpoint unless given: a fresh checkpoint numbers its batches
        from 0 again and so is a stream of its own.  Batches of several queries in one driver
        are published one after the other.
        """
        name = stream or checkpoint

        def process(frame: DataFrame, batch: int) -> None:
            with self._publishing:
                self.process_requests(frame, batch, name)

        return (
            requests.writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def rebuild(self, app: App, canonical_records: DataFrame, boundary: int = 0) -> None:
        """Backfill an app's tables from retained canonical records into a new version."""
        state = self.store.read()
        version = state["version"] + 1
        state["apps"].pop(app.name, None)
        state["apps"][app.name] = self._entry(app, boundary)
        self._apply(app, canonical_records.where(F.col("position") > boundary), state, version)
        state["version"] = version
        self.store.publish(state)

    def status(self) -> DataFrame:
        """Frontier, lag and counters of every app."""
        state = self.store.read()
        rows = [
            {"app": name, "head": state["head"], "lag": state["head"] - entry["frontier"]["position"], **entry["frontier"]}
            for name, entry in state["apps"].items()
        ]
        schema = (
            "app string, head long, lag long, boundary long, position long, complete boolean, gap_position long, "
            "gap_reason string, consumed long, ineffective long, emitted long, detached long"
        )
        return self.spark.createDataFrame(rows, schema)
