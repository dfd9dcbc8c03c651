"""Versioned Parquet tables published through one pointer file.

A batch writes new directories, then replaces the pointer in one rename.  The pointer
names the files of every table and holds each app's frontier and counters, so readers
always see tables and frontier of the same batch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

EMPTY: dict = {"version": 0, "batches": {}, "head": 0, "apps": {}, "intake": {}, "unrouted": 0}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._pointer = f"{self.root}/current.json"

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _context(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        return hadoop.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def read(self) -> dict:
        """State of the published version."""
        fs = self._path(self._pointer).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._path(self._pointer)):
            return json.loads(json.dumps(EMPTY))
        stream = fs.open(self._path(self._pointer))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def publish(self, state: dict) -> None:
        """Make a version current; the rename is the commit."""
        fs = self._path(self._pointer).getFileSystem(self.spark._jsc.hadoopConfiguration())
        staged = self._path(f"{self.root}/next-{state['version']}.json")
        out = fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        self._context().rename(staged, self._path(self._pointer), options)

    def write(self, frame: DataFrame, version: int, app: str, table: str) -> str:
        """Write one table of a version; a retry of the version replaces it."""
        directory = f"v={version}/{app}/{table}"
        frame.write.mode("overwrite").parquet(f"{self.root}/{directory}")
        return directory

    def table(self, state: dict, app: str, table: str) -> DataFrame | None:
        directories = state["apps"].get(app, {}).get("tables", {}).get(table)
        if not directories:
            return None
        return self.spark.read.parquet(*[f"{self.root}/{directory}" for directory in directories])

    def tables(self, state: dict, app: str) -> dict[str, DataFrame]:
        names = state["apps"].get(app, {}).get("tables", {})
        return {name: self.table(state, app, name) for name in names}
