"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that ends a word (space, tab to carriage return).
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array, by a native split."""
    return F.array_remove(F.split(text, WHITE_SPACE), "")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name the frame does not have yet."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; a local session that has only called
    ``setCheckpointDir`` is read back from the context.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local["):
            base = spark.conf.get("spark.sql.warehouse.dir") + "/shared"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage durably."""
    path = shared_path(frame.sparkSession, label)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_bytes(frame: DataFrame, column: str = "text") -> tuple[int, int]:
    """Total bytes and rows of a text column: one aggregate row."""
    row = frame.agg(F.sum(F.octet_length(F.col(column).cast("string"))), F.count(F.lit(1))).first()
    return int(row[0] or 0), int(row[1])
