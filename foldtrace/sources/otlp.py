"""OTLP/JSON requests as canonical records.

A request stays one row until it is admitted: ``otlp_json`` walks it once and gives either the
reason why it is refused or its canonical records, and only then is the row expanded.  Atomic
admission therefore needs no shuffle.  Names, sources, times, positions and digests of records
are columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .otlp_json import REQUESTS, Limits, canonical_texts

C = F.col

MAX_REQUEST_BYTES = Limits().request_bytes
# Resource attributes that name the source, in order.
SOURCE_KEYS = ("service.name", "gen_ai.agent.name", "telemetry.sdk.name")


def stream_requests(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """The same as a stream of arriving files; lines are numbered inside each micro-batch."""
    return spark.readStream.text(path).select(
        C("_metadata.file_path").alias("request_block"), F.lit(signal).alias("signal"), C("value").alias("body")
    )


def numbered(requests: DataFrame) -> DataFrame:
    """Requests with ``request_line``, by their order in the input splits when they have none."""
    if "request_line" in requests.columns:
        return requests
    return requests.withColumn("request_line", F.monotonically_increasing_id())


def read_requests(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """One request per line of text files; gzip is read as it is.

    Arrival order is (file, block, line); a file block is the unit positions are
    counted in, so no global sort is needed.
    """
    lines = spark.read.text(path)
    return lines.select(
        F.concat_ws("@", C("_metadata.file_path"), F.lpad(C("_metadata.file_block_start").cast("string"), 15, "0")).alias(
            "request_block"
        ),
        F.monotonically_increasing_id().alias("request_line"),
        F.lit(signal).alias("signal"),
        C("value").alias("body"),
    )


def _decoder(layout: pa.Schema, limits: Limits):
    def decode(batches):
        for batch in batches:
            # A request can give many times its bytes, so it is read when its turn comes and results leave in small pieces.
            signals, bodies = batch.column("signal"), batch.column("body")
            start, held, piece = 0, 0, []
            for k in range(batch.num_rows):
                piece.append(canonical_texts(signals[k].as_py(), bodies[k].as_py(), limits))
                held += sum(map(len, piece[-1][1] or ()))
                if held > PIECE_CHARS or k + 1 == batch.num_rows:
                    columns = [batch.column(name)[start : k + 1] for name in layout.names[:-2]]
                    columns += [pa.array([d[1] for d in piece], layout.field("records").type), pa.array([d[0] for d in piece], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, schema=layout)
                    start, held, piece = k + 1, 0, []

    return decode


PIECE_CHARS = 8 << 20


def canonicalize(requests: DataFrame, signals: tuple[str, ...] = tuple(REQUESTS), limits: Limits = Limits()) -> DataFrame:
    """Requests with their canonical ``records`` (JSON texts with sorted keys) and the reason they
    are refused, if any.

    Requests of other signals than ``signals`` are refused as malformed.  A request is refused
    whole: unknown or repeated fields, values of a wrong type or out of range, empty or repeated
    attribute keys at any depth, string-table references, non-finite attribute values, metrics
    without points, and more than ``limits`` allows.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("records", T.ArrayType(T.StringType())), T.StructField("rejected", T.StringType())])
    taken = requests.withColumn("signal", F.when(C("signal").isin(*signals), C("signal")).otherwise(F.concat(F.lit("other: "), "signal")))
    decoded = taken.mapInArrow(_decoder(to_arrow_schema(schema), limits), schema)
    return decoded.withColumn("signal", F.regexp_replace("signal", "^other: ", ""))


def _member(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get("record", path, kind)


def _text_of(attributes: str, key: str) -> Column:
    """A key's value when it is a text that is not empty."""
    item = F.try_variant_get(attributes, f'$["{key}"]', "variant")
    return F.when(F.schema_of_variant(item) == "STRING", F.nullif(item.cast("string"), F.lit("")))


def source_name(attributes: str = "resource_attributes") -> Column:
    """First non-empty text among the naming attributes."""
    return F.coalesce(*[_text_of(attributes, key) for key in SOURCE_KEYS], F.lit("unknown"))


def _id(field: str) -> Column:
    return F.nullif(F.lower(F.hex(F.unbase64(_member(f"$.otel.{field}", "string")))), F.lit(""))


def admitted(canonical: DataFrame, order: tuple[str, ...] = ("request_block", "request_line")) -> DataFrame:
    """Records of the accepted requests, in request order with their ordinal."""
    texts = canonical.where(C("rejected").isNull()).select(*order, "signal", F.posexplode("records").alias("ordinal", "_json"))
    records = texts.select(*order, "ordinal", "signal", "_json", F.parse_json("_json").alias("record"))
    records = records.withColumns({"attributes": _member("$.attributes"), "resource_attributes": _member("$.resource.attributes")})
    by_signal = lambda **of: F.coalesce(*[F.when(C("signal") == name, column) for name, column in of.items()])
    log_name = F.coalesce(_member("$.otel.event_name", "string"), _text_of("attributes", "event.name"))
    name = by_signal(log=log_name, span=_member("$.otel.name", "string"), metric=_member("$.metric.name", "string"))
    time = by_signal(
        log=_member("$.otel.time_unix_nano", "string"), span=_member("$.start_time_unix_nano", "string"), metric=_member("$.time_unix_nano", "string")
    )
    return records.select(
        *order,
        "ordinal",
        "signal",
        F.coalesce(name, F.lit("")).alias("name"),
        source_name().alias("source"),
        time.alias("time_unix_nano"),
        by_signal(log=_member("$.otel.observed_time_unix_nano", "string")).alias("observed_unix_nano"),
        by_signal(log=_id("trace_id"), span=_id("trace_id")).alias("trace_id"),
        by_signal(log=_id("span_id"), span=_id("span_id")).alias("span_id"),
        _member("$.body").alias("body"),
        "attributes",
        "resource_attributes",
        "record",
        F.concat(F.lit("sha256:"), F.sha2("_json", 256)).alias("content_digest"),
        F.octet_length("_json").cast("bigint").alias("canonical_bytes"),
    )


def rejected(canonical: DataFrame) -> DataFrame:
    """The refused requests, whole, with the reason."""
    return canonical.where(C("rejected").isNotNull()).drop("records")


def no_records(spark: SparkSession) -> DataFrame:
    """No canonical records, in their schema: what apps are planned over."""
    requests = spark.createDataFrame([], "request_block string, request_line long, signal string, body string")
    return positioned_records(canonicalize(requests)).where(F.lit(False))


def assign_positions(
    canonical: DataFrame, base: int = 0, block: str = "request_block", line: str = "request_line"
) -> DataFrame:
    """First position of every request: contiguous, in (block, line) order, after ``base``.

    Counts run inside a block and over the block totals, so no task ever orders more
    than one block of requests or the list of blocks.  The totals are the last running counts,
    so that both come from one exchange.
    """
    size = F.when(C("rejected").isNull(), F.size("records")).otherwise(0).cast("bigint")
    inside = Window.partitionBy(block).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    counted = canonical.select(block, line, size.alias("_n")).withColumn("_upto", F.sum("_n").over(inside))
    over_blocks = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(block).agg(F.max("_upto").alias("_total"))
    starts = totals.select(block, (F.coalesce(F.sum("_total").over(over_blocks), F.lit(0)) + base).alias("_start"))
    first = (C("_start") + C("_upto") - C("_n") + 1).alias("first_position")
    return counted.join(starts, block).select(block, line, first)


def positioned_records(
    canonical: DataFrame, base: int = 0, block: str = "request_block", line: str = "request_line"
) -> DataFrame:
    """Canonical records with contiguous positions and event ids."""
    records = admitted(canonical, (block, line))
    starts = assign_positions(canonical, base, block, line)
    position = C("first_position") + C("ordinal")
    return (
        records.join(starts, [block, line])
        .withColumns({"position": position, "event_id": F.concat(F.lit("local:"), position.cast("string"))})
        .drop("first_position", block, line)
    )
