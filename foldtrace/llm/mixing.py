"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  A document's expected copies are the ratio of
target to source size; the whole part is certain, and the rest is its inclusion probability.
Documents are ranked by random odds divided by inclusion odds, and the smallest ranks are
taken until the source's remaining words are reached: a fixed-size sample of unequal
inclusion probabilities.  Random numbers are digests of seed and id, so reruns agree.

No source is ordered in one task: a source's ranks are counted in cells of a monotone scale,
only the cell in which the remaining words run out is ordered, and its last chosen rank
becomes the cut-off that every document is compared with.

Defined cases: null text has size 0; a null source is a source of its own, ordered last;
documents of size 0 and sources of size 0 take 0 words; repeated rows (same id) have the same
rank and are taken or left together; an empty table gives an empty result; extra columns are
ignored (``mix``) or kept (``mixed_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_of, words_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = "mix-1"
#: Documents of one source that are ordered in one task, about.
CELL_ROWS = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Target words per source from (source, source_size, source_rows).

    Sources in code point order, null last, take the weights in turn.  Targets stop at
    ``max_copies`` times the size; the excess is shared by weight.  With sources in order of
    cap by weight, the common level is the highest quotient of what is left.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * max_copies)
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = weighted.withColumn("level", left.cast("double") / open_weight)
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select(
        "source", "source_size", "source_rows",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"),
    )


def _random(key: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with size and rank parts, sources with target and cut-off)."""
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(text_of(text_col))).cast("bigint").alias("size")
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = targets(per_source, weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("copies", ratio).select(
        "*",
        F.floor("copies").alias("certain"),
        (F.col("copies") - F.floor("copies")).alias("chance"),
        (F.col("target") - F.floor("copies") * F.col("source_size")).alias("rest"),
        F.ceil(F.col("source_rows") / CELL_ROWS).alias("cells"),
    )
    ranked = _ranked(sized, sources, seed)
    # Words per cell, then the cell of each source in which the rest runs out.
    cell_sums = ranked.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    along = Window.partitionBy("source").orderBy("cell")
    cells = cell_sums.withColumn("after", F.sum("words").over(along))
    crossing = (
        cells.where(F.col("after") >= F.col("rest"))
        .groupBy("source")
        .agg(F.min_by(F.struct("cell", (F.col("after") - F.col("words")).alias("before")), "cell").alias("x"))
        .select(F.col("source").alias("cut_source"), F.col("x.cell").alias("cut_cell"), F.col("x.before").alias("before"))
    )
    inside = ranked.join(crossing, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("cell") == F.col("cut_cell")))
    order = Window.partitionBy("source").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("before") + F.sum("size").over(order)
    taken = inside.withColumn("reached", reached).where(2 * F.col("reached") - F.col("size") <= 2 * F.col("rest"))
    cuts = taken.groupBy("source").agg(F.max(F.struct("rank", "id")).alias("last"))
    cuts = crossing.join(cuts.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("cut_source")), "left").drop("s")
    cut_sources = sources.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "before")
    return sized, cut_sources


def _ranked(sized: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """Documents that may get one more copy, with Pareto rank and cell."""
    given = sources.where("chance > 0").select(F.col("source").alias("g"), "chance", "rest", "cells")
    joined = sized.join(given, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    return _with_rank(joined, seed)


def _with_rank(frame: DataFrame, seed: str) -> DataFrame:
    """rank = random odds / inclusion odds; the cell is the same order on an even scale."""
    u, p = F.col("u"), F.col("chance")
    odds = F.when(p > 0, p / (1 - p))  # without a chance there is no rank
    ranked = frame.withColumn("u", _random(F.col("id"), seed)).withColumn("rank", (u / (1 - u)) / odds)
    back = F.col("rank") * odds
    return ranked.withColumn("cell", F.floor(back / (1 + back) * F.col("cells")))


def _taken(frame: DataFrame, seed: str) -> DataFrame:
    """Adds ``copies_taken`` to documents joined with their source's row."""
    ranked = _with_rank(frame, seed)
    more = (F.col("chance") > 0) & (
        F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell"))
        | ((F.col("cell") == F.col("cut_cell")) & F.col("last").isNotNull() & (F.struct("rank", "id") <= F.col("last")))
    )
    return ranked.withColumn("copies_taken", F.col("certain") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """Size, source size, target, taken words and copies of every document."""
    sized, sources = plan(docs, id_col, text_col, source_col, weights, max_copies, seed)
    given = sources.drop("source_rows", "copies").withColumnRenamed("source", "g")
    joined = _taken(sized.join(given, F.col("source").eqNullSafe(F.col("g"))), seed)
    return joined.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("copies_taken") * F.col("size")).cast("bigint").alias("taken"), F.col("copies_taken").cast("bigint").alias("copies"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves: a row per taken copy, with a copy number."""
    _, sources = plan(docs, id_col, text_col, source_col, weights, max_copies, seed)
    given = sources.select(F.col("source").alias("g"), "certain", "chance", "cells", "cut_cell", "last")
    whole = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source")
    )
    joined = _taken(whole.join(given, F.col("source").eqNullSafe(F.col("g"))), seed)
    copy = fresh(docs, "copy")
    return joined.where("copies_taken > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies_taken").cast("int"))).alias("n")
    ).select("row.*", F.col("n").cast("bigint").alias(copy))


def oracle() -> str:
    weights = ", ".join(f"{w:.1f}::DOUBLE" for w in WEIGHTS)
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{weights}][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)}] AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum({MAX_COPIES} * source_size) OVER e, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0))) AS level FROM w
      WINDOW e AS (ORDER BY ({MAX_COPIES} * source_size)::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(({MAX_COPIES} * source_size)::DOUBLE, weight * (max(level) OVER ())) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM t),
q AS (SELECT *, floor(copies) AS certain, copies - floor(copies) AS chance, target - floor(copies) * source_size AS rest FROM r),
u AS (SELECT d.doc_id, d.size, q.*, (('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5)::DOUBLE / {2**52}::DOUBLE AS u
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
o AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM u),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS reached FROM o)
SELECT doc_id, size, source_size, target,
    (size * (certain + CASE WHEN chance > 0 AND 2 * reached - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken,
    (certain + CASE WHEN chance > 0 AND 2 * reached - size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c
"""
