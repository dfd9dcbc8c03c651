"""License scan: rolling word k-grams vote for the diagonals of license templates.

A template is a label and a text.  Every word of a document starts one gram per gram width in
use; Spark joins the grams' hashes to the places of the templates' grams, and compares the words
of each match, so that a colliding hash votes for nothing.  A match of document word w and
template word t lies on the diagonal w - t: a whole copy of a template puts all its grams on
one diagonal, a word more or less moves the rest to the next ones.  Votes are added up per
diagonal, diagonals not more than ``DRIFT`` apart are merged, and a merged span counts where
distinct template grams reach the template's share.

Two kinds of templates: phrases, whose every word must stand consecutively (all grams on one
diagonal), and license texts, of which ``SHARE`` must stand near one diagonal.

Documents are read once and not shuffled; only matches are, with one row per document.  The
templates are broadcast within ``MAX_TEMPLATE_GRAMS``; larger sets of them are joined by a
shuffle.  What a group gathers is bounded by a template's length, whatever a document repeats.

Defined cases: null and empty texts have no words and no labels; repeated rows give their result
each; a null id is kept; empty or one-word templates match nothing; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

#: Words of a gram; shorter templates are one gram.
WIDTH = 5
#: Neighbouring diagonals: so many words may be put in or left out at one place.
DRIFT = 4
#: Share of a license text's grams that makes it a find.
SHARE = 0.6
MAX_TEMPLATE_GRAMS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


# The phrases of the base labels.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

# Notices and opening passages of public licenses, in their own words.
LICENSES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
             "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
             "published by the Free Software Foundation"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
             "that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters and digits, with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAP), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(width, gram, template, label, phrase, at, grams): every gram of every template."""
    rows = [(k, t.label, t.phrase, t.text) for k, t in enumerate(templates)]
    held = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string").select(
        "template", "label", "phrase", words_of(F.col("text")).alias("words")
    )
    held = held.where(F.size("words") > 1).withColumn("width", F.least(F.lit(WIDTH), F.size("words")))
    held = held.withColumn("grams", F.size("words") - F.col("width") + 1)
    at = F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("at")
    held = held.select("template", "label", "phrase", "width", "grams", "words", at)
    gram = F.array_join(F.slice("words", F.col("at") + 1, F.col("width")), " ")
    return held.select("template", "label", "phrase", "width", "grams", "at", gram.alias("gram"))


def _hash(width: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(width), *words)


def matches(docs: DataFrame, templates: tuple[Template, ...], id_col: str, text_col: str) -> DataFrame:
    """One row per matching gram, (id, key, n_words, place, template, label, phrase, grams, width, at),
    and one per document with place -1 and no template.

    Rows are known by id and a hash of the text: equal rows share theirs.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    widths = [r[0] for r in grams.select("width").distinct().collect()]  # WIDTH - 1 numbers at most
    count = grams.count()
    parts = F.split("gram", " ")
    by_width = F.lit(None).cast("bigint")
    for width in widths:
        by_width = F.when(F.col("width") == width, _hash(width, [parts[k] for k in range(width)])).otherwise(by_width)
    grams = grams.withColumn("hash", by_width)
    if count <= MAX_TEMPLATE_GRAMS:
        grams = F.broadcast(grams)
    text = text_of(text_col)
    frame = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), words_of(text).alias("words"))
    # Place -1 stands for the document itself.
    frame = frame.select("id", "key", "words", F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("place", "word"))
    frame = frame.select("id", "key", "words", (F.col("place") - 1).alias("place"))
    word = lambda k: F.get("words", F.col("place") + k)
    tried = [F.struct(F.lit(w).alias("w"), _hash(w, [word(k) for k in range(w)]).alias("h")) for w in widths]
    alone = F.array(F.struct(F.lit(0).alias("w"), F.lit(None).cast("bigint").alias("h")))
    tried = F.when(F.col("place") < 0, alone).otherwise(F.array(*tried)) if tried else alone
    frame = frame.select("id", "key", "words", "place", F.inline(tried))
    # The words are compared after the join, for matches only: as part of the key they would be
    # put together for every place.
    equal = F.array_join(F.slice("words", F.greatest(F.col("place") + 1, F.lit(1)), F.col("w")), " ") == F.col("gram")
    held = frame.join(grams, F.col("h") == F.col("hash"), "left")
    held = held.where((F.col("place") < 0) | F.col("template").isNotNull() & equal)
    return held.select("id", "key", F.size("words").cast("bigint").alias("n_words"), "place", "template", "label", "phrase", "grams", "width", "at")


def spans(found: DataFrame) -> DataFrame:
    """Merged spans: (id, key, n_words, copies, template, label, phrase, first, last, share).

    Rows without a template carry the documents and how often each row is there.
    """
    row = ["id", "key", "n_words"]
    whose = ["template", "label", "phrase", "grams", "width"]
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    votes = found.groupBy(*row, *whose, diagonal).agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("ats"), F.count(F.lit(1)).alias("copies")
    )
    along = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    near = F.when(F.col("phrase"), F.lit(0)).otherwise(F.lit(DRIFT))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > near, F.lit(True))
    isles = votes.withColumn("isle", F.sum(apart.cast("long")).over(along))
    # A chain of diagonals can be long, what it covers cannot: one row per covered place.
    covered = isles.withColumn("at", F.explode_outer("ats")).groupBy(*row, *whose, "isle").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count_distinct("at").alias("held"), F.max("copies").alias("copies")
    )
    return covered.select(
        *row, "copies", "template", "label", "phrase", "first", (F.col("last") + F.col("width") - 1).alias("last"),
        (F.col("held") / F.col("grams")).alias("share"),
    )


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + LICENSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verified spans of all documents: (id, label, phrase, first, last, share), in words from 0."""
    held = spans(matches(docs, templates, id_col, text_col)).where("template IS NOT NULL").where(_verified())
    return held.select(F.col("id").alias(id_col), "label", "phrase", "first", "last", "share")


def _verified() -> Column:
    return F.when(F.col("phrase"), F.col("share") >= 1.0).otherwise(F.col("share") >= SHARE)


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + LICENSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document.

    Base columns tell of the phrases; ``labels`` of all verified spans; ``score`` is the largest
    share of a template near one diagonal, found or not.
    """
    held = spans(matches(docs, templates, id_col, text_col))
    verified = _verified()
    base = F.col("phrase") & verified
    labels = lambda told: F.array_join(F.array_sort(F.collect_set(F.when(told, F.col("label")))), ",")
    told = held.groupBy("id", "key", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(verified).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    told = told.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return told.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score"
    )


def oracle(templates: tuple[Template, ...] = PHRASES + LICENSES) -> str:
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{gap}')"
    rows = ", ".join("({}, '{}', {}, '{}')".format(k, t.label, t.phrase, t.text.replace("'", "''")) for k, t in enumerate(templates))
    return rf"""
WITH tw AS (SELECT template, label, phrase, {words("text")} AS ws FROM (VALUES {rows}) v(template, label, phrase, text)),
tl AS (SELECT *, least({WIDTH}, len(ws)) AS width, len(ws) - least({WIDTH}, len(ws)) + 1 AS grams FROM tw WHERE len(ws) > 1),
tg AS MATERIALIZED (SELECT template, label, phrase, width, grams, tat, array_to_string(ws[tat + 1:tat + width], ' ') AS gram
    FROM (SELECT *, unnest(range(grams)) AS tat FROM tl)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS ws FROM documents),
dg AS (SELECT r, place, width, array_to_string(ws[place + 1:place + width], ' ') AS gram FROM
    (SELECT r, ws, width, unnest(range(len(ws) - width + 1)) AS place FROM d, (SELECT DISTINCT width FROM tg) WHERE len(ws) >= width)),
hit AS MATERIALIZED (SELECT r, place, tat, place - tat AS diagonal, template, label, phrase, width, grams FROM dg JOIN tg USING (width, gram)),
dia AS (SELECT DISTINCT r, template, phrase, diagonal FROM hit),
isle AS (SELECT r, template, diagonal, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS isle FROM
    (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= CASE WHEN phrase THEN 0 ELSE {DRIFT} END THEN 0 ELSE 1 END AS apart FROM dia)),
span AS (SELECT r, label, phrase, min(place) AS first, count(DISTINCT tat) / grams::DOUBLE AS share
    FROM hit JOIN isle USING (r, template, diagonal) GROUP BY r, template, label, phrase, grams, isle),
v AS (SELECT *, share >= CASE WHEN phrase THEN 1.0 ELSE {SHARE} END AS told FROM span),
s AS (SELECT r, count(*) FILTER (told AND phrase) AS n_base, min(first) FILTER (told AND phrase) AS f, max(first) FILTER (told AND phrase) AS l,
    array_to_string(list_sort(list_distinct(list(label) FILTER (told AND phrase))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label) FILTER (told))), ',') AS labels, max(share) AS score FROM v GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN s ON s.r = d.r
"""
