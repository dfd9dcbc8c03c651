"""Substring dedup over word windows by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  A word is removed if some window
over it also starts in a document with a smaller id.

1. Anchors: shorter windows of ``WINDOW - PERIOD + 1`` words are fingerprinted only at word
   positions whose residue modulo ``PERIOD`` is in the difference cover.  For any two positions
   there is a shift below the period that brings both into the cover, so two equal windows
   share an aligned anchor.  Anchors that occur once anywhere are discarded.
2. Extension: the windows around the anchors that are left are fingerprinted whole; the first
   chunk (in id order) that holds a fingerprint keeps it, and within a chunk the first document.

Both exchanges are those of ``exchange``: one packed entry per chunk and fingerprint, so a
passage that many documents share never gathers its documents.  Whole windows are compared by
64-bit fingerprints plus the bits of an independent bucket fingerprint.

Defined cases: a null text has no words; documents with fewer words than the window keep all;
rows with the same id are copies of one document and never remove words from each other; a
null id counts as smaller than all others; an empty table gives an empty result; extra columns
are carried or ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import fingerprints as fp

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 occurs between two of them
ANCHOR = WINDOW - PERIOD + 1
#: Bits of an anchor's fingerprint that are sent; a chance repeat only costs a check.
ANCHOR_BITS = 32
#: Bytes of text per anchor and per window sent, for the number of buckets.
BYTES_PER_ANCHOR = 12
BYTES_PER_WINDOW = 20


class _Words:
    """Words of a chunk, with fingerprints; texts are hashed in blocks."""

    def __init__(self, table: pa.Table, families=(0,)):
        data, offsets = ex.text_buffer(table)
        self.texts = len(offsets) - 1
        counts, hashes = [np.zeros(0, dtype=np.int64)], [[np.zeros(0, dtype=np.uint64)] for _ in families]
        for first, last in fp.blocks(offsets, ex.BLOCK_BYTES):
            part, limits = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            starts, ends, at = fp.word_spans(part, limits)
            counts.append(np.diff(at) if len(part) else np.zeros(last - first, dtype=np.int64))
            for out, family in zip(hashes, families):
                out.append(fp.Ranges(part, family).of(starts, ends))
        self.counts = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = [np.concatenate(h) for h in hashes]
        self.total = int(self.first[-1])
        self.text_of = np.repeat(np.arange(self.texts), self.counts)
        self.left = self.first[1:][self.text_of] - np.arange(self.total)  # words to the text's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and fingerprints of the anchors."""
        place = (np.arange(self.total) - self.first[:-1][self.text_of]) % PERIOD
        at = np.flatnonzero(np.isin(place, COVER) & (self.left >= ANCHOR))
        if not len(at):
            return at, np.zeros(0, dtype=np.uint64)
        return at, fp.window_hashes(self.hashes[0], ANCHOR)[at]

    def candidates(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the whole windows that hold one of these anchors."""
        step = np.zeros(self.total + 1, dtype=np.int64)
        np.add.at(step, np.maximum(anchors - (WINDOW - ANCHOR), self.first[:-1][self.text_of[anchors]]), 1)
        np.add.at(step, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= WINDOW))


def _anchor_entries(buckets: int):
    def emit(table: pa.Table) -> pa.Table:
        _, hashes = _Words(ex.in_order(table)).anchors()
        return ex.Split(hashes, buckets, ANCHOR_BITS).entries(ex.chunk_number(table))

    return emit


def _windows(table: pa.Table, replies: dict[int, bytes], buckets: tuple[int, int]) -> tuple[_Words, np.ndarray, ex.Split]:
    words = _Words(table, (0, 1))
    at, hashes = words.anchors()
    told, _, several = ex.Split(hashes, buckets[0], ANCHOR_BITS).apply(replies)
    starts = words.candidates(at[told | several])
    if not len(starts):
        return words, starts, ex.Split(np.zeros(0, dtype=np.uint64), buckets[1])
    whole, other = (fp.window_hashes(words.hashes[k], WINDOW, k)[starts] for k in (0, 1))
    return words, starts, ex.Split(whole, buckets[1], others=other)


def _window_entries(buckets: tuple[int, int]):
    def emit(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ex.Split(np.zeros(0, dtype=np.uint64), 1).entries(0)
        _, _, split = _windows(ex.in_order(docs), ex.replies_of(replies), buckets)
        return split.entries(ex.chunk_number(docs))

    return emit


def _removed(table: pa.Table, replies: pa.Table, buckets: tuple[int, int]) -> tuple[_Words, np.ndarray]:
    """The words of a chunk and which of them are removed."""
    words, starts, split = _windows(table, ex.replies_of(replies, 1), buckets)
    told, first, _ = split.apply(ex.replies_of(replies, 2))
    # The id whose document has the window first in this chunk, per window.
    ids = table.column("id")
    rank = np.zeros(words.texts, dtype=np.int64)  # equal ids have equal rank
    if words.texts > 1:
        values, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()
        rank[1:] = np.cumsum((values[1:] != values[:-1]) | (known[1:] != known[:-1]))
    owner = rank[words.text_of[starts]] if len(starts) else np.zeros(0, dtype=np.int64)
    repeated = ~told | (owner > split.earliest(owner))
    step = np.zeros(words.total + 1, dtype=np.int64)
    gone = starts[repeated]
    np.add.at(step, gone, 1)
    np.add.at(step, gone + WINDOW, -1)
    return words, np.cumsum(step[:-1]) > 0


def _finish(buckets: tuple[int, int], carry: bool):
    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = ex.in_order(docs)
        n, texts = docs.num_rows, docs.column("text").to_pylist()
        n_words, n_removed = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        out = []
        if n:
            words, gone = _removed(docs, replies, buckets)
            n_words = words.counts
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
            for k, text in enumerate(texts):
                keep = ~gone[words.first[k] : words.first[k + 1]]
                out.append(_kept_text(text, keep) if carry else _kept_digest(text, keep))
        columns = {"id": docs.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        columns |= {"kept": pa.array(out, pa.string())}
        if carry:
            columns["row"] = docs.column("row")
        return pa.table(columns)

    return finish


def _kept_digest(text: str, keep: np.ndarray) -> str:
    words = text.encode().split()
    return hashlib.sha256(b" ".join(words if keep.all() else compress(words, keep))).hexdigest()


def _kept_text(text: str, keep: np.ndarray) -> str:
    """The text without removed words and the white space after them; else as it was."""
    if keep.all():
        return text
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, _, _ = fp.word_spans(data, np.array([0, len(data)]))
    step = np.zeros(len(data) + 1, dtype=np.int64)
    until = np.append(starts[1:], len(data))
    step[starts[~keep]] += 1
    np.add.at(step, until[~keep], -1)
    return data[np.cumsum(step[:-1]) == 0].tobytes().decode()


def _run(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    chunks, total, together = ex.ordered_chunks(docs, id_col, text_col, carry)
    buckets = ex.bucket_count(total / BYTES_PER_ANCHOR), ex.bucket_count(total / BYTES_PER_WINDOW)
    by_chunk = chunks.groupBy("chunk")
    anchors = ex.ask(by_chunk.applyInArrow(_anchor_entries(buckets[0]), ex.ENTRY_SCHEMA), "repeated")
    entries = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_window_entries(buckets), ex.ENTRY_SCHEMA)
    windows = ex.ask(entries, "first", together=together)  # rows of one id remove nothing from each other
    replies = anchors.withColumn("step", F.lit(1)).union(windows.withColumn("step", F.lit(2)))
    schema = "id long, n_words long, n_removed long, kept string"
    if carry:
        schema += f", row {chunks.schema['row'].dataType.simpleString()}"
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_finish(buckets, carry), schema)


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per document."""
    return _run(docs, id_col, text_col, False).select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept_text, n_words, n_removed): the documents with what is left of their texts.

    White space between kept words stays as it was.
    """
    return _run(docs, id_col, text_col, True).select("row", F.col("kept").alias("kept_text"), "n_words", "n_removed")


def oracle() -> str:
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, n, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM g),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM h) WHERE low < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM m),
r AS (SELECT doc_id, list(k) AS ks FROM x GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE
        list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ks, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
