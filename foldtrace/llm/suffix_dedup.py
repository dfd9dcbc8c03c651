"""Suffix-array dedup over bytes by difference-cover blockwise construction.

A byte is removed if a ``LENGTH``-byte string over it also starts earlier (smaller id, or the
same document and an earlier start).  Suffixes that share their first ``LENGTH`` bytes stand
together in the suffix array; only that grouping is needed, so suffixes are ordered by the
order of their fingerprints instead of the alphabet, and by position within a group.

1. Cover samples: suffixes at offsets whose residue modulo ``PERIOD`` is in a difference cover
   are ranked first, by the fingerprint of their first ``SAMPLE`` bytes.  Two equal strings of
   ``LENGTH`` bytes have, below the period, a shift that brings both into the cover, and the
   sample there is equal too.  A sample whose rank is its own alone settles every suffix it
   would have to decide: none of them can tie on account of it.
2. Runs: texts are also cut where their bytes say so, so equal passages have equal cuts.  The
   suffixes between two cuts are a run; a run whose text, with the ``LENGTH - 1`` bytes after
   it, occurs in an earlier run repeats that run's order suffix by suffix, and is settled.
3. Blocks: what is left are the long ties, suffixes of unsettled runs that start at most
   ``PERIOD - 1`` bytes before a sample of shared rank.  They are dealt into buckets of the order
   and each bucket is sorted alone, in bounded memory; per distinct prefix the earliest position
   is the first.  (The first position of a prefix is never in a settled run.)

Suffixes are never written with their text: a chunk of documents sends 4 bytes per distinct
sample and 8 per distinct run and long tie, differences packed.  Chunks are ordered by id, so the first
chunk holding a prefix has its earliest start, and no entry carries a position.  Prefixes are
compared by 64-bit fingerprints plus the bits of an independent bucket fingerprint.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes keep all; rows with the same
id are ordered by text (where they are more than a chunk, by a hash of it first) and otherwise
treated as documents one after the other; a null id counts as smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import fingerprints as fp

LENGTH = 100
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # every difference modulo 57 occurs once between two of them
SAMPLE = LENGTH - PERIOD + 1
SAMPLE_BITS = 32
#: Bytes of text per sample, run and long tie sent, for the number of buckets.
BYTES_PER_SAMPLE = PERIOD / len(COVER)
BYTES_PER_TIE = 16
#: A cut is where a product of four bytes has so many leading zero bits: every 64 bytes, about.
CUT_BITS = 6
BYTES_PER_RUN = 1 << CUT_BITS
_CUT_FACTOR = np.uint32(2654435761)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Block:
    """Some consecutive texts of a chunk."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        self.data, self.size = data, len(data)
        lengths = np.diff(limits)
        self.start = np.repeat(limits[:-1], lengths)  # of the text of each byte
        self.end = np.repeat(limits[1:], lengths)
        self.hashes = fp.Ranges(data)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        here = np.arange(self.size)
        at = np.flatnonzero(_IN_COVER[(here - self.start) % PERIOD] & (self.end - here >= SAMPLE))
        return at, self.hashes.of(at, at + SAMPLE)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs that hold a whole prefix, with their fingerprints."""
        cut = np.zeros(self.size, dtype=bool)
        if self.size >= 4:
            four = self.data[:-3].astype(np.uint32)
            for k in (1, 2, 3):
                four |= self.data[k : self.size - 3 + k].astype(np.uint32) << np.uint32(8 * k)
            cut[:-3] = (four * _CUT_FACTOR) >> np.uint32(32 - CUT_BITS) == 0
        cut[self.start[self.start == np.arange(self.size)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], self.size)
        until = np.minimum(ends + LENGTH - 1, self.end[starts]) if len(starts) else ends[:0]
        ends = ends[: len(starts)]
        whole = until - starts >= LENGTH
        starts, ends, until = starts[whole], ends[whole], until[whole]
        ends = np.minimum(ends, until - LENGTH + 1)  # of the starts of whole prefixes
        return starts, ends, self.hashes.of(starts, until), fp.Ranges(self.data, 1).of(starts, until)

    def ties(self, samples: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Starts of the suffixes that one of these samples decides, but for settled ones."""
        step = np.zeros(self.size + 1, dtype=np.int32)
        np.add.at(step, np.maximum(samples - (PERIOD - 1), self.start[samples]), 1)
        np.add.at(step, samples + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.end - np.arange(self.size) >= LENGTH) & ~settled)

    def prefixes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of both families of the first LENGTH bytes."""
        return self.hashes.of(starts, starts + LENGTH), fp.Ranges(self.data, 1).of(starts, starts + LENGTH)


def _blocks(table: pa.Table):
    """(first byte in the chunk, block) of a chunk in order."""
    data, offsets = ex.text_buffer(table)
    for first, last in fp.blocks(offsets, ex.BLOCK_BYTES):
        yield int(offsets[first]), _Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *parts])


class _Chunk:
    """Samples and runs of a chunk."""

    def __init__(self, table: pa.Table, buckets: int):
        at, samples, starts, ends, runs, others = ([] for _ in range(6))
        for base, block in _blocks(table):
            places, values = block.samples()
            at.append(places + base)
            samples.append(values)
            first, last, values, other = block.runs()
            starts.append(first + base)
            ends.append(last + base)
            runs.append(values)
            others.append(other)
        self.at, self.starts, self.ends = _joined(at, np.int64), _joined(starts, np.int64), _joined(ends, np.int64)
        self.samples = ex.Split(_joined(samples), buckets, SAMPLE_BITS)
        self.runs = ex.Split(_joined(runs), buckets, others=_joined(others))

    def ties(self, table: pa.Table, replies: dict[int, bytes], buckets: int) -> tuple[np.ndarray, ex.Split, np.ndarray]:
        """Places of the long ties, their prefixes, and which starts of the chunk are settled."""
        told, _, several = self.samples.apply(ex.of_kind(replies, 2, 0))
        shared = self.at[told | several]
        told, first, _ = self.runs.apply(ex.of_kind(replies, 2, 1))
        data, _ = ex.text_buffer(table)
        step = np.zeros(len(data) + 1, dtype=np.int32)
        again = ~(told & first)
        np.add.at(step, self.starts[again], 1)
        np.add.at(step, self.ends[again], -1)
        settled = np.cumsum(step[:-1], dtype=np.int32) > 0
        places, hashes, others = [], [], []
        for base, block in _blocks(table):
            low, high = np.searchsorted(shared, [base, base + block.size])
            if high > low:
                starts = block.ties(shared[low:high] - base, settled[base : base + block.size])
                whole, other = block.prefixes(starts)
                places.append(starts + base)
                hashes.append(whole)
                others.append(other)
        return _joined(places, np.int64), ex.Split(_joined(hashes), buckets, others=_joined(others)), settled


def _sample_and_run_entries(buckets: int):
    def emit(table: pa.Table) -> pa.Table:
        chunk, number = _Chunk(ex.in_order(table), buckets), ex.chunk_number(table)
        return pa.concat_tables([chunk.samples.entries(number, 2, 0), chunk.runs.entries(number, 2, 1)])

    return emit


def _tie_entries(buckets: tuple[int, int]):
    def emit(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ex.Split(np.zeros(0, dtype=np.uint64), 1).entries(0)
        number, docs = ex.chunk_number(docs), ex.in_order(docs)
        return _Chunk(docs, buckets[0]).ties(docs, ex.replies_of(replies), buckets[1])[1].entries(number)

    return emit


def _finish(buckets: tuple[int, int], texts: bool):
    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = ex.in_order(docs)
        data, offsets = ex.text_buffer(docs)
        starts, split, settled = _Chunk(docs, buckets[0]).ties(docs, ex.replies_of(replies, 1), buckets[1])
        told, first, _ = split.apply(ex.replies_of(replies, 2))
        step = np.zeros(len(data) + 1, dtype=np.int32)
        gone = np.concatenate([starts[~(told & first)], np.flatnonzero(settled)])
        np.add.at(step, gone, 1)
        np.add.at(step, gone + LENGTH, -1)
        removed = np.cumsum(step[:-1], dtype=np.int32) > 0
        counts, spans, kept = [], [], []
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            out = removed[low:high]
            counts.append(int(np.count_nonzero(out)))
            spans.append(int(np.count_nonzero(out[1:] & ~out[:-1]) + out[:1].sum()) if counts[-1] else 0)
            rest = (data[low:high] if not counts[-1] else data[low:high][~out]).tobytes()
            kept.append(rest if texts else hashlib.sha256(rest).hexdigest())
        return pa.table(
            {
                "id": docs.column("id"),
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(counts, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept, pa.binary() if texts else pa.string()),
            }
        )

    return finish


def _run(docs: DataFrame, id_col: str, text_col: str, texts: bool) -> DataFrame:
    chunks, total, _ = ex.ordered_chunks(docs, id_col, text_col)
    buckets = ex.bucket_count(total / BYTES_PER_SAMPLE), ex.bucket_count(total / BYTES_PER_TIE)
    by_chunk = chunks.groupBy("chunk")
    samples = ex.ask(by_chunk.applyInArrow(_sample_and_run_entries(buckets[0]), ex.ENTRY_SCHEMA), "repeated", "first")
    entries = by_chunk.cogroup(samples.groupBy("chunk")).applyInArrow(_tie_entries(buckets), ex.ENTRY_SCHEMA)
    ties = ex.ask(entries, "first")
    replies = samples.withColumn("step", F.lit(1)).union(ties.withColumn("step", F.lit(2)))
    schema = f"id long, n_bytes long, n_removed long, n_spans long, kept {'binary' if texts else 'string'}"
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_finish(buckets, texts), schema)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per document."""
    return _run(docs, id_col, text_col, False).select(
        F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256")
    )


def dedup_byte_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept binary, n_removed, n_spans): what is left of the texts, as bytes."""
    return _run(docs, id_col, text_col, True).select(F.col("id").alias(id_col), "kept", "n_removed", "n_spans")
