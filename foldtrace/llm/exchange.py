"""Exchange of packed fingerprints between chunks of documents and fingerprint buckets.

Documents are dealt into chunks of bounded size, ordered by id: no id of a chunk is larger than
any id of the next.  Chunks are cut evenly between quantiles of the ids; where that leaves one
with too many bytes, it is cut again at quantiles of its own, and rows of one id (or without id)
by a hash of the text and, where the texts are equal too, by row.  A chunk sends each of its distinct fingerprints once, packed, to
the bucket of that fingerprint; the bucket answers with one bit per fingerprint, in the order
sent.  So a fingerprint that a third of all documents hold costs one entry per chunk, no key
gathers documents, and the answer to "where is it first?" needs no positions: the first chunk
that sent it has it first.

Chunks and buckets both grow in number with the data, not in size.  The chunked documents are
shuffled once; later passes of the same query reuse that exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .common import text_bytes, text_of

CHUNK_BYTES = 4 << 20
BUCKET_ENTRIES = 1_000_000
BLOCK_BYTES = 512 << 10
#: Id quantiles that guide the chunk limits; ids between two of them are cut evenly.
QUANTILES = 32
#: A chunk of more than so many times CHUNK_BYTES is cut again, into at most so many parts at once.
MOST_FULL = 2
MOST_PARTS = 256

ENTRY_SCHEMA = "chunk long, bucket int, payload binary"
REPLY_SCHEMA = "chunk long, bucket int, bits binary"


def _chunk_of(limits: list[int], per_part: int) -> Column:
    """Chunk number, rising with the id; null ids come first."""
    known = F.col("id")
    chunk = F.lit(0).cast("bigint")
    for part, (low, high) in enumerate(zip(limits, limits[1:])):
        step = F.floor((known - F.lit(low)).cast("double") / float(max(1, high - low)) * per_part).cast("bigint")
        inside = F.greatest(F.lit(0), F.least(F.lit(per_part - 1), step)) + part * per_part
        chunk = F.when(known >= low, inside).otherwise(chunk)
    return F.when(known.isNull(), F.lit(-1)).otherwise(chunk).cast("bigint")


def ordered_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
                   chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """(chunk, id, text[, row]) of all documents, the bytes of all texts, and how many chunk
    numbers belong together: chunks with the same quotient by it may share an id.

    ``carry`` keeps the whole input row in the struct ``row``.
    """
    total, _ = text_bytes(docs, text_col)
    columns = [F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    count = max(1, math.ceil(total / chunk_bytes))
    parts = min(QUANTILES, count)
    shares = [k / parts for k in range(parts + 1)]
    limits = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), shares, 10_000)).first()[0] or [0, 0]
    limits = sorted(set(limits)) if len(set(limits)) > 1 else [limits[0], limits[0] + 1]
    frame = docs.select(*columns)
    per_part = math.ceil(count / (len(limits) - 1))
    frame = frame.select((_chunk_of(limits, per_part) + 1).alias("chunk"), "*")
    frame, together = _cut_again(frame, per_part * (len(limits) - 1) + 1, chunk_bytes)
    return frame, total, together


def _cut_again(frame: DataFrame, most: int, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The frame with chunks (numbered up to ``most``) cut until none is too full."""
    together, hashed = 1, F.xxhash64("text")
    size = F.sum(F.octet_length("text")).alias("size")
    for kind in ("id", "hash", "row"):
        key = {"id": F.col("id"), "hash": hashed, "row": F.monotonically_increasing_id()}[kind]
        while True:
            full = frame.groupBy("chunk").agg(size, F.count(F.lit(1)).alias("rows")).where(F.col("size") > MOST_FULL * chunk_bytes)
            numbers = [r.chunk for r in full.where("rows > 1").collect()]  # at most one per MOST_FULL * chunk_bytes
            if not numbers:
                return frame, together
            sought = F.col("chunk").isin(numbers) if len(numbers) < 1000 else F.array_contains(F.lit(numbers), F.col("chunk"))
            parts = [F.min("id").alias("low"), F.max("id").alias("high"), F.min(hashed).alias("first"), F.max(hashed).alias("last"), size]
            if kind != "row":
                shares = [k / MOST_PARTS for k in range(MOST_PARTS + 1)]
                parts.append(F.percentile_approx(key, shares, 10_000).alias("at"))
            cells = {}
            for cell in frame.where(sought).groupBy("chunk").agg(*parts).collect():
                wanted = math.ceil(cell.size / chunk_bytes)
                wanted = wanted if kind == "row" else min(MOST_PARTS, wanted)
                if kind == "row" and cell.low == cell.high and cell.first == cell.last:
                    cells[cell.chunk] = list(range(1, wanted))
                elif kind == "id" and cell.low != cell.high or kind == "hash" and cell.low == cell.high and cell.first != cell.last:
                    low = cell.low if kind == "id" else cell.first
                    at = [cell.at[k * MOST_PARTS // wanted] for k in range(wanted)]
                    # Where the least key is frequent, it gets a chunk of its own.
                    cells[cell.chunk] = sorted(set(at) - {low} | ({low + 1} if at.count(low) > 1 or len(set(at)) < 2 else set()))
            step = max(map(len, cells.values()), default=0) + 1
            if not cells or (most + 1) * step >= 1 << 62:
                break
            if kind == "row":
                counts = F.element_at(F.lit([len(b) + 1 for b in cells.values()]), F.col("cell"))
                part = F.pmod(key, counts)
            else:
                bounds = F.element_at(F.array(*[F.lit(b) for b in cells.values()]), F.col("cell"))
                part = F.size(F.filter(bounds, lambda b: b <= key))
            cell = F.array_position(F.lit(list(cells)), F.col("chunk")).cast("int").alias("cell")
            part = F.when(F.col("cell") > 0, part.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            others = [c for c in frame.columns if c != "chunk"]
            frame = frame.select("*", cell).select((F.col("chunk") * step + part).alias("chunk"), *others)
            most = (most + 1) * step
            together *= 1 if kind == "id" else step
            if kind == "row":
                break
    return frame, together


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a chunk by id (null first), then text."""
    if table.num_rows < 2:
        return table.combine_chunks()
    order = pc.sort_indices(table.select(["id", "text"]), sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order).combine_chunks()


def text_buffer(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a table as one byte array with n + 1 offsets."""
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Split:
    """Fingerprints of a chunk, dealt into buckets; each bucket sorted and distinct.

    ``bits``: how many low bits of a fingerprint are sent.  The bucket comes from the high bits,
    or from a second, independent fingerprint, which then adds to the first one's 64 bits.
    """

    def __init__(self, values: np.ndarray, buckets: int, bits: int = 64, others: np.ndarray | None = None):
        self.size = len(values)
        high = (values if others is None else others) >> np.uint64(32)
        bucket = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)
        kept = values if bits == 64 else values & np.uint64((1 << bits) - 1)
        narrow = bucket.astype(np.uint16) if buckets <= 65536 else bucket
        self.order = np.argsort(narrow, kind="stable")
        bucket = bucket[self.order]
        self.values = kept[self.order]
        edges = np.flatnonzero(np.diff(bucket)) + 1
        self.edges = np.concatenate([[0], edges, [len(bucket)]]) if len(bucket) else np.zeros(1, dtype=np.int64)
        self.names = bucket[self.edges[:-1]] if len(bucket) else bucket

    def parts(self):
        for name, start, end in zip(self.names.tolist(), self.edges[:-1].tolist(), self.edges[1:].tolist()):
            yield name, start, end

    def entries(self, chunk: int, kinds: int = 1, kind: int = 0) -> pa.Table:
        """What the chunk sends; entries of several kinds share an exchange by bucket number."""
        names, payloads = [], []
        for name, start, end in self.parts():
            names.append(name * kinds + kind)
            payloads.append(fp.pack(np.unique(self.values[start:end])))
        return pa.table(
            {"chunk": pa.array([chunk] * len(names), pa.int64()), "bucket": pa.array(names, pa.int32()), "payload": pa.array(payloads, pa.binary())}
        )

    def apply(self, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per value, in the order given: the bucket's bit, whether it is the first such value
        of the chunk, and whether the chunk holds it more than once."""
        told = np.zeros(self.size, dtype=bool)
        first = np.zeros(self.size, dtype=bool)
        several = np.zeros(self.size, dtype=bool)
        for name, start, end in self.parts():
            values, back = self.values[start:end], self.order[start:end]
            by_value = np.argsort(values, kind="stable")
            ordered = values[by_value]
            new = np.ones(len(ordered), dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            bits = np.unpackbits(np.frombuffer(replies[name], dtype=np.uint8), count=len(count)).astype(bool)
            target = back[by_value]
            told[target] = bits[group]
            first[target] = new
            several[target] = count[group] > 1
        return told, first, several


    def earliest(self, owner: np.ndarray) -> np.ndarray:
        """Per value, the least owner among the equal values of the chunk (owners rise)."""
        low = np.zeros(self.size, dtype=np.int64)
        for _, start, end in self.parts():
            values, back = self.values[start:end], self.order[start:end]
            by_value = np.argsort(values, kind="stable")
            ordered, target = values[by_value], back[by_value]
            new = np.ones(len(ordered), dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            low[target] = owner[target][new][np.cumsum(new) - 1]
        return low


def _answer(modes: tuple[str, ...], together: int):
    def answer(table: pa.Table) -> pa.Table:
        mode = modes[table.column("bucket")[0].as_py() % len(modes)]
        chunks = np.asarray(table.column("chunk").to_numpy())
        order = np.argsort(chunks, kind="stable")
        payloads = table.column("payload").to_pylist()
        lists = [fp.unpack(payloads[i]) for i in order]
        lengths = np.array([len(x) for x in lists])
        values = np.concatenate(lists)
        by_value = np.argsort(values, kind="stable")  # equal values stay in order of chunks
        ordered = values[by_value]
        same = ordered[1:] == ordered[:-1]
        bit = np.zeros(len(values), dtype=bool)
        if mode == "repeated":  # some other chunk has it too
            marked = np.zeros(len(values), dtype=bool)
            marked[1:] |= same
            marked[:-1] |= same
        else:  # "first": no chunk before has it, but for those that belong together
            rank = np.repeat(chunks[order] // together, lengths)[by_value]
            new = np.ones(len(values), dtype=bool)
            new[1:] = ~same
            marked = rank == rank[new][np.cumsum(new) - 1]
        bit[by_value] = marked
        ends = np.cumsum(lengths)
        bits = [np.packbits(bit[end - n : end]).tobytes() for end, n in zip(ends, lengths)]
        return pa.table(
            {"chunk": pa.array(chunks[order], pa.int64()), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())}
        )

    return answer


def ask(entries: DataFrame, *modes: str, together: int = 1) -> DataFrame:
    """Replies (chunk, bucket, bits) to entries (chunk, bucket, payload), a mode per kind."""
    return entries.groupBy("bucket").applyInArrow(_answer(modes, together), REPLY_SCHEMA)


def bucket_count(expected_entries: float) -> int:
    return max(1, min(2**31 - 1, math.ceil(expected_entries / BUCKET_ENTRIES)))


def replies_of(table: pa.Table, step: int | None = None) -> dict[int, bytes]:
    """Bucket -> bits, of one step where the replies of several are together."""
    if step is not None:
        table = table.filter(pc.equal(table.column("step"), step))
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))


def of_kind(replies: dict[int, bytes], kinds: int, kind: int) -> dict[int, bytes]:
    """The replies to one kind of entries, by their own bucket numbers."""
    return {bucket // kinds: bits for bucket, bits in replies.items() if bucket % kinds == kind}


def chunk_number(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()
