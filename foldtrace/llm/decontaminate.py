"""Benchmark decontamination: token windows of documents against a set of benchmark windows.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased.
A benchmark item gives its windows of ``WINDOW`` words, or itself if it has fewer.  The set is
broadcast, packed in arrays, after the bytes of those arrays are counted; documents are scanned
where they are, without a shuffle, and every fingerprint hit is verified word by word.  A set
above ``MAX_BROADCAST_BYTES`` is joined by a shuffle on the fingerprint instead; of the documents
only windows that a bit table of fixed size lets pass are shipped then.

Defined cases: null texts have no words; items without words match nothing; a null item id is
written as the empty text; repeated items count once per id; repeated documents are judged row
by row; an empty benchmark leaves every document clean; an empty table gives an empty result;
extra columns are ignored, or kept by the row form.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .common import text_of
from .exchange import BLOCK_BYTES, text_buffer

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
#: Most bytes of the arrays for one window of an item: fingerprint, place, length, owner, owner's
#: place, and up to 32 bytes of the bit table.
WINDOW_BYTES = 8 + 8 + 8 + 4 + 8 + 32
#: Bits of the table that the shuffled way sends to the documents (16 MB), and bytes of one page of it.
TABLE_BITS, PAGE_BYTES = 27, 8192

_GAP = np.ones(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _GAP[_low : _high + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class _Block:
    """Words of some consecutive texts."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        self.data = _LOWER[data]
        self.starts, self.ends, at = fp.word_spans(self.data, limits, _GAP)
        self.first = at if len(data) else np.zeros(len(limits), dtype=np.int64)
        self.counts = np.diff(self.first)
        self.total = len(self.starts)
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left = self.first[1:][self.text_of] - np.arange(self.total)
        self.hashes = fp.Ranges(self.data).of(self.starts, self.ends)

    def words(self, start: int, width: int) -> tuple[bytes, ...]:
        return tuple(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(start, start + width))


def _blocks(table: pa.Table):
    """(first text, block) of a table of texts."""
    data, offsets = text_buffer(table)
    for first, last in fp.blocks(offsets, BLOCK_BYTES):
        yield first, _Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def _item_windows(block: _Block, window: int):
    """(text, width, start) of every window of the items of a block."""
    for text, (start, count) in enumerate(zip(block.first[:-1].tolist(), block.counts.tolist())):
        width = min(window, count)
        if width:
            for at in range(start, start + count - width + 1):
                yield text, width, at


class WindowSet:
    """Benchmark windows by width as arrays: a bit table, sorted fingerprints, the place of the
    words in one buffer, and the items that own the window."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        self.ids, at = ids, 0
        buffer, found = [], defaultdict(list)
        for first, block in _blocks(pa.table({"text": pa.array(texts, pa.string())})):
            begin = at + np.concatenate([[0], np.cumsum(block.ends - block.starts + 1)]).astype(np.int64)
            buffer.append(b"".join(block.data[s:e].tobytes() + b"\0" for s, e in zip(block.starts.tolist(), block.ends.tolist())))
            at = int(begin[-1])
            for width in np.unique(np.minimum(block.counts[block.counts > 0], window)).tolist():
                short = block.first[:-1][block.counts == width]
                spots = np.flatnonzero(block.left >= width) if width == window else short
                hashes = fp.window_hashes(block.hashes, width)[spots]
                owner = (first + block.text_of[spots]).astype(np.int32)
                found[width].append((hashes, begin[spots], begin[spots + width] - 1 - begin[spots], owner))
        self.words = b"".join(buffer)
        self.widths = {width: self._packed(*map(np.concatenate, zip(*parts))) for width, parts in found.items()}

    def _packed(self, hashes, begin, length, owner):
        order = np.lexsort((owner, hashes))
        hashes, begin, length, owner = hashes[order], begin[order], length[order], owner[order]
        first = np.append(True, hashes[1:] != hashes[:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        # Windows of one fingerprint that are not its first one's words: told apart one by one.
        kind, kinds = np.zeros(len(hashes), dtype=np.int64), {}
        for k in np.flatnonzero(~first).tolist():
            words = self._window(begin[k], length[k])
            if words != self._window(begin[lead[k]], length[lead[k]]):
                same = kinds.setdefault(int(hashes[k]), {})
                kind[k] = same.setdefault(words, len(same) + 1)
        order = np.lexsort((owner, kind, hashes))
        hashes, begin, length, owner, kind = hashes[order], begin[order], length[order], owner[order], kind[order]
        new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (kind[1:] != kind[:-1])))
        bits = min(26, max(10, len(new).bit_length() + 4))
        table = np.zeros(1 << bits, dtype=bool)
        mask = np.uint64((1 << bits) - 1)
        table[hashes & mask] = True
        return table, mask, hashes[new], begin[new], length[new], np.append(new, len(hashes)), owner

    def _window(self, begin, length) -> bytes:
        return self.words[int(begin) : int(begin) + int(length)]

    def size(self) -> int:
        """Bytes of the arrays and the words."""
        return len(self.words) + sum(a.nbytes for packed in self.widths.values() for a in packed)

    def hits(self, block: _Block):
        """(width, start, items) of every verified occurrence in a block."""
        for width, (table, mask, values, begin, length, owners_at, owners) in self.widths.items():
            found = fp.window_hashes(block.hashes, width)
            if not len(found):
                continue
            at = np.flatnonzero(table[found & mask] & (block.left[: len(found)] >= width))
            low, high = np.searchsorted(values, found[at]), np.searchsorted(values, found[at], side="right")
            hit = high > low
            for start, one, end in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
                words = b"\0".join(block.words(start, width))
                for k in range(one, end):
                    if self._window(begin[k], length[k]) == words:
                        yield width, start, [self.ids[item] for item in owners[owners_at[k] : owners_at[k + 1]].tolist()]


def _judge(table: pa.Table, windows: WindowSet):
    """Per text: words, covered words, items; and the covered byte spans."""
    n = table.num_rows
    n_words, n_hit = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    items: list[set] = [set() for _ in range(n)]
    for first, block in _blocks(table):
        step = np.zeros(block.total + 1, dtype=np.int64)
        for width, start, owners in windows.hits(block):
            step[start] += 1
            step[start + width] -= 1
            items[first + int(block.text_of[start])] |= set(owners)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
        n_words[first : first + len(block.counts)] = block.counts
        n_hit[first : first + len(block.counts)] = covered[block.first[1:]] - covered[block.first[:-1]]
    return n_words, n_hit, items


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scanner(shared, window_columns: bool):
    def scan(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            n_words, n_hit, items = _judge(table, shared.value)
            columns = {"id": table.column("id"), "n_words": n_words, "n_hit": n_hit}
            columns |= {"n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": [_digest(x) for x in items]}
            if window_columns:
                columns["row"] = table.column("row")
            yield from pa.table(columns).to_batches()

    return scan


RESULT_SCHEMA = "id long, n_words long, n_hit long, n_items long, items_sha256 string"


def _items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_of(text_col).alias("text")).where("text <> ''")


def _word_count(text_col: str):
    return F.size(F.filter(F.split(text_col, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("bigint")


def _scan(frame: DataFrame, items: DataFrame, carry: bool, window: int) -> DataFrame:
    """Scan (id, text[, row]); the benchmark is broadcast if its windows are within the bound."""
    words = _word_count("text")
    windows = F.when(words > window, words - (window - 1)).otherwise(F.least(words, F.lit(1)))
    # Words and one byte between them fit the text and one byte more.
    size = items.agg(F.coalesce(F.sum(windows * WINDOW_BYTES + F.octet_length("text") + F.octet_length("item") + 65), F.lit(0))).first()[0]
    schema = RESULT_SCHEMA + (f", row {frame.schema['row'].dataType.simpleString()}" if carry else "")
    if size <= MAX_BROADCAST_BYTES:
        rows = items.collect()
        windows = WindowSet([r.item for r in rows], [r.text for r in rows], window)
        return frame.mapInArrow(_scanner(frame.sparkSession.sparkContext.broadcast(windows), carry), schema)
    return _scan_by_shuffle(frame, items, carry, window)


def _table_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """The bits of windows in the table of all widths."""
    return (fp.mix(hashes ^ np.uint64(width)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _table_pages(batches):
    """Pages of the bit table with the windows of a partition."""
    bits = np.zeros(1 << TABLE_BITS, dtype=bool)
    for batch in batches:
        hashes = np.asarray(batch.column("hash")).view(np.uint64)
        widths = np.asarray(batch.column("width"))
        for width in np.unique(widths).tolist():
            bits[_table_places(hashes[widths == width], width)] = True
    pages = np.packbits(bits).reshape(-1, PAGE_BYTES)
    used = np.flatnonzero(pages.any(axis=1))
    for part in np.array_split(used, len(used) // 256 + 1):
        if len(part):
            yield pa.RecordBatch.from_pydict({"page": pa.array(part, pa.int32()), "bits": [pages[k].tobytes() for k in part]})


def _merged_page(table: pa.Table) -> pa.Table:
    pages = [np.frombuffer(raw, dtype=np.uint8) for raw in table.column("bits").to_pylist()]
    return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(pages).tobytes()], pa.binary())})


def _bit_table(wanted: DataFrame) -> np.ndarray:
    """One bit per place that a window of the benchmark takes: 16 MB whatever the benchmark."""
    kind = "page int, bits binary"
    pages = wanted.select("width", "hash").mapInArrow(_table_pages, kind).groupBy("page").applyInArrow(_merged_page, kind)
    bits = np.zeros((1 << TABLE_BITS) // 8, dtype=np.uint8)
    for row in pages.collect():
        bits[row.page * PAGE_BYTES : (row.page + 1) * PAGE_BYTES] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def _emit_windows(window: int, widths: tuple[int, ...] | None, passing=None):
    """Windows as rows: those of items (``widths`` None), or of documents all of these widths that
    are in the bit table."""

    def emit(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = table.column(0).to_pylist()
            for first, block in _blocks(table):
                for width in widths or range(1, window + 1):
                    hashes = fp.window_hashes(block.hashes, width)
                    if widths is None:
                        spots = [at for _, w, at in _item_windows(block, window) if w == width]
                    else:
                        spots = np.flatnonzero(block.left[: len(hashes)] >= width)
                        places = _table_places(hashes[spots], width)
                        spots = spots[(passing.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0].tolist()
                    if spots:
                        text = block.text_of[spots]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "name": [names[first + k] for k in text.tolist()],
                                "width": pa.array([width] * len(spots), pa.int32()),
                                "start": pa.array(np.asarray(spots) - block.first[:-1][text], pa.int64()),
                                "hash": pa.array(hashes[spots].view(np.int64), pa.int64()),
                                "words": [b"\0".join(block.words(at, width)) for at in spots],
                            }
                        )

    return emit


def _scan_by_shuffle(frame: DataFrame, items: DataFrame, carry: bool, window: int) -> DataFrame:
    """The way for a benchmark too large to broadcast: both sides' windows meet by fingerprint."""
    kind = "width int, start long, hash long, words binary"
    wanted = items.select("item", "text").mapInArrow(_emit_windows(window, None), f"name string, {kind}")
    wanted = wanted.select(F.col("name").alias("item"), "width", "hash", "words").distinct()
    widths = tuple(r[0] for r in wanted.select("width").distinct().collect())  # at most ``window`` numbers
    passing = frame.sparkSession.sparkContext.broadcast(_bit_table(wanted))
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("text")), 256)
    docs = frame.withColumn("name", key)
    texts = docs.select("name", "text").distinct()
    held = texts.mapInArrow(_emit_windows(window, widths or (window,), passing), f"name string, {kind}")
    hits = held.join(wanted, ["width", "hash", "words"])
    spots = hits.select("name", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("spot"))
    n_hit = spots.groupBy("name").agg(F.countDistinct("spot").alias("n_hit"))
    found = hits.groupBy("name").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = docs.withColumn("n_words", _word_count("text")).join(n_hit, "name", "left").join(found, "name", "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items_col).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"), *(["row"] if carry else []),
    )


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) per document."""
    frame = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    found = _scan(frame, _items_of(benchmark, item_col, item_text_col), False, window)
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their columns unchanged."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    frame = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), row)
    return _scan(frame, _items_of(benchmark, item_col, item_text_col), True, window).where("n_hit = 0").select("row.*")


def oracle() -> str:
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({lower}, '{gap}') AS ws FROM benchmark),
bw AS (SELECT item, least(len(ws), {WINDOW}) AS k, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM bg),
d AS (SELECT doc_id, regexp_extract_all({lower}, '{gap}') AS ws FROM documents),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, ks WHERE len(ws) >= k),
hit AS (SELECT doc_id, i, bg.k, item FROM (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM dw) w JOIN bg ON w.g = bg.g AND w.k = bg.k),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
