"""Alignment of two tokenizations of the same text, with corpus-wide counts of linked ids.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces with byte
fallback) the text, before which it puts a space itself.  Where tokens of both end at one byte
offset, the text is cut into groups: each side's cumulative ends become a dictionary from end
to index, the intersection of the key sets, sorted, slices both id lists, and the tokens of a
slice whose byte ranges overlap are links.

Both tokenizers always cut before a single space between two other characters that are no
white space: no pre-token of A runs over such a place, and no piece of B holds a space after
another character (checked when the vocabulary is loaded).  So such a place ends a group, and a
text is a sequence of units that are encoded and aligned each for itself, each distinct unit of
a batch once.

Linked ids are counted over the corpus: the units are stored, with the distinct id pairs of a
document and how often it links each, and summed by pair.  The counts return by a join that
broadcasts ``SLICE_PAIRS`` pairs at a time: a frequent pair, which nearly every document holds,
is looked up where the document is and gathers nothing.  Small tables need one slice; each
further one reads the stored pairs once more.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte by
byte (U+2581 in a text, for one), have no tokens: zeros and the empty string; special tokens'
strings are plain text; a null id is kept; repeated rows count each; a text without a place to
cut is one unit; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
MAX_VOCABULARY_BYTES = 64 << 20
#: So many pairs are broadcast at a time (about 60 MB in the driver and in each executor).
SLICE_PAIRS = 1_000_000
#: Units that a Python worker keeps between batches, twice (about 300 bytes each), and the longest it keeps.
KEPT_UNITS = 300_000
KEPT_CHARS = 100
#: A batch is worked off in stretches of about so many characters, of which so many units are
#: encoded at once.
STRETCH_CHARS = 2 << 20
ALIGNED_UNITS = 20_000

#: A pair of ids as one number; the id of B is the lower half.
PAIR_SHIFT = 32

ENCODED = (
    "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<struct<pair: bigint, times: bigint>>"
)

# Python's white space holds that of both tokenizers, so fewer places are cut, never a wrong one.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def bytes_of_characters() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, loaded from the content of their files, and the bytes of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        code = bytes_of_characters()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[k] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        shape = json.loads(byte_level)
        pre = shape.get("pre_tokenizer") or {}
        self.cuttable = (
            not shape.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not any(re.search("[^▁]▁", name) for name in names)
        )

    def units_of(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuttable else [text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        return a, self.b.encode(units, num_threads=1)


def sliced(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends with how many tokens of A and of B end up to each; links as token numbers of
    A and of B, in order of their bytes.

    Between two neighbouring ends of either side lie bytes of one token of each, and two tokens
    that overlap do so in one such stretch: a slice has as many links as ends.
    """
    index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    common = [end for end in index_b if end in index_a]  # ends ascend, and so does their dictionary
    upto_a = np.fromiter(map(index_a.__getitem__, common), np.int64, len(common))
    upto_b = np.fromiter(map(index_b.__getitem__, common), np.int64, len(common))
    ends = np.union1d(ends_a, ends_b)
    return np.array(common, dtype=np.int64), upto_a, upto_b, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def align_units(tokenizers: Tokenizers, units: list[str]) -> list[tuple]:
    """Per unit (given back by both tokenizers, tokens of A, of B, groups, links, groups as text,
    id pairs of the links as bytes)."""
    lost = (False, 0, 0, 0, 0, "", b"")
    lists = tokenizers.encode(units)
    tables = (tokenizers.bytes_a, tokenizers.bytes_b)
    wanted = [(" " + unit).encode() for unit in units]
    lengths = np.array([len(want) for want in wanted], dtype=np.int64)
    good = list(range(len(units)))
    flats = [list(chain.from_iterable(side)) for side in lists]
    counts = [np.array(list(map(len, side)), dtype=np.int64) for side in lists]
    whole = b"".join(wanted)
    fits = all(
        b"".join(map(table.__getitem__, flat)) == whole and np.array_equal(np.cumsum(sizes[flat])[np.cumsum(count) - 1], np.cumsum(lengths))
        for flat, count, table, sizes in zip(flats, counts, tables, (tokenizers.sizes_a, tokenizers.sizes_b))
        if flat or whole
    )
    if not fits:
        good = [k for k in good if all(b"".join([table[i] for i in side[k]]) == wanted[k] for side, table in zip(lists, tables))]
        flats = [list(chain.from_iterable(side[k] for k in good)) for side in lists]
        counts = [count[good] for count in counts]
        lengths = lengths[good]
    found = [lost] * len(units)
    if not good:
        return found
    # The good units in a row, as one text: each starts where the one before ends, on both sides.
    limits = np.cumsum(lengths)
    ids = [np.array(flat, dtype=np.int64) for flat in flats]
    ends = [np.cumsum(sizes[flat]) for flat, sizes in zip(ids, (tokenizers.sizes_a, tokenizers.sizes_b))]
    common, upto_a, upto_b, link_a, link_b = sliced(*ends)
    names = [list(map(str, flat)) for flat in flats]
    groups, from_a, from_b = [], 0, 0
    for to_a, to_b in zip(upto_a.tolist(), upto_b.tolist()):
        groups.append(f"{names[0][from_a] if to_a == from_a + 1 else ','.join(names[0][from_a:to_a])}|{','.join(names[1][from_b:to_b])}")
        from_a, from_b = to_a, to_b
    pairs = (ids[0][link_a] << PAIR_SHIFT | ids[1][link_b]).tobytes()
    group_at = [0, *np.searchsorted(common, limits, side="right").tolist()]
    link_at = [0, *np.searchsorted(ends[0][link_a], limits, side="right").tolist()]
    for n, (k, n_a, n_b) in enumerate(zip(good, *(count.tolist() for count in counts))):
        g0, g1, l0, l1 = group_at[n], group_at[n + 1], link_at[n], link_at[n + 1]
        found[k] = (True, n_a, n_b, g1 - g0, l1 - l0, ";".join(groups[g0:g1]), pairs[8 * l0 : 8 * l1])
    return found


_worker: dict = {}


class Numbers(dict):
    """Numbers of keys, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Kept:
    """Units of earlier stretches: the recent ones, and those before that were used again."""

    def __init__(self):
        self.young, self.old = {}, {}

    def get(self, unit: str) -> tuple | None:
        found = self.young.get(unit)
        if found is None:
            found = self.old.get(unit)
            if found is not None:
                self.young[unit] = found
        return found

    def put(self, unit: str, row: tuple) -> None:
        if len(unit) <= KEPT_CHARS:
            if len(self.young) >= KEPT_UNITS:
                self.old, self.young = self.young, {}
            self.young[unit] = row


class _Units:
    """Aligned units of a stretch of texts as flat arrays, in the order of their numbers."""

    def __init__(self, tokenizers: Tokenizers, kept: Kept, names: list[str]):
        rows = [kept.get(u) for u in names]
        missing = [k for k, row in enumerate(rows) if row is None]
        for at in range(0, len(missing), ALIGNED_UNITS):
            part = missing[at : at + ALIGNED_UNITS]
            for k, row in zip(part, align_units(tokenizers, [names[k] for k in part])):
                rows[k] = row
                kept.put(names[k], row)
        self.told = np.array([r[0] for r in rows], dtype=bool)
        self.counts = np.array([r[1:5] for r in rows], dtype=np.int64).reshape(-1, 4)
        self.texts = [r[5] for r in rows]
        self.at = np.concatenate([[0], np.cumsum(self.counts[:, 3])])
        self.pairs = np.frombuffer(b"".join([r[6] for r in rows]), dtype=np.int64)


def _stretches(texts: list[str | None]):
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= STRETCH_CHARS:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _encode_texts(tokenizers: Tokenizers, kept: Kept, texts: list[str | None]):
    """Counts, digest and distinct pairs of each text."""
    numbers = Numbers()
    held = [np.fromiter(map(numbers.__getitem__, tokenizers.units_of(t)), np.int64) if t else () for t in texts]
    units = _Units(tokenizers, kept, list(numbers))
    for own in held:
        if not len(own) or not units.told[own].all():
            yield (0, 0, 0, 0), "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            continue
        text = ";".join(map(units.texts.__getitem__, own.tolist()))
        unit, times = np.unique(own, return_counts=True)
        sums = times @ units.counts[unit]
        lengths = units.counts[unit, 3]
        place = np.repeat(units.at[unit], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        pairs, where = np.unique(units.pairs[place], return_inverse=True)
        counts = np.bincount(where, weights=np.repeat(times, lengths), minlength=len(pairs)).astype(np.int64)
        yield tuple(sums.tolist()), hashlib.sha256(text.encode()).hexdigest(), pairs, counts


def _encoder(shared):
    def encode(batches):
        if _worker.get("key") != shared.value[2]:
            _worker.update(key=shared.value[2], tokenizers=Tokenizers(*shared.value[:2]), kept=Kept())
        # Nothing here makes reference cycles, and looking for them among all kept units takes long.
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from encode_batches(batches)
        finally:
            if collecting:
                gc.enable()

    def encode_batches(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in _stretches(texts):
                done = list(_encode_texts(_worker["tokenizers"], _worker["kept"], texts[first:last]))
                counts = np.array([d[0] for d in done], dtype=np.int64).reshape(-1, 4)
                offsets = np.concatenate([[0], np.cumsum([len(d[2]) for d in done])])
                pairs = pa.StructArray.from_arrays([np.concatenate([d[k] for d in done]) for k in (2, 3)], ["pair", "times"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column("row")[first:last],
                        "id": batch.column("id")[first:last],
                        **{name: counts[:, k] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                        "groups_sha256": [d[1] for d in done],
                        "pairs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                    }
                )

    return encode


def _vocabulary(directory: str, name: str) -> bytes:
    content = (Path(directory) / name).read_bytes()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{name} has more than {MAX_VOCABULARY_BYTES} bytes; it would be broadcast")
    return content


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS,
           byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per document its token counts, digest of groups, and distinct linked pairs; stored.

    The driver reads the two vocabulary files and broadcasts them; executors need no copy."""
    contents = [_vocabulary(tokenizers, name) for name in (byte_level, pieces)]
    key = hashlib.sha256(b"".join(contents)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((*contents, key))
    frame = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    return stored(frame.mapInArrow(_encoder(shared), ENCODED), "alignment", compression="zstd")


def link_counts(encoded: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether no pair of its B id
    has more."""
    linked = encoded.select(F.inline("pairs")).groupBy("pair").agg(F.sum("times").alias("count"))
    linked = linked.withColumn("b", F.col("pair").bitwiseAND((1 << PAIR_SHIFT) - 1))
    most = linked.groupBy("b").agg(F.max("count").alias("most"))
    return linked.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS,
                 byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    encoded = encode(docs, id_col, text_col, tokenizers, byte_level, pieces)
    counts = stored(link_counts(encoded), "alignment-counts")
    slices = max(1, -(-counts.count() // SLICE_PAIRS))
    parts = None
    for k in range(slices):
        own = F.broadcast(counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k))
        held = encoded.select("row", F.inline("pairs")).join(own, "pair")
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
        sums = held.groupBy("row").agg(best, F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        parts = sums if parts is None else parts.unionByName(sums)
    if slices > 1:
        parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = [F.coalesce(name, F.lit(0)).alias(name) for name in ("n_best", "count_sum")]
    told = encoded.drop("pairs").join(parts, "row", "left")
    return told.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


def most_linked(docs: DataFrame, **options) -> DataFrame:
    """A dictionary from ids of B to ids of A: (id_b, id_a, count) of the pairs linked most."""
    counts = link_counts(encode(docs, **options))
    return counts.where("best").select(
        F.col("pair").bitwiseAND((1 << PAIR_SHIFT) - 1).alias("id_b"), F.shiftright("pair", PAIR_SHIFT).alias("id_a"), "count"
    )
