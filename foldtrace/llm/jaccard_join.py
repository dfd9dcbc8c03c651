"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set is its distinct word shingles.  Sizes fall into bands so wide that similar
sets lie in the same or in adjacent bands; a pair is found by the scheme of the larger set's
band.  With at most H differing elements in a band, elements are dealt by hash into
H + 1 + S segments:

* at least S + 1 segments of a similar pair are equal, so if one of the two has at most S empty
  segments, some equal segment is not empty: every set emits a signature of each non-empty
  segment;
* a set with more than S empty segments also emits the one-deletion neighbourhood of its
  segments (each segment with one element left out, the empty ones included): if two such sets
  have only empty segments equal, the pigeonhole leaves a segment that differs by one element;
* a set with so many empty segments that even this may fail emits one signature of its own kind.

The slack S is allocated per band by cost: segments emitted against neighbourhoods expected.

Documents stay where they are scanned.  A task packs the signatures of its documents by bucket;
a bucket discards signatures that one set alone has, and the rest become entries (signature,
node), a node being all documents with an equal set.  The entries are then searched with parity
bitmaps, whose distance never exceeds the true one: first a sample of signatures, then all whose
members lie in different components, cut into blocks where a group is large.  Edges found are
verified exactly on the whole sets.  Where one is refuted, it may have hidden others: the nodes
that edges join, true or not, then meet block against block, and their intersections are counted
exactly, as products of membership matrices.  Only edges that join components are emitted, never
all pairs of a group.  The sets of the nodes on edges are made in another scan, which sends only
sets whose node is in a bit table of fixed size (a false hit costs its bytes, nothing else).

Defined cases: a null text is empty; an empty set links with nothing; a text with fewer words
than a shingle is one shingle; rows with a null id take part and get the least id of their
component, null if there is none; repeated rows are equal sets; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import fingerprints as fp
from .common import stored, text_bytes, text_of
from .components import components

#: Bytes of text per signature, for the number of buckets.
BYTES_PER_SIGNATURE = 16
#: Bits of the table of nodes whose sets are needed: at most 8 MB for 2 ** 26.
FILTER_BITS = 26
#: Elements of sets are compared by so many bits of their fingerprints.
ELEMENT_BITS = 48
BITMAP_BITS, MOST_BITMAP_BITS = 1024, 1 << 15
#: One of so many signatures is in the first search; entries per search task, members per block.
FIRST_SHARE = 16
TASK_ENTRIES = 50_000
BLOCK_MEMBERS = 4096
#: Members per block where whole sets meet.
CROSS_MEMBERS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=None)
def _allocate(percent: int, largest: int, least: int) -> tuple[int, int]:
    """(segments, slack) at the least cost for sets of ``least`` to ``largest`` elements.

    A segment more costs one signature; a set with more empty segments than slack costs its
    neighbourhood, and meets the other such sets.  Slack grows until it stops paying.
    """
    differing = (100 - percent) * 2 * largest // (100 + percent)
    if not differing:
        return 1, 0
    best = None
    for slack in range(2 * differing + 64):
        count = differing + 1 + slack
        empty = count * (1 - 1 / count) ** least
        tail, term = 1.0, math.exp(-empty)
        for k in range(slack + 1):
            tail -= term
            term *= empty / (k + 1)
        cost = slack + max(tail, 0.0) * (least + 1e4)
        if best is None or cost < best[0]:
            best = (cost, count, slack)
        elif tail < 0.5 and slack > best[2] + 8:
            break
    return best[1], best[2]


class Scheme:
    """Bands, segments and slack for one threshold (percent)."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bands = [1]

    def band(self, size: int) -> int:
        while self.bands[-1] <= size:
            self.bands.append(self.bands[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.bands, size, side="right")) - 1

    def largest(self, band: int) -> int:
        self.band(self.bands[-1]) if band + 1 >= len(self.bands) else None
        return self.bands[band + 1] - 1

    def segments(self, band: int) -> tuple[int, int]:
        """(segments, slack) of a band."""
        return _allocate(self.percent, self.largest(band), max(1, self.bands[band] * self.percent // 100))

    def signatures(self, elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of consecutive sets, given as all their elements and their sizes.

        Returns the signatures in order of sets, and how many each set has.
        """
        sets = np.flatnonzero(sizes)
        if not len(sets):
            return np.zeros(0, dtype=np.uint64), np.zeros(len(sizes), dtype=np.int64)
        self.band(int(sizes.max()) * 100 // self.percent + 2)
        limits = np.array(self.bands)
        own = np.searchsorted(limits, sizes, side="right") - 1
        # The next band is in reach if its least size is near enough to this one.
        near = self.percent * limits[own + 1] <= 100 * sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mixed, dealt = fp.mix(elements), (elements * _ODD) >> np.uint64(32)
        whose, found = [], []
        for band, chosen in ((own, sizes > 0), (own + 1, (sizes > 0) & near)):
            self._emit(band, np.flatnonzero(chosen), owner, mixed, dealt, chosen, whose, found)
        whose, found = np.concatenate(whose), np.concatenate(found)
        return found[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(sizes))

    def _emit(self, band, sets, owner, mixed, dealt, chosen, whose, found) -> None:
        """Signatures of the chosen sets under one band each."""
        if not len(sets):
            return
        plan = np.array([self.segments(int(b)) for b in range(int(band[sets].max()) + 1)])
        count, slack = plan[band[sets], 0], plan[band[sets], 1]
        start = np.concatenate([[0], np.cumsum(count)])
        place = np.zeros(len(band), dtype=np.int64)
        place[sets] = np.arange(len(sets))
        if chosen.all():
            at = place[owner]
        else:
            mine = chosen[owner]
            at, mixed, dealt = place[owner[mine]], mixed[mine], dealt[mine]
        segment = ((dealt * count[at].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + start[at]
        sums = np.zeros(start[-1], dtype=np.uint64)
        np.add.at(sums, segment, mixed)
        held = np.bincount(segment, minlength=start[-1]) > 0
        of = np.repeat(np.arange(len(sets)), count)
        salt = ((np.arange(start[-1]) - start[of]) + (band[sets][of] << 40)).astype(np.uint64) * _ODD
        whose.append(sets[of[held]])
        found.append(fp.mix((sums ^ salt)[held]))
        empty = count - np.bincount(of[held], minlength=len(sets))
        sparse = empty > slack
        if sparse.any():
            bare = ~held & sparse[of]
            whose.append(sets[of[bare]])
            found.append(fp.mix(salt[bare]))
            lone = sparse[at]
            whose.append(sets[at[lone]])
            found.append(fp.mix((sums[segment] - mixed)[lone] ^ salt[segment][lone]))
            most = 2 * empty > count + slack
            whose.append(sets[most])
            found.append(fp.mix(band[sets][most].astype(np.uint64) + _ODD))


def shingle_sets(table: pa.Table, width: int):
    """The sorted distinct shingle fingerprints of every text of a table, in lists by block."""
    data, offsets = ex.text_buffer(table)
    for first, last in fp.blocks(offsets, ex.BLOCK_BYTES):
        part = _LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, at = fp.word_spans(part, offsets[first : last + 1] - offsets[first])
        words = fp.Ranges(part).of(starts, ends) if len(part) else np.zeros(0, dtype=np.uint64)
        at = at if len(part) else np.zeros(last - first + 1, dtype=np.int64)
        shingles, sets = fp.window_hashes(words, width), []
        for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
            if high - low >= width:
                sets.append(np.unique(shingles[low : high - width + 1]))
            else:
                sets.append(fp.window_hashes(words[low:high], high - low) if high > low else np.zeros(0, dtype=np.uint64))
        yield sets


def _bitmap(elements: np.ndarray) -> bytes:
    """Parities of the elements by residue; a large set has a longer bitmap, so it says as much."""
    bits = BITMAP_BITS
    while 2 * bits < 3 * len(elements) and bits < MOST_BITMAP_BITS:
        bits *= 2
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps brought to ``width`` bytes, which divide theirs: parities add up."""
    out = np.empty((len(bitmaps), width // 8), dtype=np.uint64)
    for k, bitmap in enumerate(bitmaps):
        whole = np.frombuffer(bitmap, dtype=np.uint64)
        out[k] = whole if len(bitmap) == width else np.bitwise_xor.reduce(whole.reshape(-1, width // 8), axis=0)
    return out


def _node(elements: np.ndarray) -> int:
    """The fingerprint of a set, as a signed number."""
    return int(fp.mix(np.array([fp.mix(elements + _ODD).sum(dtype=np.uint64)])).view(np.int64)[0])


def _tables(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


DOC_SCHEMA = "id long, key long, n_shingles long, node long, bitmap binary"


def _docs(width: int):
    """Size, node and bitmap of every document's set; no node for an empty set."""

    def docs(batches):
        for table in _tables(batches):
            found = [x for some in shingle_sets(table, width) for x in some]
            columns = {
                "id": table.column("id"),
                "key": table.column("key"),
                "n_shingles": pa.array([len(x) for x in found], pa.int64()),
                "node": pa.array([_node(x) if len(x) else None for x in found], pa.int64()),
                "bitmap": pa.array([_bitmap(x) if len(x) else None for x in found], pa.binary()),
            }
            yield from pa.table(columns).to_batches()

    return docs


def _packed(percent: int, width: int, buckets: int):
    """Signatures by bucket: sorted, with the place of their node in the task's list of nodes."""

    def packed(batches):
        scheme = Scheme(percent)
        for table in _tables(batches):
            sets, nodes = [], []
            for elements in (x for some in shingle_sets(table, width) for x in some):
                if len(elements):
                    sets.append(elements)
                    nodes.append(_node(elements))
            names, first = np.unique(np.array(nodes, dtype=np.int64), return_index=True)
            sets = [sets[k] for k in first.tolist()]  # equal sets once
            for low in range(0, len(sets), 1024):
                some = sets[low : low + 1024]
                found, counts = scheme.signatures(np.concatenate(some), np.array([len(x) for x in some]))
                yield _by_bucket(found, np.repeat(np.arange(len(some), dtype=np.uint16), counts), names[low : low + 1024], buckets)

    return packed


def _by_bucket(signatures: np.ndarray, owner: np.ndarray, names: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.argsort(signatures)
    signatures, owner = signatures[order], owner[order]
    bucket = ((signatures >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    # Inside a bucket 40 bits are left: signatures that look alike by chance cost a check.
    signatures = signatures >> np.uint64(max(0, 24 - buckets.bit_length()))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    out = {"bucket": [], "signatures": [], "owners": [], "nodes": []}
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        used, place = np.unique(owner[low:high], return_inverse=True)
        out["bucket"].append(int(bucket[low]))
        # Two sets may share a signature: steps of 0 are kept by the packing.
        out["signatures"].append(fp.pack(signatures[low:high]))
        out["owners"].append(np.ascontiguousarray(place.astype(np.uint16).view(np.uint8).reshape(-1, 2).T).tobytes())
        out["nodes"].append(names[used].tobytes())
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(out["bucket"], pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in ("signatures", "owners", "nodes")}}
    )


def _entries_of_bucket(table: pa.Table) -> pa.Table:
    """(signature, node) of the signatures of a bucket that several nodes have."""
    signatures, nodes = [], []
    for packed, owners, names in zip(*(table.column(k).to_pylist() for k in ("signatures", "owners", "nodes"))):
        values = fp.unpack(packed)
        place = np.ascontiguousarray(np.frombuffer(owners, dtype=np.uint8).reshape(2, -1).T).view(np.uint16).ravel()
        signatures.append(values)
        nodes.append(np.frombuffer(names, dtype=np.int64)[place])
    values, names = np.concatenate(signatures), np.concatenate(nodes)
    order = np.lexsort((names, values))
    values, names = values[order], names[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (names[1:] != names[:-1])
    values, names = values[new], names[new]
    same = values[1:] == values[:-1]
    several = np.zeros(len(values), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    return pa.table({"sig": pa.array(values[several].view(np.int64), pa.int64()), "node": pa.array(names[several], pa.int64())})


def _sets_of(width: int, wanted):
    """(node, elements) of documents whose node is in the bit table."""

    def sets(batches):
        table_of_bits = wanted.value
        for table in _tables(batches):
            seen, nodes, elements = set(), [], []
            for x in (x for some in shingle_sets(table, width) for x in some):
                if len(x):
                    node = _node(x)
                    place = node & (1 << FILTER_BITS) - 1
                    if node not in seen and table_of_bits[place >> 3] >> (place & 7) & 1:
                        seen.add(node)
                        nodes.append(node)
                        elements.append(fp.pack(np.unique(x & np.uint64((1 << ELEMENT_BITS) - 1))))
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "elements": pa.array(elements, pa.binary())})

    return sets


def _bit_parts(numbers: DataFrame) -> DataFrame:
    """(bucket, bits): a bit per residue modulo 2 ** FILTER_BITS of column ``node``.

    At most 2 ** FILTER_BITS / 8 bytes in all, whatever the rows.
    """
    place = F.pmod("node", F.lit(1 << FILTER_BITS)) + 1  # the bitmap functions count from 1
    return (
        numbers.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )


def bit_table(numbers: DataFrame) -> bytes:
    """The bits of ``_bit_parts`` as one table."""
    out = bytearray(1 << FILTER_BITS - 3)
    for row in _bit_parts(numbers).collect():  # bounded by the size of the table
        at = (row.bucket - 1) * len(row.bits)
        out[at : at + len(row.bits)] = row.bits
    return bytes(out[: 1 << FILTER_BITS - 3])


def _allowed(a: int, b: np.ndarray, percent: int) -> np.ndarray:
    """Most differing elements of a similar pair of these sizes; negative if sizes rule it out."""
    most = (100 - percent) * (a + b) // (100 + percent)
    return np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), most, -1)


def _search(percent: int):
    """Edges between members of a group that lie in different components and may be similar.

    A found edge counts as a link at once: breadth first, so a dense group costs about as many
    comparisons as members.
    """

    def search(table: pa.Table) -> pa.Table:
        group = table.column("gid").to_numpy()
        node = table.column("node").to_numpy()
        order = np.lexsort((node, group))
        group, node = group[order], node[order]
        size = table.column("size").to_numpy()[order]
        component = table.column("component").to_numpy()[order]
        bitmap = table.column("bitmap").take(pa.array(order)).to_pylist()
        edges_at = np.flatnonzero(np.diff(group)) + 1
        limits = np.concatenate([[0], edges_at, [len(group)]])
        seen, out = set(), set()
        for low, high in zip(limits[:-1].tolist(), limits[1:].tolist()):
            if high - low < 2:
                continue
            nodes, first = np.unique(node[low:high], return_index=True)
            key = nodes.tobytes()
            if len(nodes) < 2 or key in seen:
                continue
            seen.add(key)
            at = first + low
            held = [bitmap[k] for k in at.tolist()]
            _search_group(nodes, size[at], component[at], _folded(held, min(map(len, held))), percent, out)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def _search_group(nodes, size, component, bitmap, percent, out) -> None:
    def near(k: int, others: np.ndarray) -> np.ndarray:
        differing = np.bitwise_count(bitmap[k] ^ bitmap[others]).sum(axis=1)
        return others[differing <= _allowed(int(size[k]), size[others].astype(np.int64), percent)]

    def add(k: int, j: int) -> None:
        x, y = int(nodes[k]), int(nodes[j])
        out.add((x, y) if x < y else (y, x))

    _, label = np.unique(component, return_inverse=True)
    waiting = np.ones(len(nodes), dtype=bool)
    while waiting.any():
        seed = int(np.flatnonzero(waiting)[0])
        queue = np.flatnonzero(label == label[seed]).tolist()
        waiting[queue] = False
        while queue and waiting.any():
            k = queue.pop()
            others = np.flatnonzero(waiting)
            for j in near(k, others).tolist():
                if waiting[j]:
                    add(k, j)
                    joined = np.flatnonzero((label == label[j]) & waiting)
                    waiting[joined] = False
                    queue += joined.tolist()


def _cross(percent: int):
    """One link for every two components of a group that some similar pair joins."""

    def cross(table: pa.Table) -> pa.Table:
        sets = [fp.unpack(x) for x in table.column("elements").to_pylist()]
        node, component = table.column("n").to_numpy(), table.column("component").to_numpy()
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)  # other elements are in no intersection
        column = np.full(len(count), -1)
        column[shared] = np.arange(len(shared))
        column = column[place]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        width = max(1, (8 << 20) // max(1, len(sets)))
        for low in range(0, len(shared), width):
            chosen = (column >= low) & (column < low + width)
            held = np.zeros((len(sets), min(width, len(shared) - low)), dtype=np.float32)
            held[owner[chosen], column[chosen] - low] = 1
            both += held @ held.T
        similar = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        a, b = np.nonzero(similar & (component[:, None] < component[None, :]))
        _, first = np.unique(np.stack([component[a], component[b]], axis=1), axis=0, return_index=True)
        return pa.table({"a": pa.array(node[a[first]], pa.int64()), "b": pa.array(node[b[first]], pa.int64())})

    return cross


def _verify(percent: int):
    def verify(batches):
        for batch in batches:
            rows = batch.to_pydict()
            similar = []
            for left, right in zip(rows["left"], rows["right"]):
                x, y = fp.unpack(left), fp.unpack(right)
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"a": rows["a"], "b": rows["b"], "similar": pa.array(similar, pa.bool_())})

    return verify


class _Links:
    """The search over the entries of one table of documents."""

    def __init__(self, texts: DataFrame, sets: DataFrame, entries: DataFrame, width: int, percent: int):
        self.texts, self.entries, self.width, self.percent = texts, entries, width, percent
        nodes = sets.where("node IS NOT NULL").select("node", F.col("n_shingles").cast("int").alias("size"), "bitmap").dropDuplicates(["node"])
        self.attributes = stored(nodes.join(entries.select("node").distinct(), "node", "left_semi"), "nodes")
        self.tasks = max(1, math.ceil(entries.count() / TASK_ENTRIES))

    def search(self, components_so_far: DataFrame | None, first_only: bool = False) -> DataFrame:
        """Edges that may be links and join components."""
        entries = self.entries.where(F.pmod("sig", F.lit(FIRST_SHARE)) == 0) if first_only else self.entries
        if components_so_far is None:
            entries = entries.withColumn("component", F.col("node"))
        else:
            known = components_so_far.select(F.col("node").alias("n"), F.col("component").alias("c"))
            entries = entries.join(known, F.col("node") == F.col("n"), "left")
            entries = entries.select("sig", "node", F.coalesce("c", "node").alias("component"))
        spread = entries.groupBy("sig").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")
        ).where("low < high")
        # Groups above a block are searched block against block.
        blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
        chosen = entries.join(spread.select("sig", blocks.alias("blocks")), "sig")
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64(F.col("sig"), F.least(own, k), F.greatest(own, k))
        )
        gid = F.when(F.col("blocks") == 1, F.array("sig")).otherwise(pairs)
        dealt = chosen.select("node", "component", F.explode(gid).alias("gid")).join(self.attributes, "node")
        task = F.pmod(F.xxhash64("gid"), F.lit(self.tasks)).cast("int")
        edges = dealt.withColumn("task", task).groupBy("task").applyInArrow(_search(self.percent), "a long, b long")
        return stored(edges.distinct(), "edges")

    def elements(self, edges: DataFrame) -> DataFrame:
        """The sets of the nodes on edges, from another scan of the texts."""
        needed = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        wanted = self.texts.sparkSession.sparkContext.broadcast(bit_table(needed))
        made = self.texts.select("text").mapInArrow(_sets_of(self.width, wanted), "node long, elements binary")
        return stored(made.join(needed, "node", "left_semi").dropDuplicates(["node"]), "elements")

    def verified(self, edges: DataFrame, elements: DataFrame) -> DataFrame:
        left = edges.join(elements.toDF("b", "right"), "b")
        both = left.join(elements.toDF("a", "left"), "a").select("a", "b", "left", "right")
        return stored(both.mapInArrow(_verify(self.percent), "a long, b long, similar boolean"), "judged")

    def crossing(self, edges: DataFrame, found: DataFrame, elements: DataFrame) -> DataFrame:
        """Links between components that edges, true or not, join: every pair is counted exactly."""
        near = components(edges).select(F.col("node").alias("n"), F.col("component").alias("near"))
        own = found.select(F.col("node").alias("m"), "component")
        nodes = near.join(own, F.col("n") == F.col("m"), "left").select("n", "near", F.coalesce("component", "n").alias("component"))
        mixed = nodes.groupBy("near").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
        mixed = mixed.where("low < high").select(F.col("near").alias("k"), F.ceil(F.col("members") / CROSS_MEMBERS).cast("int").alias("blocks"))
        place = F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64(F.col("near"), F.least(place, k), F.greatest(place, k))
        )
        dealt = nodes.join(mixed, F.col("near") == F.col("k")).select("n", "component", F.explode(pairs).alias("gid"))
        return dealt.join(elements, F.col("n") == F.col("node")).groupBy("gid").applyInArrow(_cross(self.percent), "a long, b long")

    def labels(self) -> DataFrame:
        """(node, component) of every node that is linked with another one."""
        edges = self.search(None, first_only=True)
        edges = edges.union(self.search(components(edges)))
        elements = self.elements(edges)
        judged = self.verified(edges, elements)
        links = judged.where("similar").select("a", "b")
        found = components(links)
        if judged.where("NOT similar").limit(1).count():
            # Every node that may have a link is on some edge, and edges join whatever may be linked.
            found = components(links.union(self.crossing(edges, found, elements)))
        return found


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, key, n_shingles, component) per document.

    ``key`` is a fingerprint of the text; ``component`` is null for sets without words, and the
    node itself where nothing is linked with it.
    """
    total, _ = text_bytes(docs, text_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    buckets = ex.bucket_count(total / BYTES_PER_SIGNATURE)
    sets = stored(texts.mapInArrow(_docs(width), DOC_SCHEMA), "sets")
    packed = texts.select("text").mapInArrow(_packed(percent, width, buckets), "bucket int, signatures binary, owners binary, nodes binary")
    entries = stored(packed.groupBy("bucket").applyInArrow(_entries_of_bucket, "sig long, node long"), "entries")
    labels = _Links(texts, sets, entries, width, percent).labels().withColumnRenamed("node", "n")
    return sets.join(labels, F.col("node") == F.col("n"), "left").select(
        "id", "key", "n_shingles", F.coalesce("component", "node").alias("component")
    )


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per document.

    The component is that of the graph whose links are all pairs with Jaccard similarity of
    at least ``percent``; its id is the least document id in it.
    """
    found = linked_sets(docs, id_col, text_col, width, percent)
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    joined = found.join(least.withColumnRenamed("component", "c"), F.col("component") == F.col("c"), "left")
    own = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of every component, the row of the least id.

    Rows that repeat an id and its text become one row.  Of equal least ids the least
    fingerprint of the text stays; a component without any id keeps one text likewise.  Texts
    without words are near to nothing and stay, repeated or not.
    """
    linked = stored(linked_sets(docs, id_col, text_col, width, percent).where("component IS NOT NULL").select("id", "key", "component"), "linked")
    order = F.struct(F.col("id").isNull(), "id", "key")  # rows with an id first
    best = linked.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    kept = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.key") == F.col("key"))
    grouped = linked.join(best, "component").select("id", "key", kept.alias("kept"))
    # Whether a row of a group with others stays: one verdict per id and text.
    verdicts = stored(grouped.groupBy("id", "key").agg(F.max("kept").alias("kept")), "verdicts")
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_of(text_col)).alias("key"))
    # Rows that a bit table of fixed size rules out of all groups are passed on without a shuffle.
    place = F.pmod("key", F.lit(1 << FILTER_BITS)) + 1
    bits = _bit_parts(verdicts.select(F.col("key").alias("node"))).withColumnRenamed("bucket", "part")
    marked = keyed.withColumn("place", place).join(F.broadcast(bits), F.bitmap_bucket_number("place") == F.col("part"), "left")
    at = F.bitmap_bit_position("place").cast("int")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    marked = marked.select("row", "id", "key", hit.alias("hit"))
    names = verdicts.toDF("i", "k", "kept")
    tested = marked.where("hit").join(names, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    once = tested.where("kept").groupBy("id", "key").agg(F.first("row").alias("row"))
    passed = marked.where("NOT hit").select("row").union(tested.where("kept IS NULL").select("row")).union(once.select("row"))
    return passed.select("row.*")


def oracle(width: int, percent: int) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(ws) - {width - 2})),
        lambda i: array_to_string(ws[i:i + {width - 1}], ' '))) AS g FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
