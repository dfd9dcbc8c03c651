"""Periodic runs of words, found with a dictionary of basic factors.

A run is a maximal stretch of consecutive words with smallest period q and at least
``max(MIN_WORDS, MIN_POWER * q)`` words.  The dictionary names every factor of f = 1, 2, 4, ...
words; two places have the same name if and only if their f words are equal.  At level f the
distance from a place to the next one with its name (its successor) proposes a period where it
is in (f/2, f]: occurrences a, a + q, a + 2q within twice the length f form a progression.
Neighbouring places with one proposal are one run, which ends f + q - 1 words after the last of
them.  Nothing is lost: in a run of four periods every factor of f >= q words recurs after
exactly q words (a smaller distance would be a smaller period), so all its places but the last
f + q - 1 propose q.  Nothing is found twice: q has one level, and a place one successor.

A place whose name does not recur in its document cannot recur at any longer length, so levels
only keep the places that still do; ordinary prose is gone after three or four levels.

Documents stay where they are: no shuffle, memory by block of texts or one document.

Defined cases: null text: no words, no runs; a null id plants nothing; repeated rows are judged
row by row; a text of any length is one row of one task, with some 100 bytes per word; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fingerprints as fp
from .common import text_of
from .exchange import BLOCK_BYTES, text_buffer

MIN_WORDS = 6
MIN_POWER = 4
#: Levels the SQL text spells out: periods up to 2**13 words, documents up to 2**15.
SQL_LEVELS = 14

SCHEMA = (
    "id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _names_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    limits = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.arange(limits[-1]) + np.repeat(starts - limits[:-1], ends - starts)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(limits), pa.py_buffer(data[at])])
    return np.asarray(pc.dictionary_encode(words).indices).astype(np.int64)


def find_runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period.

    ``names``: the words of consecutive documents; ``first``: where each document starts, and
    where the last one ends.
    """
    none = np.zeros(0, dtype=np.int64)
    count = len(names)
    if not count:
        return none, none, none
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][document]
    longest = int(np.diff(first).max())
    places = np.arange(count)
    keys = document * (int(names.max()) + 1) + names
    found = []
    factor = 1
    while len(places):
        # Names of this level and successors, from one sort (stable: places rise within a name).
        order = np.argsort(keys, kind="stable")
        ordered, at = keys[order], places[order]
        same = ordered[1:] == ordered[:-1]
        name = np.empty(len(places), dtype=np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        recurs = np.zeros(len(places), dtype=bool)
        recurs[order[1:]] |= same
        recurs[order[:-1]] |= same
        distance = at[1:] - at[:-1]
        proposed = same & (distance <= factor) & (2 * distance > factor)
        period = np.zeros(len(places), dtype=np.int64)
        period[order[:-1][proposed]] = distance[proposed]
        # Neighbouring places with one period are one run.
        held = np.flatnonzero(period)
        if len(held):
            spot, q = places[held], period[held]
            fresh = np.ones(len(held), dtype=bool)
            fresh[1:] = (spot[1:] != spot[:-1] + 1) | (q[1:] != q[:-1])
            begin = np.flatnonzero(fresh)
            final = np.concatenate([begin[1:], [len(held)]]) - 1
            start, q = spot[begin], q[begin]
            length = spot[final] - start + factor + q
            good = length >= np.maximum(MIN_WORDS, MIN_POWER * q)
            found.append((start[good], length[good], q[good]))
        if MIN_POWER * factor >= longest:
            break
        # A factor of twice the length recurs only if both its halves do.
        where = np.full(count, -1, dtype=np.int64)
        where[places[recurs]] = name[recurs]
        left = places[recurs]
        left = left[left + 2 * factor <= end[left]]
        right = where[left + factor]
        left, right = left[right >= 0], right[right >= 0]
        keys = where[left] * len(name) + right
        places = left
        factor *= 2
    start, length, q = (np.concatenate(x) if found else none for x in (zip(*found) if found else (none, none, none)))
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _steepest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length / period, without rounding; the first of equals."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _planted(first: np.ndarray, marks: list[int | None]) -> np.ndarray:
    """Which original word stands at each place, where repeats are planted by the mark."""
    source = np.arange(int(first[-1]))
    for mark, start, stop in zip(marks, first[:-1].tolist(), first[1:].tolist()):
        n = stop - start
        if mark is None or mark % 10 or not n:
            continue
        g = mark // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[start + a : stop] = start + a + np.arange(n - a) % p
    return source


def _judge(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        data, offsets = text_buffer(table)
        ids, marks = table.column("id"), table.column("mark").to_pylist()
        rows = []
        for low, high in fp.blocks(offsets, BLOCK_BYTES):
            block = data[offsets[low] : offsets[high]]
            starts, ends, first = fp.word_spans(block, offsets[low : high + 1] - offsets[low])
            source = _planted(first, marks[low:high])
            starts, ends = starts[source], ends[source]
            start, length, period = find_runs(_names_of_words(block, starts, ends), first)
            gone = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            bounds = np.searchsorted(start, first)
            raw, s_at, e_at = block.tobytes(), starts.tolist(), ends.tolist()
            for k, (begin, stop) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                own = slice(bounds[k], bounds[k + 1])
                runs = list(zip((start[own] - begin).tolist(), length[own].tolist(), period[own].tolist()))
                listed = hashlib.sha256("".join("%d,%d,%d\n" % run for run in runs).encode())
                left = (np.flatnonzero(kept[begin:stop]) + begin).tolist()
                collapsed = hashlib.sha256(b" ".join([raw[s_at[w] : e_at[w]] for w in left]))
                best = _steepest(runs) if runs else (None, None, None)
                milli = 1000 * best[1] // best[2] if runs else None
                rows.append((len(runs), *best, milli, listed.hexdigest(), collapsed.hexdigest()))
        fields = [x.strip().split(" ") for x in SCHEMA.split(",")][1:]
        columns = {"id": ids}
        for k, (name, kind) in enumerate(fields):
            columns[name] = pa.array([row[k] for row in rows], pa.int64() if kind == "long" else pa.string())
        yield from pa.table(columns).to_batches()


def no_mark(id_col: str) -> Column:
    """Judge the texts as they are."""
    return F.lit(None).cast("bigint")


def crc_mark(id_col: str) -> Column:
    """Plant repeats by the CRC-32 of the decimal id."""
    return F.crc32(F.col(id_col).cast("string"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark=no_mark) -> DataFrame:
    """Per document: its number of runs, the run with the greatest exponent, and digests of all
    runs and of the words that are left when each run keeps its first period only.

    ``mark`` gives the number by which words are planted periodically (null: none)."""
    frame = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), mark(id_col).alias("mark"))
    return frame.mapInArrow(_judge, SCHEMA).withColumnRenamed("id", id_col)


def oracle() -> str:
    """Factors are named by 64-bit hashes; a level is a join of the one before with itself."""
    crc = """list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""
    parts = [rf"""
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor({crc}, 4294967295) AS h FROM documents),
m AS (SELECT r, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS g8 FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g8) AS p FROM m),
w AS MATERIALIZED (SELECT r, n, i, ws[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS w
    FROM (SELECT r, n, ws, planted, a, p, unnest(range(n)) AS i FROM p)),
f0 AS MATERIALIZED (SELECT r, n, i, hash(w) AS h FROM w)"""]
    for k in range(SQL_LEVELS):
        f = 1 << k
        if k:
            parts.append(f"f{k} AS MATERIALIZED (SELECT x.r, x.n, x.i, hash(x.h, y.h) AS h FROM l{k - 1} x JOIN l{k - 1} y ON y.r = x.r AND y.i = x.i + {f // 2} WHERE x.c > 1 AND y.c > 1)")
        parts.append(f"l{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY r, h) AS c, lead(i) OVER (PARTITION BY r, h ORDER BY i) - i AS q FROM f{k})")
        parts.append(
            f"s{k} AS (SELECT r, q, min(i) AS s, max(i) - min(i) + {f} + q AS len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM l{k} "
            f"WHERE q <= {f} AND 2 * q > {f}) GROUP BY r, q, isle)"
        )
    runs = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(SQL_LEVELS))
    parts.append(f"runs AS MATERIALIZED (SELECT r, s, len, q FROM ({runs}) WHERE len >= greatest({MIN_WORDS}, {MIN_POWER} * q))")
    parts.append("""
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY len::DOUBLE / q DESC, s, q) AS place FROM runs),
b AS (SELECT r, count(*)::BIGINT AS n_runs, first({'s': s, 'len': len, 'q': q}) FILTER (place = 1) AS best,
    string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM o GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT * FROM w ANTI JOIN gone USING (r, i)) GROUP BY r)""")
    return f"""WITH {", ".join(parts)}
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
    (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON b.r = t.r LEFT JOIN kept ON kept.r = t.r"""
