"""Substring and suffix dedup against brute force, with small chunks and buckets."""

import hashlib
import random

import pytest

from foldtrace.llm import exchange, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, source string, id long, chunk string"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 700)
    monkeypatch.setattr(exchange, "BUCKET_ENTRIES", 40)
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 300)
    monkeypatch.setattr(exchange.ordered_chunks, "__defaults__", ("doc_id", "text", False, 700))


def corpus(seed: int = 3):
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdé") for _ in range(dice.randint(1, 6)))
    passages = [" ".join(word() for _ in range(dice.randint(14, 40))) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(dice.randint(0, 30)))]
        for _ in range(dice.randint(0, 3)):
            parts += [dice.choice(passages), " ".join(word() for _ in range(dice.randint(0, 10)))]
        texts.append(dice.choice([" ", "\n", "\t \r\n"]).join(parts))
    texts += texts[:6] + ["", None, "  \n ", "one two", "x " * 400, "ab" * 300, " ".join("ab" for _ in range(40))]
    ids = list(range(0, 3 * len(texts), 3))
    dice.shuffle(ids)
    rows = list(zip(ids, texts))
    rows.append((None, passages[0]))
    rows.append(rows[4])  # a repeated row
    return [(i, t, "s", 7, "clash") for i, t in rows]


def brute_words(rows, width=13):
    order = lambda i: (i is not None, i or 0)
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    low = {}
    for i, ws in words:
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            low[key] = min(low.get(key, order(i)), order(i))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - width + 1):
            if low[tuple(ws[k : k + width])] < order(i):
                gone |= set(range(k, k + width))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, width=100):
    texts = sorted(((i, (t or "").encode()) for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    seen, out = set(), []
    for i, data in texts:
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            if data[k : k + width] in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(data[k : k + width])
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_covers_have_every_difference():
    for module in (substring_dedup, suffix_dedup):
        assert {(a - b) % module.PERIOD for a in module.COVER for b in module.COVER} == set(range(module.PERIOD))


def test_word_windows_match_brute_force(spark, small):
    rows = corpus()
    got = substring_dedup.dedup_words(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_words(rows), key=repr)
    assert sum(r.n_removed for r in got) > 500


def test_byte_strings_match_brute_force(spark, small):
    rows = corpus(5)
    got = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_bytes(rows), key=repr)
    assert sum(r.n_spans for r in got) > 20


@pytest.fixture(scope="module")
def uneven():
    """Ids with a gap, long documents in a row, many rows without id, of one id, and all equal."""
    dice = random.Random(11)
    word = lambda: "".join(dice.choice("abcdé") for _ in range(dice.randint(1, 6)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(4)]
    text = lambda n: " ".join([*(word() for _ in range(n)), dice.choice(passages)])
    rows = [(k, text(10)) for k in range(60)] + [(10**12 + k, text(10)) for k in range(60)] + [(10**6 + k, text(150)) for k in range(9)]
    rows += [(None, text(10)) for _ in range(40)] + [(7, text(10)) for _ in range(40)] + [(10**12 + 70, passages[0])] * 40
    return [(*r, "s", 0, "") for r in rows]


def test_chunks_are_bounded(spark, small, uneven):
    chunks, total, together = exchange.ordered_chunks(spark.createDataFrame(uneven, SCHEMA))
    held = {}
    for r in chunks.collect():
        held.setdefault(r.chunk, []).append(r)
    assert sum(map(len, held.values())) == len(uneven) and together > 1
    assert all(len(rows) == 1 or sum(len(r.text.encode()) for r in rows) <= 3 * 700 for rows in held.values())
    low = lambda r: -1 if r.id is None else r.id
    order = [sorted(map(low, held[k])) for k in sorted(held)]
    assert all(a[-1] <= b[0] for a, b in zip(order, order[1:]))
    whose = {}
    for k, rows in held.items():
        for r in rows:
            whose.setdefault(r.id, set()).add(k // together)
    assert all(len(ranks) == 1 for ranks in whose.values())


def test_uneven_words_match_brute_force(spark, small, uneven):
    got = substring_dedup.dedup_words(spark.createDataFrame(uneven, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_words(uneven), key=repr)


def test_uneven_bytes_keep_one(spark, small, uneven):
    rows = [r for r in uneven if r[0] not in (None, 7)]  # the order of many rows of one id is by hash
    got = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_bytes(rows), key=repr)


def test_kept_texts(spark, small):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"a\n{passage}\nb", "s", 0, ""), (2, f"c  d\n{passage}\n\ne f", "s", 0, ""), (3, None, "s", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.row.doc_id: r for r in substring_dedup.dedup_texts(docs).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "c  d\ne f" and got[3].kept_text == ""
    assert got[2].row.chunk == "" and got[2].n_removed == 20
    runs = spark.createDataFrame([(1, "x" * 150), (2, "x" * 120)], "doc_id long, text string")
    left = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_byte_texts(runs).collect()}
    assert left == {1: b"x", 2: b""}  # a run covers itself from its second byte on


@pytest.mark.parametrize("run", [substring_dedup.dedup_words, suffix_dedup.dedup_bytes])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
