"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldtrace.llm import periodic_runs


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[k] == words[k + q] for k in range(len(words) - q)))


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        k = 0
        while k + q < len(words):
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            length = k + q - start
            if length >= max(6, 4 * q) and smallest_period(words[start : start + length]) == q:
                found.append((start, length, q))
    return sorted(found)


def brute_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=5))
def test_runs_of_random_words(documents):
    first = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    names = np.array([w for d in documents for w in d], dtype=np.int64)
    want = [(s + int(first[k]), length, q) for k, d in enumerate(documents) for s, length, q in brute_runs(d)]
    assert list(zip(*(x.tolist() for x in periodic_runs.find_runs(names, first)))) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.integers(2, 9), st.integers(0, 29), st.lists(st.integers(0, 3), max_size=9))
def test_runs_of_planted_periods(root, times, more, around):
    words = [*around, *root * times, *root[: more % len(root)], *around]
    got = periodic_runs.find_runs(np.array(words, dtype=np.int64), np.array([0, len(words)]))
    assert list(zip(*(x.tolist() for x in got))) == brute_runs(words)


def odd_rows():
    dice = random.Random(4)
    rows = [(k, t) for k, t in enumerate([None, "", " \t\n", "a", "x " * 500, "a b " * 40, "a a b " * 33 + "c", "é\x0bé\x0cé é é é", "a\x1ca a\x1ca " * 4])]
    for k in range(20, 320):
        words = [dice.choice("abc") * dice.randint(1, 2) for _ in range(dice.randint(0, 60))]
        root = [dice.choice("abcdefgh") for _ in range(dice.randint(1, 12))]
        rows.append((k, dice.choice([" ", "\n"]).join(words + root * dice.randint(0, 7) + words[:5])))
    rows += [(None, "x " * 9), (9, "same words"), (9, "same words"), (-10, " ".join(f"w{i}" for i in range(3000)))]
    return rows


@pytest.mark.parametrize("block", [300, 512 << 10])
def test_documents_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK_BYTES", block)
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, period int, id string")
    got = periodic_runs.detect(frame, mark=periodic_runs.crc_mark).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    plain = periodic_runs.detect(frame).collect()
    assert sorted(map(tuple, plain), key=repr) == sorted((brute_row(*r, plant=False) for r in rows), key=repr)
    assert periodic_runs.detect(frame.limit(0)).collect() == []


def test_a_long_text_is_whole(spark):
    words = [f"w{k}" for k in range(50_000)]
    text = " ".join(["start", *words * 5, "end"])
    got = periodic_runs.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_runs, got.start, got.length, got.period) == (1, 1, 250_000, 50_000)
    assert got.collapsed_sha256 == hashlib.sha256(" ".join(["start", *words, "end"]).encode()).hexdigest()
