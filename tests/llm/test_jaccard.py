"""The Jaccard join against all pairs, on small sets of many sizes."""

import random

import pytest

from foldtrace.llm import jaccard_join
from foldtrace.llm.components import components

SCHEMA = "doc_id long, text string, node long, component string"


def corpus(seed: int, words: int = 60):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(words):
        base = [dice.choice(vocabulary) for _ in range(dice.choice([1, 2, 3, 4, 5, 8, 12, 20, 45, 90, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(dice.randint(0, 6)):
            copy = list(base)
            for _ in range(dice.randint(0, max(1, len(base) // 25))):
                copy[dice.randrange(len(copy))] = dice.choice(vocabulary)
            texts.append((" \n" if dice.random() < 0.5 else " ").join(copy).upper() if dice.random() < 0.2 else " ".join(copy))
    texts += ["", None, "  ", "A b", "a B"]
    ids = [7 * i for i in range(len(texts))]
    dice.shuffle(ids)
    return [(i, t, 1, "x") for i, t in zip(ids, texts)]


def brute(rows, width, percent):
    def shingles(text):
        words = (text or "").encode().split()
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        if not words:
            return frozenset()
        return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))

    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 2, 60)])
def test_components_match_all_pairs(spark, seed, width, percent):
    rows = corpus(seed)
    got = jaccard_join.join_components(spark.createDataFrame(rows, SCHEMA), width=width, percent=percent)
    want = brute(rows, width, percent)
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len(want)


def test_null_ids_repeats_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, 0, ""), (5, text, 0, ""), (None, text, 0, ""), (9, text + " more", 0, ""), (None, None, 0, "")]
    got = jaccard_join.join_components(spark.createDataFrame(rows, SCHEMA), width=4, percent=85).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(5, 27, 5), (5, 27, 5), (None, 27, 5), (9, 28, 5), (None, 0, None)], key=repr)
    assert jaccard_join.join_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_meet_for_every_similar_pair():
    """The pigeonhole argument itself, including sets with many empty segments."""
    import numpy as np

    dice = np.random.default_rng(1)
    scheme = jaccard_join.Scheme(60)
    for _ in range(3000):
        size = int(dice.integers(1, 40))
        x = np.unique(dice.integers(0, 2**62, size, dtype=np.uint64))
        y = x[dice.random(len(x)) > dice.random() * 0.4]
        y = np.unique(np.concatenate([y, dice.integers(0, 2**62, int(dice.integers(0, 6)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 60 * (len(x) + len(y) - both):
            found, counts = scheme.signatures(np.concatenate([x, x[:0], y]), np.array([len(x), 0, len(y)]))
            assert counts[1] == 0 and len(np.intersect1d(found[: counts[0]], found[counts[0] :]))


def test_near_copies_alone_in_a_bucket():
    np = jaccard_join.np
    dice = np.random.default_rng(7)
    x = np.sort(dice.choice(2**62, 300, replace=False).astype(np.uint64))
    some = [x, x[1:]]
    found, counts = jaccard_join.Scheme(80).signatures(np.concatenate(some), np.array([300, 299]))
    owner = np.repeat(np.arange(2, dtype=np.uint16), counts)
    batch = jaccard_join._by_bucket(found, owner, np.array([11, 22]), 1 << 16)
    table = jaccard_join.pa.Table.from_batches([batch])
    got = [r for k in range(table.num_rows) for r in jaccard_join._entries_of_bucket(table.slice(k, 1)).to_pylist()]
    shared = len(np.intersect1d(found[owner == 0], found[owner == 1]))
    assert shared and sorted(r["node"] for r in got) == [11] * shared + [22] * shared


def test_long_path_is_one_component(spark):
    edges = spark.range(40).selectExpr("(id * 17) % 40 AS a", "((id + 1) * 17) % 40 AS b").where("a <> 0 OR b <> 17")
    got = components(edges.union(spark.createDataFrame([(100, 101)], "a long, b long")))
    rows = dict(map(tuple, got.collect()))
    assert got.count() == len(rows) == 42 and rows[101] == 100 and {rows[i] for i in range(40)} == {0}
