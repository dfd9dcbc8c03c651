"""The pipeline on a small corpus with planted cases, against a brute-force version."""

import random

import corpus_pipeline
from tests.llm.test_dedup import brute_words
from tests.llm.test_jaccard import brute

WORDS = "the of and to in is that for was with"


def corpus():
    dice = random.Random(11)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randint(3, 8)))
    prose = lambda n: " ".join(dice.choice(WORDS.split()) if dice.random() < 0.3 else word() for _ in range(n))
    item = " ".join(word() for _ in range(25))
    shared = " ".join(word() for _ in range(60))
    texts = [prose(dice.randint(60, 160)) for _ in range(30)]
    texts += [texts[k] for k in range(5)]  # exact copies
    for k in range(5, 10):  # near copies
        words = texts[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(70)} {shared} {prose(30)}" for _ in range(3)]
    texts += [f"{prose(60)} {item} {prose(20)}", "too short", "", None, "### $$$ " * 60, "a b c " * 60]
    rows = [(100 + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows, [("q1", item), ("q2", "only two"), ("q3", None)]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        stages[name] = [tuple(r) for r in docs.collect()]
    by_id = {r[0]: r for r in rows}
    good = {r[0] for r in stages["quality rules"]}
    assert {100 + k for k in range(44)} <= good and not good & {i for i in by_id if i > 143}
    want = {c for _, _, c in brute([by_id[i] for i in good], 5, 80)}
    assert {r[0] for r in stages["n-gram Jaccard join"]} == want and len(want) == len(good) - 10
    gone = {i: n for i, _, n, _ in brute_words([by_id[i] for i in want])}
    left = {r[0]: r for r in stages["substring dedup"]}
    assert set(left) == want
    assert sum(n > 0 for n in gone.values()) == 2
    for i, n in gone.items():
        before, after = by_id[i][1].split(), left[i][1].split()
        assert len(before) - len(after) == n and (n or left[i] == by_id[i]) and left[i][4] == len(left[i][1])
    clean = {r[0] for r in stages["benchmark decontamination"]}
    assert want - clean == {143}
    assert {r[0] for r in stages["mixing to target weights"]} <= clean
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(stages["mixing to target weights"])
