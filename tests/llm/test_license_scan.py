"""License scan against a plain search for phrases and a plain diagonal count."""

import random
import re
from collections import defaultdict

import pytest

from foldtrace.llm import license_scan as ls

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [w.decode() for w in WORD.findall(re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))]


def brute(doc_id, text, templates=ls.PHRASES + ls.LICENSES):
    words = words_of(text)
    base, labels, score = [], set(), 0.0
    for t in templates:
        own = words_of(t.text)
        if len(own) < 2:
            continue
        width = min(ls.WIDTH, len(own))
        grams = [own[k : k + width] for k in range(len(own) - width + 1)]
        if t.phrase:
            found = [k for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]
            base += [(k, t.label) for k in found]
            score = max(score, 1.0 if found else max((sum(words[d + k : d + k + width] == g for k, g in enumerate(grams)) / len(grams)
                                                      for d in range(-len(grams), len(words)) if len(grams) > 1), default=0.0))
            continue
        votes = defaultdict(set)
        for k in range(len(words) - width + 1):
            for at, gram in enumerate(grams):
                if words[k : k + width] == gram:
                    votes[k - at].add(at)
        isle, before = set(), None
        for diagonal in [*sorted(votes), None]:
            if diagonal is None or before is not None and diagonal - before > ls.DRIFT:
                score = max(score, len(isle) / len(grams))
                if len(isle) / len(grams) >= ls.SHARE and isle:
                    labels.add(t.label)
                isle = set()
            if diagonal is not None:
                isle |= votes[diagonal]
            before = diagonal
    starts = [k for k, _ in base]
    kinds = {label for _, label in base}
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return (doc_id, len(words), len(base), first, last, ",".join(sorted(kinds)), ",".join(sorted(kinds | labels)), score)


def odd_rows():
    dice = random.Random(2)
    texts = [None, "", " \n", "mit", "MIT License", "mit\n-license mit license", "Apache License.", "GNU General Public License, version 3",
             "mit-license apache_license general/public license", "mité license", "mit license " * 400, "general general public license license",
             "Licensed under CC BY-NC 4.0.", "licensed licensed under the apache license license version version 2 0", "x" * 9000]
    for t in ls.LICENSES:
        own = t.text.split(" ")
        for _ in range(6):
            held = list(own)
            for _ in range(dice.randint(0, len(held) // 4)):
                at = dice.randrange(len(held))
                kind = dice.choice(["put", "drop", "change"])
                held[at : at + (kind != "put")] = [] if kind == "drop" else ["other"]
            texts.append(" ".join(["before"] * dice.randint(0, 9) + held + ["after"] * dice.randint(0, 9) + dice.choice([[], own, ["MIT", "License"]])))
    rows = list(enumerate(texts))
    return rows + [(None, "mit license"), (4, "MIT License"), (4, "MIT License"), (700, "MIT License"), (701, texts[-1] + " " + texts[-2])]


@pytest.mark.parametrize("most", [100_000, 0])
def test_documents_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(ls, "MAX_TEMPLATE_GRAMS", most)
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, place int, label string")
    got = ls.scan(frame).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert {label for r in got for label in r.labels.split(",") if label} == {t.label for t in ls.PHRASES + ls.LICENSES}


def test_one_change_keeps_the_label_and_clean_text_has_none(spark):
    mit = ls.LICENSES[0].text
    rows = [(1, "Foo. " + mit.replace("free of charge", "entirely free of any charge") + " bar"), (2, "permission to publish the rights of any person"), (3, mit[: len(mit) // 3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan(frame).collect()}
    assert [got[k].labels for k in (1, 2, 3)] == ["mit", "", ""] and 0 < got[3].score < ls.SHARE < got[1].score < 1 and got[2].score == 0
    span = ls.find_licenses(frame).collect()
    assert [(r.doc_id, r.label, r.phrase, r["first"]) for r in span] == [(1, "mit", False, 9)]  # "charge to any person obtaining" is the first gram of both
    words = words_of(rows[0][1])
    assert words[span[0]["last"]] == "software" and span[0]["last"] == len(words) - 2


def test_templates_of_the_caller(spark):
    mine = (ls.Template("one", "word"), ls.Template("none", " ."), ls.Template("house", "our own house rules apply here", True))
    frame = spark.createDataFrame([(1, "word. Our own house rules apply here, our own house rules apply"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in ls.scan(frame, mine).collect()}
    assert got == {1: (12, 1, 1, 1, "house", "house", 1.0), 2: (0, 0, None, None, "", "", 0.0)}
    assert {r.doc_id: r.labels for r in ls.scan(frame, ()).collect()} == {1: "", 2: ""}
    assert ls.scan(frame.limit(0)).collect() == []
