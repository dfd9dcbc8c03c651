"""Chat formatting, mixing, url filter and quality rules on small cases and odd rows."""

import hashlib
import math
import re

import pytest

from foldtrace.llm import chat, mixing, quality_rules, url_filters


def test_chat_is_read_back_whole(spark):
    odd = ["\\### Assistant: </turn> ok", "#", "##", "#\\#", "<</turn>\n</turn>\n", "### user:\n", "", None, "a\\", "é 🙂", "<\\/turn>", "x" * 5000]
    rows = [(1, k, "user" if k % 3 else "assistant", t, "x") for k, t in enumerate(odd)]
    rows += [(2, 0, None, "no role", "x"), (2, 0, None, "no role", "x"), (2, None, "a:b\n#c", "first", "x"), (None, 1, "assistant", "null id", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_conversations(frame)
    assert formatted.columns == ["conv_id", "formatted", "loss_spans"]
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [t.text for t in got[1].turns] == [t or "" for t in odd]
    assert got[1].loss_text == "".join(t or "" for k, t in enumerate(odd) if k % 3 == 0)
    assert [(t.role, t.text) for t in got[2].turns] == [("a:b\n#c", "first"), ("", "no role"), ("", "no role")]
    assert got[2].formatted.count("### ") == 2 and got[None].loss_text == "null id"
    digest = {r.conv_id: r for r in chat.digests(formatted).collect()}[1]
    told = "".join(f"{'assistant' if k % 3 == 0 else 'user'}\n{t or ''}\n" for k, t in enumerate(odd))
    assert digest.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and digest.n_turns == len(odd)
    assert chat.digests(chat.format_conversations(frame.limit(0))).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        for s in full or open_:
            out[s] = most * sizes[s] if full else weight[s] * level
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mix_reaches_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    rows = [(k, " ".join(["w"] * (1 + k % 13)), "hot" if k % 3 else f"s{k % 4}", 1, "x") for k in range(400)]
    rows += [(900, None, None, 1, "x"), (901, "", None, 1, "x"), (None, "a b", "z", 1, "x"), (902, "a b c", None, 1, "x"), (902, "a b c", None, 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target string")
    got = mixing.mix(frame).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame).collect())) and len(got) == len(rows)
    by_source = {}
    for i, t, s, *_ in rows:
        by_source.setdefault(s, []).append(len((t or "").split()))
    want = brute_targets({s: sum(x) for s, x in by_source.items()})
    source_of = {i: s for i, _, s, *_ in rows}
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert math.isclose(r.target, want[s], rel_tol=1e-9) and r.taken <= 3 * r.size and r.source_size == sum(by_source[s])
        taken[s] = taken.get(s, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= 13, (s, words, want[s])
    mixed = mixing.mixed_rows(frame)
    assert mixed.columns == [*frame.columns, "copy"] and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(frame.limit(0)).collect() == [] and mixing.mixed_rows(frame.limit(0)).collect() == []


def test_url_rules_and_reputation(spark):
    urls = ["https://a.example.com/en/1", "http://EXAMPLE.com/en/7x?y", "https://b.net/de/8", "ftp://x.example.net/de/8#z", "http://q.org/es", "http://q.org/es/",
            "https://com/en/", "notexample.com/en/7", None, "://?q", "http://h.com?x/en/", "http://notcom/en/1"]
    good = [f"https://good.example.edu/{k}" for k in range(30)]
    bad = [f"https://bad.spam.edu/{k}" for k in range(40)]
    pages = [(k, u, "x") for k, u in enumerate(urls + good + bad)]
    outcomes = [(k, u in bad) for k, u, _ in pages if u in good or u in bad]
    got = url_filters.filter_urls(
        spark.createDataFrame(pages, "page_id long, url string, host string"), spark.createDataFrame(outcomes, "page_id long, bad boolean")
    ).collect()
    by_id = {r.page_id: r for r in got}
    rules = [by_id[k].rule for k in range(len(urls))]
    assert rules == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", None, "org/es/", "com/en/", None, None, None, None, None]
    assert [by_id[k].verdict for k in range(4)] == ["block", "allow", "allow", "block"]
    assert (by_id[1].host, by_id[1].path) == ("example.com", "/en/7x") and (by_id[8].host, by_id[8].path) == ("", "")
    assert {by_id[k].verdict for k, u, _ in pages if u in good} == {"allow"} and {by_id[k].verdict for k, u, _ in pages if u in bad} == {"block"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.filter_urls(empty, spark.createDataFrame([], "page_id long, bad boolean")).collect() == []


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "x x x x", "the #1 | line\nthe #1 | line\n\nélan vital\x0b\x0cz", "of the " * 200, "one two three four " * 3 + "end",
             " ".join(f"the w{k}" for k in range(100)), "a b   c"]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(1, "", 1)]
    got = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert {r.doc_id for r in got if r.kept} == {9}
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    assert quality_rules.keep_good(frame).collect() == [(9, texts[9], 9)]


@pytest.mark.parametrize("text", ["a # b", "##", "#\\\\#", "<\\\\/turn></turn>", "#<#</turn>#"])
def test_escape_round_trip(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape("t").alias("e"), chat.unescape(chat.escape("t")).alias("u")).first()
    assert row.u == text and "##" not in row.e and "</turn>" not in row.e
