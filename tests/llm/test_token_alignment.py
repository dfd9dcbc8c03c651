"""Alignment of two tokenizers against whole texts, all token pairs compared."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from foldtrace.llm import token_alignment as ta

pytestmark = pytest.mark.skipif(not Path(ta.TOKENIZERS, ta.PIECES).exists(), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def tokenizers():
    return ta.Tokenizers(*(Path(ta.TOKENIZERS, name).read_bytes() for name in (ta.BYTE_LEVEL, ta.PIECES)))


def brute_document(tokenizers, text):
    """Ids, groups and links of the whole text, or None."""
    if not text:
        return None
    ids_a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    ids_b = tokenizers.b.encode(text)
    spans = []
    for ids, table in ((ids_a, tokenizers.bytes_a), (ids_b, tokenizers.bytes_b)):
        parts = [table[k] for k in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        ends = [0]
        for part in parts:
            ends.append(ends[-1] + len(part))
        spans.append(list(zip(ids, ends, ends[1:])))
    links = [(a, b) for a, a0, a1 in spans[0] for b, b0, b1 in spans[1] if a0 < b1 and b0 < a1]
    common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups = [([i for i, s, e in spans[0] if low <= s and e <= high], [i for i, s, e in spans[1] if low <= s and e <= high])
              for low, high in zip([0, *common], common)]
    return ids_a, ids_b, groups, links


def brute_rows(tokenizers, rows):
    done = [(i, brute_document(tokenizers, t)) for i, t in rows]
    counts = Counter(link for _, d in done if d for link in d[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, d in done:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, links = d
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd_rows():
    dice = random.Random(8)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b\t c", "\n\n\nx", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'M",
             "▁x", "a ▁b c", "x y z　w", "\x1c a \x1d", "naïve café déjà-vu", "日本語のテキスト 二つ目", "🙂 👩‍👩‍👧 ok", "a" * 300 + " b",
             "\x00 nul", "١٢٣ ४५६", "tab\tbed  two   three    spaces", "é e", "​zero", "price: $1,234.56!!! (100%)", "http://a.b/c?d=e&f"]
    alphabet = [" ", " ", "  ", "\n", "a", "B", "é", "本", "'s", "7", "...", " ", "<s>", "ing", "the", "🙂"]
    texts += ["".join(dice.choice(alphabet) for _ in range(dice.randint(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts))
    return rows + [(None, "null id"), (5, "again again"), (5, "again again"), (900, " ".join(f"word{k}" for k in range(300)))]


@pytest.mark.parametrize("slices", [10**6, 50])
def test_documents_match_brute_force(spark, tokenizers, monkeypatch, slices):
    monkeypatch.setattr(ta, "SLICE_PAIRS", slices)
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, pair int")
    got = ta.align_corpus(frame).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_rows(tokenizers, rows), key=repr)
    assert sum(r.n_a > 0 for r in got) > 150 and sum(r.n_best < r.n_links for r in got) > 50


def test_empty_table(spark):
    assert ta.align_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prose_of_the_given_documents(spark, tokenizers):
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no documents here")
    docs = spark.read.parquet(str(path)).where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ta.align_corpus(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_rows(tokenizers, rows), key=repr)


def test_units_are_the_whole_text(tokenizers):
    assert tokenizers.cuttable
    for _, text in odd_rows():
        units = tokenizers.units_of(text or "")
        assert " ".join(units) == (text or "")
        ids_a, ids_b = tokenizers.encode(units)
        assert sum(ids_a, []) == tokenizers.a.encode(" " + (text or ""), add_special_tokens=False).ids or not text
        assert sum(ids_b, []) == tokenizers.b.encode(text or "")


def test_a_long_text_is_cut_where_it_may(spark, tokenizers):
    text = " ".join(f"w{k} and" for k in range(60_000))
    row = ta.align_corpus(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_a == len(tokenizers.a.encode(" " + text, add_special_tokens=False).ids) and row.n_b == len(tokenizers.b.encode(text))


def test_dictionary_of_most_linked_ids(spark, tokenizers):
    frame = spark.createDataFrame([(1, "the cat the cat the dog")], "doc_id long, text string")
    best = {(r.id_b, r.id_a): r["count"] for r in ta.most_linked(frame).collect()}
    (a,), (b,) = tokenizers.a.encode(" the").ids, tokenizers.b.encode("the")
    assert best[b, a] == 3


def test_units_are_kept_over_a_quarter_of_a_million_others():
    from foldtrace.llm.token_alignment import Kept

    kept = Kept()
    for k in range(250_000):
        kept.put(f"unit{k}", (k,))
    assert kept.get("unit0") == (0,)
