"""Page extraction, archives with their index, and decontamination on small cases."""

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from foldtrace.llm import decontaminate, html_extract, warc

PAGE = "page_id long, url string, html string, text string"


def page(k: int, body: str, host: str = "site.example") -> tuple:
    return k, f"https://{host}/{k}", body, "clash"


def test_article_and_priors(spark):
    body = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head>
      <body class="home"><header>Top</header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
      <main><article><header><h1>Head &amp; line</h1></header><p>One <b>two<br>three</b>&nbsp;&eacute;<p>Four
      <script>skip()</script>five<div class="ad">Buy</div><ul><li>a<li>b</ul><form>Mail <input></form><!-- no --></article>
      <section class="comments"><p>Nice</p></section></main><aside>Side</aside><footer>End</footer></body></html>"""
    rows = [page(1, body), (2, None, None, ""), (3, "", "", ""), page(4, "plain  text\n here"), page(5, "<p>a<p>b</div></p>c <unknown>d"), page(1, body)]
    got = html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert texts[1] == "Head & line\n\nOne two three é\n\nFour five\n\na\n\nb"
    assert texts[2] == texts[3] == "" and texts[4] == "plain text here" and texts[5] == "a\n\nb\n\nc\n\nd"
    assert html_extract.extract(spark.createDataFrame([], PAGE)).collect() == []


def test_noise_words_of_wrappers_lose_no_text(spark):
    wrapped = "<nav>Menu</nav><div class=ad>Buy</div><div class=search-box>Find</div><article><p>Main</p><div class=comments>Nice</div></article>"
    rows = [page(1, f'<body class="no-comments"><div class="site has-sidebar">{wrapped}</div>', "one.example")]
    rows += [page(2, f'<div id="page" class="header-fixed"><div class="page-with-comments">{wrapped}</div></div>', "two.example")]
    long = "much more text than all else " * 3
    rows += [page(3, f"<div class=site-header-fixed><div class=cookie-bar>We use cookies</div><p>{long}</p></div>", "three.example")]
    rows += [page(4, "<div class=top-nav>Half of it</div><div class=with-sidebar>Other half</div>", "four.example")]
    rows += [page(5, "<div class=related>Other</div><form>Mail</form><p>Plain</p>", "five.example")]
    rows += [page(6, "<nav class=has-sidebar><article>Menu</article></nav><article class=comment-body>Nice</article><main>Main</main>", "six.example")]
    for k in range(10, 30):  # the host tells: this word stands on what varies, that one on what does not
        rows.append(page(k, f"<div class=top-banner>Same</div><div class=tags-page>Own {k}</div><p>Text {k}</p>", "many.example"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[1] == got[2] == got[6] == "Main" and got[3] == long.strip() and got[5] == "Plain"
    assert got[4] == "Half of it\n\nOther half"
    assert all(got[k] == f"Own {k}\n\nText {k}" for k in range(10, 30))


def test_frames_of_a_page_lose_no_article(spark):
    long = "much more text than all else " * 3
    cases = [
        ("<form id=aspnetForm><nav>Menu</nav><article><h1>Head</h1><p>Main<form>Mail <p>Send</p></form></article></form>", "Head\n\nMain"),
        (f"<form id=f action=/x><div>{long}<p>More</p></div><input></form><footer>End</footer>", f"{long.strip()}\n\nMore"),
        (f"<div class=related><p>{long}</p></div>", long.strip()),
        (f"<div class=related><article><p>{long}</p></article></div><footer>End</footer>", long.strip()),
        (f"<main><p>Short</p></main><div class=comments><p>{long}</p></div>", "Short"),
        ("<main><p>Main</p></main><div class=related><article><p>Other</p></article></div>", "Main"),
        ("<nav>Menu</nav><article data-url=https://x.com/a/><p>Main</p></article>", "Main"),
        ('<nav>Menu</nav><section data-x="a=b"/><article><p>Main</p></article>', "Main"),
        ("<form><label>Name</label><input><button>Send</button></form>", ""),
        ("<div class=ad>Buy</div>", ""),
        (f"<nav><form><article><p>{long}</p></article></form></nav><p>Main</p>", "Main"),
        (f"<form role=form><main><p>{long}</p></main></form>", long.strip()),
    ]
    rows = [page(k, body, f"h{k}.example") for k, (body, _) in enumerate(cases)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def _tree_by_hand(pages: dict[int, list[tuple[str, str]]]) -> dict[int, list[str]]:
    """Content importance of one host's pages of (slot, text), written down from its definition;
    slots hold no elements, so they have no styles."""
    n, kept = len(pages), {}
    seen: dict[str, Counter] = {}
    for blocks in pages.values():
        for slot, text in blocks:
            seen.setdefault(slot, Counter())[text] += 1
    for k, blocks in pages.items():
        kept[k] = []
        for slot, text in blocks:
            count = seen[slot][text]
            importance = 1 - math.log(count) / math.log(n)
            if count > 1:
                importance *= -sum(c / n * math.log(c / n) for c in seen[slot].values()) / math.log(n)
            if importance >= html_extract.LEAST_IMPORTANCE:
                kept[k].append(text)
    return kept


def test_the_tree_alone_finds_the_text(spark, monkeypatch):
    """No landmark, tag or class tells anything here; templates, notices and menus go by the tree."""
    monkeypatch.setattr(html_extract, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(html_extract, "BUCKET_ENTRIES", 50)
    dice = random.Random(11)
    prose = lambda n: " ".join("".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 8))) for _ in range(n))
    rows, own, noise, by_hand = [], {}, {}, {}
    for host in range(3):
        menu, notices, rights = [prose(2) for _ in range(5)], [prose(8) for _ in range(3)], prose(6)
        pages = {}
        for k in range(host * 100, host * 100 + 40):
            blocks = [("1", menu[0]), ("2", menu[1]), ("3", menu[2]), ("4", notices[dice.choice([0, 0, 0, 0, 0, 0, 1, 2])])]
            text = [("5", prose(20)), ("6", prose(30))]
            pages[k] = blocks + text + [("7", rights)]
            rows.append(page(k, "<body>" + "".join(f"<div class=q{slot}>{words}</div>" for slot, words in pages[k]) + "</body>", f"h{host}.example"))
            own[k], noise[k] = {w for _, w in text}, {w for _, w in blocks} | {rights}
        by_hand |= _tree_by_hand(pages)
    frame = spark.createDataFrame(rows, PAGE)
    got = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(frame).collect()}
    assert got == by_hand
    right = sum(len(own[k] & set(got[k])) for k in got)
    assert right / sum(map(len, own.values())) >= 0.9 and right / sum(map(len, got.values())) >= 0.9
    batch = pa.RecordBatch.from_pydict({name: pa.array(column) for name, column in zip(("page", "url", "html"), list(zip(*rows))[:3])})
    (parsed,) = html_extract._parsed(1)([batch])
    for k, blob, keys in zip(*(parsed.column(name).to_pylist() for name in ("page", "blocks", "keys"))):  # without the tree
        nothing = {tuple(key): 255 for key in html_extract.np.frombuffer(keys, dtype="u8").reshape(-1, 2).tolist()}
        assert set(html_extract._main_text(blob, nothing).split("\n\n")) == own[k] | noise[k]


def test_style_tree_removes_what_the_host_repeats(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(html_extract, "BUCKET_ENTRIES", 10)
    dice = random.Random(4)
    prose = lambda: " ".join(dice.choice("abcdefgh") * 3 for _ in range(12))
    rows, want = [], {}
    for k in range(24):
        paragraphs = [prose() for _ in range(dice.randint(1, 5))]
        body = "".join(f"<p>{p}</p>" + ("<hr><h2>x</h2>" if dice.random() < 0.2 else "") for p in paragraphs)
        rows.append(page(k, f"<body><div>Home<p>About us</p></div><div id=c>{body}</div><div><p>All rights kept</p></div></body>"))
        want[k] = paragraphs
    rows.append(page(99, "<body><div>Home</div><p>alone</p></body>", "other.example"))
    got = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    for k, paragraphs in want.items():
        assert [t for t in got[k] if t != "x"] == paragraphs
    assert got[99] == ["Home", "alone"]  # one page tells nothing about its host


def test_landmark_is_a_prior_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "CHUNK_BYTES", 2000)
    dice = random.Random(6)
    prose = lambda: " ".join(dice.choice("abcdefgh") * 3 for _ in range(12))
    rows, want = [], {}
    for k in range(24):  # a notice in every article, a head line outside it
        own = prose()
        rows.append(page(k, f"<div>Home</div><article><div class=box>All rights</div><p>{own}</p></article><div class=x>{own[::-1]} {k}</div>"))
        want[k] = f"{own}\n\n{own[::-1]} {k}"
    for k in range(30, 50):  # articles that are cards, the main text outside
        own = prose()
        rows.append(page(k, f"<div class=text>{own}</div><article>Card {k % 2}</article>", "cards.example"))
        want[k] = own
    for k in range(60, 90):  # copies are one page
        rows.append(page(k, "<div>Home</div><article><p>Same in all copies</p></article>", "copies.example"))
        want[k] = "Same in all copies"
    rows.append(page(99, "<div>Long text around it</div><article>Card</article>", "other.example"))
    want[99] = "Long text around it\n\nCard"
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    for k in range(30, 50):  # a card on half of the pages may stay
        got[k] = got[k].split("\n\n")[0]
    assert got == want


def test_no_bucket_gathers_a_host(spark):
    np = html_extract.np
    entries = sorted(e for k in range(400) for e in html_extract._tree_entries("one.example", f"<p>Text {k}</p><p>More {k}</p>")[1])
    packed = np.zeros(len(set(entries)), dtype=html_extract._ENTRY)
    packed["node"], packed["sub"] = zip(*sorted(set(entries)))
    parts = [len(part) for _, part in html_extract._by_bucket(packed, 16)]
    assert sum(parts) == len(packed) > 800 and max(parts) < len(packed) / 8
    # The styles of a node are counted apart and summed up again.
    styles = ["<div><p>a</p></div>", "<div><p>a</p><h2>b</h2></div>", "<div><h2>b</h2></div>", "<div><h2>b</h2><p>a</p></div>"]
    seen = {0: 1, 1: 2, 2: 4, 3: 8}
    rows, told = [], None
    for k, count in seen.items():
        told, keys = html_extract._tree_entries("one.example", styles[k])
        own = np.zeros(len(keys), dtype=html_extract._ENTRY)
        own["node"], own["sub"] = zip(*sorted(keys))
        own["count"] = count
        rows += [(k, bucket, own[places].tobytes()) for bucket, places in html_extract._by_bucket(own, 16)]
    by_bucket = lambda rows: [html_extract._rows([r for r in rows if r[1] == b]) for b in sorted({r[1] for r in rows})]
    counted = [tuple(r.values()) for t in by_bucket(rows) for r in html_extract._counts(16)(t).to_pylist()]
    found = [tuple(r.values()) for t in by_bucket([r for r in counted if r[1] % 2 == 0]) for r in html_extract._nodes(t).to_pylist()]
    replies = {b: x for c, b, x in found + [r for r in counted if r[1] % 2] if c == 3}
    level = html_extract._levels(own, replies, 16)
    shares = np.array(list(seen.values())) / 15
    assert level[html_extract._h("one.example", ">div"), 0] == round(250 * -(shares * np.log(shares)).sum() / np.log(15))
    b, a = ((node, sub) for node, sub, *_ in told)
    assert level[a] == round(250 * (1 - np.log(11) / np.log(11))) and level[b] == round(250 * (1 - np.log(14) / np.log(14)))


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    monkeypatch.setattr(warc, "CAPTURES_PER_RANGE", 9)
    texts = ["same", "same", "", None, "WARC/1.1\r\n\r\nx\r\n\r\n", "é🙂" * 50, "same"] + [f"<p>{k}</p>" for k in range(30)]
    rows = [(100 - k, f"http://{'b' if k % 2 else 'a.b'}.example/{k % 5}?q#f", t, "") for k, t in enumerate(texts)]
    rows += [(None, None, "same", ""), (None, "no host\r\nx: y", "only null", ""), (94, "http://b.example/", "same", "")]
    pages = spark.createDataFrame(rows, PAGE)
    got = warc.archive_and_index(pages, f"{tmp_path}/warc").orderBy("part", "position").collect()
    assert len(got) == len(rows)
    payload = {}
    for i, _, t, _ in rows:
        payload.setdefault(t or "", []).append(i)
    for r in got:
        texts_of = {t for t, ids in payload.items() if r.page in ids and len(t.encode()) == r.bytes}
        first = min((i for t in texts_of for i in payload[t] if i is not None), default=None)
        assert (r.type == "response") == (r.page == first) and r.refers == (None if r.page == first else first)
    keys = [(r.key, r.stamp, r.page is not None, r.page or 0) for r in got]
    assert keys == sorted(keys) and len({r.part for r in got}) > 1 and len({r.file for r in got}) > 3
    empty = warc.archive_and_index(spark.createDataFrame([], PAGE), f"{tmp_path}/none")
    assert empty.collect() == []


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 16])
def test_loser_tree(count):
    dice = random.Random(count)
    runs = [sorted((dice.randint(0, 9), k) for _ in range(dice.randint(0, 8))) for k in range(count)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def brute_leaks(docs, items):
    import re

    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    out = []
    for i, text, *_ in docs:
        ws, hit, found = words(text), set(), set()
        for name, item in items:
            wanted = words(item)
            width = min(10, len(wanted))
            windows = {tuple(wanted[k : k + width]) for k in range(len(wanted) - width + 1)} if width else set()
            for k in range(len(ws) - width + 1) if width else ():
                if tuple(ws[k : k + width]) in windows:
                    hit |= set(range(k, k + width))
                    found.add(name or "")
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_leaks_match_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", bound)
    dice = random.Random(9)
    word = lambda: dice.choice(["Ab", "c1", "é", "dd", "Z", "x9"])
    items = [(f"q{k}", " ".join(word() for _ in range(n))) for k, n in enumerate([14, 10, 3, 2, 12, 11])]
    items += [("q0", items[0][1]), (None, "rare phrase"), ("none", None), ("empty", "!?"), ("q9", items[4][1])]
    docs = []
    for k in range(40):
        parts = [" ".join(word() for _ in range(dice.randint(0, 8)))]
        if dice.random() < 0.5:
            parts.append(dice.choice(items)[1] or "")
        docs.append((k, dice.choice(["; ", "\n"]).join(parts).replace(" ", dice.choice([" ", "-", "_"])), "x"))
    docs += [(50, None, "x"), (51, "", "x"), (3, docs[3][1], "x"), (None, "Rare PHRASE", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert sorted(map(tuple, decontaminate.judge(frame, bench).collect()), key=repr) == brute_leaks(docs, items)
    clean = {d[0] for d in brute_leaks(docs, items) if not d[5]}
    assert {r.doc_id for r in decontaminate.keep_clean(frame, bench).collect()} == clean
    assert not any(r.contaminated for r in decontaminate.judge(frame, bench.limit(0)).collect())
    assert decontaminate.judge(frame.limit(0), bench).collect() == []


def test_warc_dates_of_any_id_and_zone(spark, tmp_path):
    ids = [2**63 - 1, 10**15, 3 * 10**11, 2, 1, 0, -5, -(2**63)]
    pages = spark.createDataFrame([(k, "http://a.b/", f"<p>{k % 3}</p>") for k in ids], "page_id long, url string, html string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = warc.archive_and_index(pages, f"{tmp_path}/warc").orderBy("part", "position").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.page for r in got] == sorted(ids)
    assert {r.page: r.stamp for r in got}[0] == "20240101000000" and {len(r.stamp) for r in got} == {14}


def test_broadcast_windows_stay_within_their_bound(spark, monkeypatch):
    dice = random.Random(3)
    texts = [" ".join(str(dice.randrange(10**6)) for _ in range(dice.choice([1, 3, 9, 10, 40, 900]))) for _ in range(300)]
    texts += texts[:50] + ["", "- !"]
    frame = spark.createDataFrame([(str(k), text) for k, text in enumerate(texts)], "item string, text string")
    seen = []
    monkeypatch.setattr(decontaminate, "_scan_by_shuffle", lambda *_: seen.append("shuffle"))
    windows = decontaminate.WindowSet([str(k) for k in range(len(texts))], texts)
    words = [len(text.split()) for text in texts[:-1]]
    stated = sum((max(n - 9, min(n, 1))) * decontaminate.WINDOW_BYTES + len(t) + 68 for n, t in zip(words, texts))
    assert windows.size() <= stated + 10 * 1024
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", windows.size() // 4)
    decontaminate._scan(frame.selectExpr("1L AS id", "text"), frame, False, 10)
    assert seen == ["shuffle"]
    # Windows of one fingerprint are told apart by their words.
    monkeypatch.setattr(decontaminate.fp, "window_hashes", lambda hashes, width: decontaminate.np.full(max(len(hashes) - width + 1, 0), 7, "u8"))
    told = decontaminate.WindowSet(["a", "b", "c"], ["x y", "y z", "x y"])
    (_, block), = decontaminate._blocks(pa.table({"text": ["q x y z", ]}))
    assert sorted(told.hits(block)) == [(2, 1, ["a", "c"]), (2, 2, ["b"])]
