r"""Main text of web pages by a site style tree.

Every page is parsed once into its element tree: nodes are paths of tag and class (and position
among equal siblings, but for paragraphs and the like), the style of a node is the sequence of
its child elements with runs of equal ones merged, and leaf blocks carry text.  Trees of the same host are merged by counting, over pages:

* presentation importance of a node: the entropy of its styles, base the number of pages that
  have the node; a menu that looks the same everywhere has 0;
* content importance of a block: the entropy of its node's texts, same base, times 1 - log(pages
  with this text there) / log(pages with the node); a text that stands on every page has 0, and
  so has one of a few notices that take turns.  A text of one page only has 1.

A block's importance blends its content with its parent's presentation, so a repeated paragraph
of an otherwise varying article stays.  Blocks of low importance are removed where enough pages
of the host have the node.  Pages of a host with the same elements and texts (but for noise)
count once, so copies of an article are no template.  Fixed priors decide what a single page
tells: scripts, menus, forms and the like are noise, the article or main element is content.

The article or main element is a prior too: inside it a block falls only if it stands on most
pages of the host; outside it a block stays only if it varies over the host.  Elements that hold
less text than the clear blocks around them (teasers, cards) are no such prior.

A word in a class or id is weaker than a tag: it only lowers a block's importance, so a block
that varies over the host stays; it does not reach into an article or main element from outside,
nor does it count where the element holds most of the text it is judged in, as wrappers do.
Words for what varies by nature (advertisements, comments, related pages) are firm where they
are a whole class or id, and so is a form, landmarks inside included.  But a form around an article or
main element, or around most of the page's paragraphs, is the page's frame, and so is a firm
class around nearly all text of a page that has no other article.

The merged tree of a host is never in one place, nor is a node of it: a chunk of pages sends its
styles and texts to buckets of (node, style or text) and its nodes to buckets of the node, as
packed arrays.  The first kind of bucket answers with counts and sends one sum of styles per
node to the second kind, which answers with pages and importance.  A node or text that a whole
host shares costs an entry per chunk.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; a page
whose blocks would all fall by importance keeps those that no prior lowered, or else all that
are not noise by tag or firm word; unclosed and
misnested tags are closed as browsers do, roughly; white space is Unicode white space; repeated
rows are pages of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import fingerprints as fp
from .common import text_bytes, text_of

CHUNK_BYTES = 4 << 20
#: Bytes of html per entry of the style tree, and entries per bucket.
BYTES_PER_ENTRY = 70
BUCKET_ENTRIES = 500_000
#: Fewer pages with a node than this tell nothing about it.
LEAST_PAGES = 4
PRESENTATION_SHARE = 0.5
LEAST_IMPORTANCE = 0.15
#: What a class or id word takes from the importance, and the share of text that makes a wrapper.
CLASS_PRIOR = 0.5
#: What standing in an article or main element adds, and what standing outside it takes.
LANDMARK_PRIOR = 0.1
OUTSIDE_PRIOR = 0.4
WRAPPER_SHARE = 0.75
FIRM_SHARE = 0.9

# Elements by role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
NOISE_TAGS = {
    "head", "nav", "footer", "aside", "button", "select", "option", "dialog", "menu", "object", "applet", "svg", "canvas", "audio",
    "video", "map", "fieldset", "datalist",
}
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup "
    "modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget "
    "toolbar pagination pager skip disclaimer copyright legal tags tagcloud".split()
)
# Words for what varies from page to page; an article that is a comment or ad says so.
FIRM_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus reply replies related recommended "
    "recommendations".split()
)
OWN_WORDS = {"comment", "comments", "reply", "ad", "ads"}
LANDMARKS = {"article", "main"}
# Elements of prose; a form without any is a form and no frame of a page.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
# How much noise an element or block is; FORM and FIRM hold unless they frame the page.
CLEAR, WEAK, FORM, FIRM, OUT = 0, 1, 2, 3, 4
# Elements that stand in rows of any length; others are told apart by position.
REPEATED = {"p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "option"}
# A start tag of the key closes an open element of the values on top.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>""", re.S
)
_MARK = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VALUE_SLASH = re.compile(r"""=\s*[^\s"'][^\s"']*/\Z""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Wrapper:
    """A form or an element with a noise word: its noise, the text inside, and whether prose and
    landmarks stand inside."""

    __slots__ = ("noise", "chars", "prose", "landmark")

    def __init__(self, noise: int):
        self.noise, self.chars, self.prose, self.landmark = noise, 0, False, False


class _Element:
    __slots__ = ("tag", "path", "noise", "wrappers", "landmark", "style", "counts")

    def __init__(self, tag: str, path: str, noise: bool, wrappers: tuple[_Wrapper, ...], landmark: bool):
        self.tag, self.path, self.noise, self.wrappers, self.landmark, self.style, self.counts = tag, path, noise, wrappers, landmark, [], {}


def _words(value: str) -> list[str]:
    return re.split(r"[^a-z]+", value.lower())


def _marks(attributes: str) -> tuple[str, int, bool]:
    """(class, noise, main by role) of a start tag."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return "", CLEAR, False
    kind, noise, main = "", CLEAR, False
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            kind = value if name == "class" else kind
            if not FIRM_WORDS.isdisjoint(value.lower().split()):
                noise = max(noise, FIRM)
            elif not NOISE_WORDS.isdisjoint(_words(value)):
                noise = max(noise, WEAK)
        elif name == "role":
            main |= value == "main"
            if value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert"):
                noise = OUT
            noise = max(noise, FORM if value == "form" else CLEAR)
        elif name == "style":
            noise = OUT if _HIDDEN.search(value) else noise
        elif name == "hidden" or value.lower() == "true":
            noise = OUT
    return kind, noise, main


def _own_noise(kind: str) -> int:
    """Noise of a landmark by its own class: a name that begins with a word, as comment-body."""
    if OWN_WORDS.isdisjoint(_words(kind)):
        return CLEAR
    return WEAK if OWN_WORDS.isdisjoint(_words(name)[0] for name in kind.split()) else OUT


def parse(page: str):
    """(elements, blocks): (path, style) of every element, (path, noise, landmark, text) of every
    block in page order."""
    root = _Element("", "", False, (), False)
    stack, buffer, elements, blocks = [root], [], [], []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append((top.path, top.noise, top.wrappers, top.landmark, text))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            done = stack.pop()
            elements.append((done.path, tuple(done.style)))

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            buffer.append(page[at:])
            break
        if token.start() > at:
            buffer.append(page[at : token.start()])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if tag in INLINE and stack[-1].tag != tag:
                continue
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                close(depth)
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("br", "wbr", "img"):
            buffer.append("" if tag == "wbr" else " ")
            continue
        kind, noise, main = _marks(token[3])
        if tag in INLINE and not noise:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if token[3].endswith("/") and tag not in INLINE and tag not in ("p", "div") and not _VALUE_SLASH.search(token[3]):
            continue
        flush()
        if tag not in INLINE:
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ())):
                close(len(stack) - 1)
        top = stack[-1]
        label = f"{tag}.{kind}" if kind else tag
        if tag not in REPEATED and tag not in INLINE:
            top.counts[label] = top.counts.get(label, 0) + 1
            label += f"[{top.counts[label]}]" if top.counts[label] > 1 else ""
        if not top.style or top.style[-1] != label:
            top.style.append(label)
        if tag in LANDMARKS or tag in ("html", "body"):
            # A class names an article's subject as often as its role; only comments are told.
            noise = _own_noise(kind) if tag in LANDMARKS else CLEAR
        if tag in NOISE_TAGS or (tag == "header" and not top.landmark):
            noise = OUT
        elif tag == "form":
            noise = max(noise, FORM)
        wrappers, landmark = top.wrappers, main or tag in LANDMARKS
        if landmark or tag in PROSE:
            for wrapper in wrappers:
                wrapper.prose, wrapper.landmark = True, wrapper.landmark or landmark
        if landmark:
            wrappers = tuple(w for w in wrappers if w.noise != WEAK)
        if noise in (WEAK, FORM, FIRM):
            wrappers = (*wrappers, _Wrapper(noise))
        stack.append(_Element(tag, f"{top.path}>{label}", top.noise or noise == OUT, wrappers, top.landmark or landmark))
    close(1)
    flush()
    return elements, _judged(blocks)


def _frames(blocks: list) -> set[_Wrapper]:
    """Forms and firm wrappers that hold the page itself and so are no noise."""
    total, own_landmark, firm = 0, False, set()
    for _, out, wrappers, landmark, text in blocks:
        if not out:
            total += len(text)
            strict = [w for w in wrappers if w.noise != WEAK]
            own_landmark |= landmark and all(w.noise == FORM for w in strict)
            firm.update(strict)
            for wrapper in strict:
                wrapper.chars += len(text)
    frames = {w for w in firm if w.noise == FORM and w.prose and (w.landmark or w.chars >= WRAPPER_SHARE * total)}
    return frames | {w for w in firm if w.noise == FIRM and w.prose and not own_landmark and w.chars >= FIRM_SHARE * total}


def _judged(blocks: list) -> list:
    """Blocks with their noise; a wrapper of most of the landmark text, or of the page's text
    where it has no landmark, is none."""
    frames = _frames(blocks)
    told, chars = [], {True: 0, False: 0}
    for path, out, wrappers, landmark, text in blocks:
        out = out or any(w.noise != WEAK and w not in frames for w in wrappers)
        weak = [w for w in wrappers if w.noise == WEAK]
        told.append((path, out, weak, landmark, text))
        if not out:
            chars[landmark] += len(text)
            for wrapper in weak:
                wrapper.chars += len(text)
    most = {True: WRAPPER_SHARE * chars[True], False: math.inf if chars[True] else WRAPPER_SHARE * chars[False]}
    return [
        (path, OUT if out else WEAK if any(w.chars < most[landmark] for w in weak) else CLEAR, landmark, text)
        for path, out, weak, landmark, text in told
    ]


def _h(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))


def _host(url: str | None) -> str:
    return re.split(r"[/?#]", (url or "").partition("://")[2], maxsplit=1)[0].lower()


def _tree_entries(host: str, page: str):
    """Blocks of a page with their node keys, and its distinct (node, sub) entries.

    Sub 0 says that the page has the node; odd subs are styles, even ones texts.
    """
    elements, blocks = parse(page)
    entries = set()
    for path, style in elements:
        if style:
            node = _h(host, path)
            entries |= {(node, 0), (node, _h(*style) | 1)}
    told = []
    for path, noise, landmark, text in blocks:
        node = _h(host, path, "text")
        sub = (_h(text) & ~1) or 2
        parent = _h(host, path)
        if noise != OUT:
            entries |= {(node, 0), (node, sub)}
        told.append((node, sub, parent, noise, landmark, text))
    return told, entries


_PAGE = "chunk long, page long, url string, blocks binary, keys binary"
_BLOCK = np.dtype([("node", "<u8"), ("sub", "<u8"), ("parent", "<u8"), ("noise", "u1"), ("landmark", "?"), ("bytes", "<u4")])
_ENTRY = np.dtype([("node", "<u8"), ("sub", "<u8"), ("count", "<u4")])
_STYLES = np.dtype([("node", "<u8"), ("styled", "<f8"), ("spread", "<f8")])
_NODE = np.dtype([("pages", "<u4"), ("shown", "u1")])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _parsed(chunks: int):
    """Pages as packed blocks and entries; chunk by page, so copies spread."""

    def run(batches):
        for batch in batches:
            out = {"chunk": [], "page": [], "url": [], "blocks": [], "keys": []}
            for page, url, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                told, entries = _tree_entries(_host(url), text)
                texts = [t[5].encode("utf-8", "surrogatepass") for t in told]
                heads = np.array([(*t[:5], len(x)) for t, x in zip(told, texts)], dtype=_BLOCK)
                raw = len(told).to_bytes(4, "little") + heads.tobytes() + b"".join(texts)
                out["chunk"].append(_h(str(page), url or "") % chunks)
                out["page"].append(page)
                out["url"].append(url)
                out["blocks"].append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
                out["keys"].append(np.array(sorted(entries), dtype=np.uint64).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array(out["chunk"], pa.int64()), "page": pa.array(out["page"], pa.int64()), "url": pa.array(out["url"], pa.string()),
                 "blocks": pa.array(out["blocks"], pa.binary()), "keys": pa.array(out["keys"], pa.binary())}
            )

    return run


def _payloads(table: pa.Table, buckets: int) -> ex.Split:
    """What the pages of a chunk hold: equal for pages with the same entries on the same host."""
    return ex.Split(np.array([xxhash.xxh64_intdigest(k) for k in table.column("keys").to_pylist()], dtype=np.uint64), buckets)


def _payload_entries(buckets: int):
    return lambda table: _payloads(table, buckets).entries(ex.chunk_number(table))


def _chunk_entries(table: pa.Table, counted: np.ndarray | None = None) -> np.ndarray:
    """Distinct (node, sub) of a chunk in order, with the number of its counted pages that have them."""
    lists = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(lists), dtype=np.uint64).reshape(-1, 2)
    weight = np.ones(len(lists), dtype=np.int64) if counted is None else counted.astype(np.int64)
    weight = np.repeat(weight, [len(k) // 16 for k in lists])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), dtype=_ENTRY)
    out["node"], out["sub"] = keys[at, 0], keys[at, 1]
    out["count"] = np.diff(np.append(0, np.cumsum(weight[order]))[np.append(at, len(keys))])
    return out


def _by_bucket(entries: np.ndarray, buckets: int):
    """(bucket, places of entries): even buckets by node for nodes, odd ones by node and sub for
    the styles and texts."""
    node, sub = entries["node"], entries["sub"]
    high = np.where(sub == 0, node, fp.mix(node ^ sub * _ODD)) >> np.uint64(32)
    bucket = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64) * 2 + (sub != 0)
    order = np.argsort(bucket, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[places[0]]), places


_ANSWER = "chunk long, bucket int, entries binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    chunks, buckets, entries = zip(*rows) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "entries": pa.array(entries, pa.binary())})


def _send(payload_buckets: int, buckets: int):
    def send(pages: pa.Table, replies: pa.Table) -> pa.Table:
        if not pages.num_rows:
            return _rows([])
        # A payload counts where the first chunk has it first.
        told, first, _ = _payloads(pages, payload_buckets).apply(ex.replies_of(replies))
        entries, chunk = _chunk_entries(pages, told & first), ex.chunk_number(pages)
        return _rows([(chunk, bucket, entries[places].tobytes()) for bucket, places in _by_bucket(entries, buckets)])

    return send


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of its group of equal keys, and the first row of every group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _counts(buckets: int):
    """Counts of every style and text sent to an odd bucket, and per node the sums of its styles or
    texts for the node's bucket, as chunk -1; even buckets are passed on."""

    def counts(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() % 2 == 0:
            return table
        lists = [np.frombuffer(p, dtype=_ENTRY) for p in table.column("entries").to_pylist()]
        entries = np.concatenate(lists)
        group, first = _grouped(entries["node"], entries["sub"])
        count = np.bincount(group, weights=entries["count"])
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        told = np.split(count[group].astype(np.uint32), cuts)
        out = [(c, b, x.tobytes()) for c, b, x in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), told)]
        node = entries["node"][first]
        group, first = _grouped(node)
        sums = np.zeros(len(first), dtype=_STYLES)
        sums["node"] = node[first]
        sums["styled"] = np.bincount(group, weights=count)
        sums["spread"] = np.bincount(group, weights=count * np.log(np.maximum(count, 1)))
        bucket = ((sums["node"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) * 2
        cuts = np.flatnonzero(np.diff(bucket)) + 1  # nodes rise, and their buckets with them
        return _rows(out + [(-1, int(b[0]), x.tobytes()) for b, x in zip(np.split(bucket, cuts), np.split(sums, cuts)) if len(x)])

    return counts


def _nodes(table: pa.Table) -> pa.Table:
    """Pages and entropy of styles or texts (0 to 250) of every node sent to an even bucket."""
    rows = list(zip(*(table.column(k).to_pylist() for k in ("chunk", "bucket", "entries"))))
    asked = [(c, b, np.frombuffer(p, dtype=_ENTRY)) for c, b, p in rows if c >= 0]
    sums = np.concatenate([np.zeros(0, dtype=_STYLES), *(np.frombuffer(p, dtype=_STYLES) for c, _, p in rows if c < 0)])
    sums = np.sort(sums, order=["node", "styled", "spread"])  # sums do not depend on the order of rows
    entries = np.concatenate([np.zeros(0, dtype=_ENTRY), *(e for _, _, e in asked)])
    group, first = _grouped(entries["node"])
    node = entries["node"][first]
    pages = np.bincount(group, weights=entries["count"])
    at = np.searchsorted(node, sums["node"])
    styled = np.maximum(np.bincount(at, weights=sums["styled"], minlength=len(node)), 1)
    spread = np.bincount(at, weights=sums["spread"], minlength=len(node))
    entropy = (np.log(styled) - spread / styled) / np.log(np.maximum(pages, 2))
    answer = np.zeros(len(node), dtype=_NODE)
    answer["pages"], answer["shown"] = pages, np.round(np.clip(entropy, 0, 1) * 250)
    cuts = np.cumsum([len(e) for _, _, e in asked])[:-1]
    return _rows([(c, b, x.tobytes()) for (c, b, _), x in zip(asked, np.split(answer[group], cuts))])


def _levels(entries: np.ndarray, replies: dict[int, bytes], buckets: int) -> dict:
    """Importance (0 to 250, or 255 where too few pages tell) of the nodes and texts of a chunk."""
    count, told = np.ones(len(entries)), np.zeros(len(entries), dtype=_NODE)
    for bucket, places in _by_bucket(entries, buckets):
        if bucket % 2:
            count[places] = np.frombuffer(replies[bucket], dtype=np.uint32)
        else:
            told[places] = np.frombuffer(replies[bucket], dtype=_NODE)
    sub = entries["sub"]
    told = told[sub == 0][np.cumsum(sub == 0) - 1]  # sub 0 is the first of its node
    value = np.clip(1 - np.log(np.maximum(count, 1)) / np.log(np.maximum(told["pages"], 2)), 0, 1)
    value = np.where(count > 1, value * told["shown"] / 250, value)
    level = np.where(sub == 0, told["shown"], np.round(value * 250))
    level = np.where(told["pages"] < LEAST_PAGES, 255, level).astype(np.uint8)
    asked = sub % np.uint64(2) == 0
    return dict(zip(zip(entries["node"][asked].tolist(), sub[asked].tolist()), level[asked].tolist()))


def _texts(buckets: int):
    def texts(pages: pa.Table, replies: pa.Table) -> pa.Table:
        replies = dict(zip(replies.column("bucket").to_pylist(), replies.column("entries").to_pylist()))
        level = _levels(_chunk_entries(pages), replies, buckets) if pages.num_rows else {}
        out = [_main_text(blob, level) for blob in pages.column("blocks").to_pylist()]
        return pa.table(
            {"page": pages.column("page"), "url": pages.column("url"), "text": pa.array(out, pa.string()),
             "n_chars": pa.array([len(t) for t in out], pa.int64())}
        )

    return texts


def _main_text(blob: bytes, level: dict) -> str:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    count = int.from_bytes(raw[:4], "little")
    heads = np.frombuffer(raw, dtype=_BLOCK, count=count, offset=4)
    at = 4 + count * _BLOCK.itemsize
    blocks = []
    for node, sub, parent, noise, landmark, size in heads.tolist():
        blocks.append((node, sub, parent, noise, landmark, raw[at : at + size].decode("utf-8", "surrogatepass")))
        at += size
    content = [b for b in blocks if b[3] != OUT]
    inside, outside = (sum(len(b[5]) for b in content if b[3] == CLEAR and b[4] == landmark) for landmark in (True, False))
    important, clear = [], []
    for block in content:
        node, sub, parent, noise, landmark, text = block
        told, shown = level[node, sub], level.get((parent, 0), 255)
        blend = told if shown == 255 else (1 - PRESENTATION_SHARE) * told + PRESENTATION_SHARE * shown
        prior = LANDMARK_PRIOR if landmark else -OUTSIDE_PRIOR if inside and inside >= outside else 0.0
        prior -= CLASS_PRIOR if noise == WEAK else 0
        if prior >= 0:
            clear.append(text)
        if prior >= 0 if told == 255 else blend + 250 * prior >= 250 * LEAST_IMPORTANCE:
            important.append(text)
    return "\n\n".join(important or clear or [b[5] for b in content])


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text, n_chars) of every page."""
    total, rows = text_bytes(pages, html_col)
    chunks, buckets = max(1, math.ceil(total / CHUNK_BYTES)), max(1, math.ceil(total / BYTES_PER_ENTRY / BUCKET_ENTRIES))
    source = pages.select(F.col(page_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    by_chunk = source.mapInArrow(_parsed(chunks), _PAGE).groupBy("chunk")
    payload_buckets = ex.bucket_count(rows)
    payloads = ex.ask(by_chunk.applyInArrow(_payload_entries(payload_buckets), ex.ENTRY_SCHEMA), "first")
    sent = by_chunk.cogroup(payloads.groupBy("chunk")).applyInArrow(_send(payload_buckets, buckets), _ANSWER)
    counted = sent.groupBy("bucket").applyInArrow(_counts(buckets), _ANSWER)
    nodes = counted.where("bucket % 2 = 0").groupBy("bucket").applyInArrow(_nodes, _ANSWER)
    replies = counted.where("bucket % 2 = 1").union(nodes)
    found = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_texts(buckets), "page long, url string, text string, n_chars long")
    return found.select(F.col("page").alias(page_col), F.col("url").alias(url_col), "text", "n_chars")
