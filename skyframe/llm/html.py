"""Main text of HTML pages: host suffix arrays over all tokens of every page, checked by structure.

A page is read once as a stream of tags and texts.  Text in menus, headers,
footers, sidebars, notices, adverts, forms, comments and scripts is dropped.
Where the page has articles (or a main element), they are the main text.
All blocks of every page form its token streams: one of the blocks of its
articles that nothing speaks against, one of all others.  The streams of a host
are concatenated, each kind by itself, and substrings of at least REPEAT tokens
that occur on two distinct pages of the host are found in a suffix array.
Repeats of the second kind are boilerplate: where a page has no article, the
runs that are unique to it are kept; a block of an article that only its class
names call doubtful goes if it is repeated.  Repeats of the first kind are
mirrored articles: structure, the check that follows, keeps them.

The suffix arrays are kept by minimiser bucket (see spans.py), so a host that
holds a third of all pages is spread over all tasks.  Pages are shuffled once,
packed; beside them only the minimisers' names travel, and the strings of those
minimisers that two pages of a host have.
"""

from __future__ import annotations

import html
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import buckets, doc_key, groups_of, prefix_ranks, rows_of
from .spans import BUCKET, FLUSH, PACKED, Scheme, homes_of, merged, shared
from .spans import _ranges as found_ranges

REPEAT = 8
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Elements and words of class, id and role that mark what is not main text.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "select", "title", "audio", "video"}
_DROP = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_LEAF = {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "option"}
_BAD_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "complementary", "disqus", "footer", "gdpr",
    "header", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promotion", "replies", "reply",
    "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "topbar",
}
#: Words that mark what may be main text or not: there the host decides.
_OPEN_WORDS = {"alert", "banner", "byline", "form", "overlay", "recommended", "related", "tags", "teaser", "toolbar", "warning", "widget"}
#: What structure says about a block: main text; left open; not main text.
KEEP, OPEN, DROP = 0, 1, 2


def _flags(name: str, attrs: str) -> tuple[int, bool]:
    """(KEEP, OPEN or DROP; main): what an element's name and attributes say about it."""
    said, main = DROP if name in _DROP else KEEP, name == "main"
    if not attrs or attrs.isspace():
        return said, main
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'")).lower()
        if key in ("class", "id", "role"):
            parts = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=\d)", " ", value))
            words = set(parts)
            if words & _BAD_WORDS or "side bar" in " ".join(parts):
                said = DROP
            elif words & _OPEN_WORDS:
                said = max(said, OPEN)
            main |= key == "role" and value == "main"
        elif key == "itemprop":
            main |= value == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            said = DROP
    return said if name not in ("html", "body") else KEEP, main


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The blocks of text outside of scripts and styles, in page order, and what structure says about each of them.

    KEEP and DROP are final.  OPEN: doubtful blocks of an article, or all blocks that are not dropped if the page has neither article nor main element.
    """
    page = page or ""
    stack: list[tuple[str, int, bool, int]] = []  # open elements: name, what it says, main, number of the article around it
    places: dict[str, list[int]] = {}  # of each name in the stack
    text: list[str] = []
    out: list[tuple[int, int, bool, str]] = []  # said, article, inside main, block
    depth = [0, 0, 0]  # open elements that say KEEP, OPEN, DROP
    articles = mains = article = 0
    leaf = KEEP
    lower = None

    def close() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                out.append((max(leaf, DROP if depth[DROP] else OPEN if depth[OPEN] else KEEP), article, mains > 0, block))

    def pop() -> None:
        nonlocal article, mains
        name, said, main, article = stack.pop()
        places[name].pop()
        depth[said] -= 1
        mains -= main

    at = 0
    while True:
        start = page.find("<", at)
        if start < 0 or start > at:
            text.append(page[at : start if start >= 0 else len(page)])
            if start < 0:
                break
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if m is None:
            text.append("<")
            at = start + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            close()
            leaf = KEEP
        if name in _RAW:
            if not ends and not m[3].rstrip().endswith("/"):
                if lower is None:
                    lower = page.lower()
                    if len(lower) != len(page):
                        lower = page
                end = lower.find(f"</{name}", at)
                tail = page.find(">", end) if end >= 0 else -1
                at = tail + 1 if tail >= 0 else len(page)
            continue
        if name in _VOID:
            continue
        if ends:
            if places.get(name):
                last = places[name][-1]
                if name in _BLOCK or stack[last][1]:
                    close()
                while len(stack) > last:
                    pop()
            continue
        said, main = _flags(name, m[3])
        if name in _LEAF:
            leaf = said
            continue
        if m[3].rstrip().endswith("/") and name not in _BLOCK:
            continue
        if name == "article" and article > 0:
            said = DROP  # an article within an article is a comment
        if name in _BLOCK or said or places.get(name):
            if said:
                close()
            places.setdefault(name, []).append(len(stack))
            stack.append((name, said, main, article))
            depth[said] += 1
            mains += main
            if name == "article" and not depth[DROP]:
                articles += 1
                article = articles
    close()
    kept = [o for o in out if o[0] < DROP]
    if any(o[1] for o in kept):
        return [(said if number else DROP, block) for said, number, _, block in out]
    if any(o[2] for o in kept):
        return [(said if inside else DROP, block) for said, _, inside, block in out]
    return [(max(said, OPEN), block) for said, _, _, block in out]


def host_order(strings: list[bytes], w: int, tags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of w tokens in the order of a suffix array of each host's strings (equal tags), and the class of each of them."""
    names: dict[bytes, int] = {}
    rows = [[names.setdefault(t, len(names)) for t in s.split(b" ")] for s in strings]
    size = np.array([len(r) for r in rows])
    end = np.cumsum(size)
    rank = prefix_ranks(np.array([t for r in rows for t in r], np.int64), np.repeat(end, size), w)
    many = size - w + 1
    at = np.repeat(end - size - (np.cumsum(many) - many), many) + np.arange(many.sum())
    host = np.repeat(np.unique(np.array(tags), return_inverse=True)[1], many)
    order = np.lexsort((rank[at], host))
    r, h = rank[at][order], host[order]
    new = np.zeros(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return order, np.cumsum(new)


_PAGE = np.dtype([("key", "<i8"), ("tie", "<u4"), ("null", "u1"), ("bare", "u1"), ("rest", "<i8"), ("article", "<i8"), ("url", "<u4"), ("said", "<u4"), ("body", "<u8")])
_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
#: Place of the first token of what is not an article; articles begin at 0.
REST = 1 << 40


def _streams(said: bytes, body: bytes) -> tuple[bytes, bytes]:
    """The token streams of blocks, one a line: that of the articles and that of all else.

    A first word keeps an article apart from other blocks of equal text.
    """
    rows = list(zip(said, body.split(b"\n"), strict=True)) if said else []
    article = b"\n".join(b for what, b in rows if what == KEEP)
    return b"\x1f " + article if article else b"", b" ".join(b for what, b in rows if what != KEEP)


def _packer(n_buckets: int) -> Callable:
    """The blocks of whole pages and what structure says about them, packed by the bucket of the page."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for page_id, key, url, rest, article, body in rows_of(batches, "page_id", "doc_key", "url", "rest", "article", "body"):
            got = blocks((body or b"").decode("utf-8", "replace"))
            said, text = bytes(what for what, _ in got), "\n".join(b for _, b in got).encode()
            tie = xxhash.xxh3_64_intdigest(b"\0".join(_streams(said, text))) & 0xFFFFFFFF
            url = None if url is None else url.encode()
            yield (key, tie, page_id is None, url is None, rest, article, len(url or b""), len(said), len(text)), url or b"", said, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=6)
        for held in groups_of(each(batches), lambda r: len(r[3]) + 200, FLUSH):
            by: dict[int, list[tuple]] = {}
            for home, row in zip(homes_of(np.array([r[0][0] for r in held], np.int64), np.array([r[0][1] for r in held], np.int64), n_buckets).tolist(), held, strict=True):
                by.setdefault(home, []).append(row)
            packs = [z.compress(b"".join([struct.pack("<I", len(rows)), np.array([r[0] for r in rows], _PAGE).tobytes(), *(r[k] for k in (1, 2, 3) for r in rows)])) for rows in by.values()]
            yield pa.record_batch([pa.array(list(by), pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "packed"])

    return run


def _pages(packed: bytes) -> Iterator[tuple[tuple, bytes, bytes, bytes]]:
    """(head, url, said, blocks) of each page of a pack."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    (count,) = struct.unpack_from("<I", raw)
    heads = np.frombuffer(raw, _PAGE, count, 4)
    at, parts = 4 + heads.nbytes, []
    for column in ("url", "said", "body"):
        parts.append([])
        for size in heads[column].tolist():
            parts[-1].append(raw[at : at + size])
            at += size
    return zip(heads.tolist(), *parts, strict=True)


def _docs(packed: bytes) -> list[tuple]:
    """(doc, stream, salt, place) of the two streams of each page."""
    out = []
    for (key, tie, _, _, rest, article, *_), _, said, body in _pages(packed):
        first, other = _streams(said, body)
        out += [((key, tie), b" ".join(first.split()), article, 0), ((key, tie), other, rest, REST)]
    return [d for d in out if d[1]]


@dataclass(frozen=True)
class Streams:
    """The token streams of all pages, in packs (bucket, packed) by the bucket of the page, of n."""

    packs: DataFrame
    n: int

    def rows(self) -> DataFrame:
        """(doc_key, stream): two rows a page, its articles and all else."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.column(1).to_pylist():
                    docs = _docs(packed)
                    yield pa.record_batch([pa.array([d[0][0] for d in docs], pa.int64()), pa.array([d[1].decode() for d in docs], pa.string())], names=["doc_key", "stream"])

        return self.packs.mapInArrow(run, "doc_key long, stream string")

    def collect(self) -> list[Row]:
        return self.rows().collect()


def covered(streams: Streams, scheme: Scheme) -> tuple[DataFrame, int]:
    """What spans.covered finds in the streams, each compared with its like on one host only; and the number of buckets."""
    return shared(streams.packs, streams.n, _docs, scheme), streams.n


def _text(said: bytes, blocks: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The main text of a page of which these places of the rest are repeated."""
    if OPEN not in said:  # structure checked each block
        return b"\n".join(b for what, b in zip(said, blocks, strict=True) if what == KEEP)
    gone: set[int] = set()
    for a, b in merged(spans):
        gone.update(range(a, b))
    bare = KEEP not in said  # no article: runs are taken out of blocks; else whole blocks
    out, at = [], 0
    for what, b in zip(said, blocks, strict=True):
        if what == KEEP:
            out.append(b)
            continue
        words = b.split()
        kept = [w for i, w in enumerate(words, at) if i not in gone] if what == OPEN else []
        at += len(words)
        if what == OPEN and (len(kept) == len(words) or not bare and 2 * len(kept) > len(words)):
            out.append(b)
        elif kept and bare:
            out.append(b" ".join(kept))
    return b"\n".join(out)


def _joined(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every page of a bucket with the ranges of its streams."""
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for packed in right.column("packed").to_pylist():
        rows = found_ranges(packed)
        for key, tie, a, b in rows[rows[:, 2] >= REST].tolist():  # repeats of articles are mirrors, which stay
            spans.setdefault((key, tie), []).append((a - REST, b - REST))
    out: list[tuple] = []
    for packed in left.column("packed").to_pylist():
        for (key, tie, null, bare, *_), url, said, body in _pages(packed):
            text = _text(said, body.split(b"\n") if said else [], spans.get((key, tie), []))
            out.append((None if null else key, None if bare else url.decode(), text.decode()))
    return pa.table([pa.array([o[k] for o in out], f.type) for k, f in enumerate(_TEXT)], schema=_TEXT)


def main_text(pages: DataFrame, repeat: int = REPEAT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    White space inside a block is one space and blocks are joined by a line
    feed; all articles of a page are kept.  A null or empty page, or one without
    main text, has an empty text.  A null url is a host of its own; a null id
    counts as the smallest; rows that repeat a page are that page, each
    returned.  Other columns are ignored.

    Pages are read and shuffled once, packed; all later steps take them from there.
    """
    url, body = F.col(url_col), F.col(html_col).cast("binary")
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    salt = {kind: F.xxhash64(F.concat(F.lit(f"{kind} "), host)).alias(kind) for kind in ("rest", "article")}
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), doc_key(id_col).alias("doc_key"), url.alias("url"), salt["rest"], salt["article"], body.alias("body"))
    n = max(buckets(pages.sparkSession, 4), (pages.agg(F.sum(F.octet_length(body))).first()[0] or 0) // BUCKET)
    packs = rows.mapInArrow(_packer(n), PACKED)
    found, _ = covered(Streams(packs, n), Scheme("word", repeat, max(1, repeat - 3), pages=True, order=host_order))
    out = packs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_joined, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
