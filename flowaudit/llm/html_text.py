"""Operator 4: main text of HTML pages by differencing pages with near URLs."""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that end a block of text.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that the next of their kind ends; any block ends a paragraph.
ENDS_ITSELF = set("p li td th tr dd dt option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of a page, raw up to their end tag.
RAW = set("script style textarea noscript template iframe object svg math title select".split())
#: Elements that hold no main text; the second set does inside an article as well.
APART = set("nav footer aside form menu dialog button head".split())
#: Classes, ids or roles that say the same. Others that may (notice, search, share, related) are left to the differencing.
APART_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent cookie cookies footer contentinfo disqus login menu modal nav navbar navigation newsletter pagination popup promo promoted sidebar social sponsor sponsored subscribe teaser toolbar widget".split())
HEADER_WORDS = {"header", "masthead", "banner"}
MAIN_ROLES = {"main", "article", "articlebody"}
KEEP, LOOSE, DROP = 0, 1, 2
#: Until the page is read: in an article inside a marked element, and dropped by a form only.
INNER, FORM = 3, 4


def blocks(html: str) -> tuple[list[tuple[str, int]], bool]:
    """Blocks of text in page order, each kept, loose or dropped by the markup around it; is there an article?

    A void or unclosed element ends with the nearest open element that encloses it, so a stray
    tag never hides what follows its parent. Marks are whole classes, ids and roles. If the only
    articles are inside marked elements, they count; if a form holds all that nothing else
    drops, it is the page's and drops nothing.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, int]] = []                   # (tag, kind if dropped within, kind if article within)
    words: list[str] = []
    at, n, article_seen = 0, len(html), False

    def flush() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            _, drop, main = stack[-1] if stack else ("", LOOSE, LOOSE)
            out.append((text, drop if drop != LOOSE else main))

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            words.append(html[at:])
            break
        if m.start() > at:
            words.append(html[at:m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            words.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCKS and any(s[0] in BLOCKS for s in stack[k:]):
                        break                                # an inline end tag closes no block
                    del stack[k:]
                    break
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if stack and (stack[-1][0] == tag and tag in ENDS_ITSELF or stack[-1][0] == "p" and tag in BLOCKS):
            stack.pop()                                      # its end tag may be left out
        drop, main = stack[-1][1:] if stack else (LOOSE, LOOSE)
        said: set[str] = set()
        roles: set[str] = set()
        if m[3]:
            for name, a, b, c in ATTRIBUTE.findall(m[3]):
                said |= set((a or b or c).lower().split())
                roles |= {(a or b or c).lower()} if name.lower() in ("role", "itemprop") else set()
        is_main = tag in ("article", "main") or bool(roles & MAIN_ROLES)
        apart = tag in APART or bool(said & APART_WORDS) or main == LOOSE and (tag == "header" or bool(said & HEADER_WORDS))
        if tag in ("body", "html"):
            apart = False
        if is_main and not apart and main == LOOSE:
            main, drop = (KEEP, drop) if drop == LOOSE else (INNER, LOOSE)
            article_seen |= main == KEEP
        if apart and drop != DROP:
            drop = FORM if tag == "form" and not said & APART_WORDS and main == LOOSE else DROP
        stack.append((tag, drop, main))
    flush()
    kinds = {kind for _, kind in out}
    inner = DROP if article_seen else KEEP
    form = DROP if kinds & {KEEP, LOOSE, INNER} else LOOSE
    out = [(t, inner if kind == INNER else form if kind == FORM else kind) for t, kind in out]
    return out, article_seen or INNER in kinds


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of a are in a longest common subsequence of a and b."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    common = set(b[lo:len(b) - hi])
    x = [(i, h) for i, h in enumerate(a[lo:len(a) - hi], lo) if h in common]       # others align with nothing
    kept = {h for _, h in x}
    y = [h for h in b[lo:len(b) - hi] if h in kept]
    out = [True] * lo + [False] * (len(a) - lo - hi) + [True] * hi
    # best chains by their length: where each ends in y, and what it holds
    ends: list[int] = []
    chains: list[tuple | None] = []
    where: dict[int, list[int]] = {}
    for j, h in enumerate(y):
        where.setdefault(h, []).append(j)
    from bisect import bisect_left
    for i, h in x:
        for j in reversed(where[h]):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        out[link[0]] = True
        link = link[1]
    return out


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; empty where there is none."""
    try:
        s = urlsplit((url or "").strip())
        return (s.hostname or ""), s.path or "/"
    except ValueError:
        return "", ""


def main_text(pages: DataFrame, id_col: str = "row_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text): the main text of every page, blocks joined by an empty line.

    General: the project keeps no pages. A page is cut into blocks of text; character references
    are decoded, and white space inside a block is one space. Elements and class names that
    state what they are decide first: menus, headers, footers, forms, adverts and comments go,
    an article stays. All blocks of a page that has no article, and that nothing marks, are
    lines to be compared: pages of a host are put in the order of their paths, a page is paired
    with the neighbour that shares the longer beginning of the path, the lines of both are
    aligned by a longest common subsequence, and shared lines are deleted. A page whose lines
    are all shared is a copy of its neighbour and keeps them.

    Pages are dealt into ranges of (host, path, url, id); the first and last row of a range are
    compared across its border, so the neighbour is the nearest at any size. What the driver
    holds for that is two rows' line hashes a range. Texts travel once, compressed.

    Null or empty html gives an empty text. Pages of equal path pair with each other; pages with
    a null or unreadable url pair among themselves. Repeated rows and null ids come out each.
    Other columns are not read. An empty table gives an empty table.
    """
    from ..session import checkpoint

    sql, arrow = id_type(pages, id_col)
    types = pa.schema([("i", arrow), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64())),
                       ("loose", pa.bool_()), ("body", pa.binary())])

    def read(i, url, html):
        out = {"i": i, "url": url, "host": [], "path": [], "lines": [], "loose": [], "body": []}
        pack = zstandard.ZstdCompressor(level=3)
        for u, h in zip(url, html):
            found, article = blocks(h or "")
            text = [t for t, kind in found if kind == (KEEP if article else LOOSE)]
            host, path = place(u)
            out["host"].append(host)
            out["path"].append(path)
            out["lines"].append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, kind in found if kind == LOOSE])
            out["loose"].append(not article)
            out["body"].append(pack.compress("\n".join(text).encode("utf-8", "surrogatepass")))
        return out

    d = pages.select(F.col(id_col).cast(sql).alias("i"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"i {sql}, url string, host string, path string, lines array<bigint>, loose boolean, body binary"
    d = map_batches(d, read, schema, types)
    order = ["host", "path", "url", "i", F.xxhash64("lines")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    d = checkpoint(d)                                       # borders are read apart

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if len(b):
                first, last = first or b.slice(0, 1), b.slice(len(b) - 1, 1)
        if last is not None:
            yield from (first, last)

    sides: dict[int, list] = {}
    for r in d.select("part", "host", "path", "lines").mapInArrow(ends, "part int, host string, path string, lines array<bigint>").collect():
        sides.setdefault(r.part, []).append((r.host, r.path, np.array(r.lines, np.int64)))
    parts = sorted(sides)
    border = {k: (sides[x][-1] if x is not None else None, sides[y][0] if y is not None else None)
              for x, k, y in zip([None, *parts], parts, [*parts[1:], None])}
    sent = pages.sparkSession.sparkContext.broadcast(border)

    def common_start(a: str, b: str) -> int:
        n = min(len(a), len(b))
        return next((k for k in range(n) if a[k] != b[k]), n)

    def main_part(row: tuple, sides: list) -> str:
        _, _, _, host, path, own, free, body = row
        text = zstandard.ZstdDecompressor().decompress(body).decode("utf-8", "surrogatepass").split("\n")
        sides = [s for s in sides if s and s[0] == host]
        if free and own and sides:
            gone = shared_lines(own, list(max(sides, key=lambda s: common_start(path, s[1]))[2]))
            if not all(gone):
                text = [t for t, g in zip(text, gone) if not g]
        return "\n\n".join(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = row = None
        out: dict[str, list] = {"i": [], "url": [], "text": []}

        def put(after: tuple | None) -> None:
            out["i"].append(row[1])
            out["url"].append(row[2])
            out["text"].append(main_part(row, [before, after]))

        for b in (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256)):
            for new in zip(*[c.to_pylist() for c in b.columns]):
                if row is None:
                    before = sent.value[new[0]][0]
                else:
                    put(new[3:6])
                    before = row[3:6]
                row = new
            yield pa.RecordBatch.from_pydict(out, schema=kept)
            for c in out.values():
                c.clear()
        if row is not None:
            put(sent.value[row[0]][1])
            yield pa.RecordBatch.from_pydict(out, schema=kept)

    kept = pa.schema([("i", arrow), ("url", pa.string()), ("text", pa.string())])
    out = d.select("part", "i", "url", "host", "path", "lines", "loose", "body").mapInArrow(cut, f"i {sql}, url string, text string")
    return out.select(F.col("i").alias(id_col), F.col("url").alias(url_col), "text")
