"""Main text of web pages, by nearest-URL page differencing.

Pages of a host are sorted by URL path, so that neighbours tend to come from one template. The text lines of a page are
aligned with those of its nearest neighbour by a longest common subsequence, and lines that both share belong to the
template and are deleted. A line such as a footer can be template in one part and vary in another: so lines are compared
piece by piece (between separators as "|"), and where nearly all lines that a host has at one place of its pages share a
piece with the neighbour, that place is template, and all its lines go. Markup protects what it calls the article, which
may quote passages that other pages have too, and catches what comparing cannot see: boilerplate that differs from page
to page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, cut, fresh, small_batches

# Elements and names that the web uses for what is no main text.
RAW = {"script", "style", "textarea", "title"}  # no tags inside: they end with their closing tag or the page
UNSEEN = {"noscript", "template", "iframe", "svg", "object", "select"}  # no text of the page inside, if they are closed
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "label", "fieldset", "datalist"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "adslot", "banner", "sponsor", "sponsored", "promo",
    "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie",
    "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "widget", "comment", "comments", "reply", "replies",
    "disqus", "toolbar", "pagination", "pager", "masthead", "contentinfo", "complementary", "search",
}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

_NAME_OF = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_ATTR = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none")
_SEPARATOR = re.compile(r"\s[|\u00b7\u2022\u00bb\u203a]\s")

# Inside an article only what is surely none of it: forms and their controls, and names of adverts, notices and comments,
# alone or with words of layout.
FORMS = {"nav", "form", "dialog", "menu", "head", "datalist", "button", "label"}
SURE = set("ad ads advert adverts advertisement adsense adslot sponsored gdpr consent comment comments disqus".split())
LAYOUT = set("area bar block bottom box container form inner item left list outer right section slot thread top unit wrap wrapper".split())

#: What the markup says of a line: boilerplate, nothing, part of the main element, a doubtful part of an article, part of it.
MARKED, OPEN, MAIN, DOUBT, ARTICLE = 0, 1, 2, 3, 4
#: A place is template if of ten lines that a host has there, nine share a piece with the neighbour.
SHARED_OF_TEN = 9


def tokens_of(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """The tags of a page, in time linear in its length: (start, end, kind, name, attributes).

    Kinds are "<" and "</"; comments, declarations and the content of raw elements are skipped with kind "!", raw
    elements with their name. Quotes around ``>`` count unless they never close. A tag that never ends ends the page.
    """
    at, n, quotes = 0, len(page), True
    ends: dict[str, re.Match | None] = {}  # the next end of each raw element: looked for anew only once it is passed
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if after in "!?" and after:
            comment = page.startswith("!--", start + 1)
            end = page.find("-->", start + 4) if comment else page.find(">", start)
            at = n if end < 0 else end + (3 if comment else 1)
            yield start, at, "!", "", ""
            continue
        closing = after == "/"
        named = _NAME_OF.match(page, start + 1 + closing)
        if not named:
            at = start + 1
            continue
        end = named.end()
        while quotes and (m := _QUOTE_OR_END.search(page, end)) and m[0] != ">":
            end = page.find(m[0], m.end()) + 1 or n
        if quotes:
            end = m.start() if m else -1
        if not quotes or end < 0:
            quotes, end = False, page.find(">", named.end())
        if end < 0:
            yield start, n, "!", "", ""
            return
        name, attrs = named[0].lower(), page[named.end() : end]
        at = end + 1
        if not closing and name in RAW:
            m = ends.get(name)
            if name not in ends or (m and m.start() < at):
                m = ends[name] = _RAW_END[name].search(page, at)
            # Drawings have empty ones: the reader says where to go on, or None.
            at = (yield start, m.end() if m else n, "!", name, attrs) or (m.end() if m else n)
            yield start, at, "", "", ""
            continue
        yield start, at, "</" if closing else "<", name, attrs


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), (m[2] or "").strip("\"'").lower()) for m in _ATTR.finditer(attrs)]


def _surely(value: str, sure: set[str]) -> bool:
    """Whether one of the names is that of an advert, a notice or comments, as a whole."""
    for name in value.split():
        words = {w for w in _WORD.findall(name) if not w.isdigit()}
        cookies = words & {"cookie", "cookies"} and len(words & NAMES) > 1
        if (words & sure or cookies) and words <= NAMES | LAYOUT | SURE:
            return True
    return False


def _article_level(tag: str, attributes: list[tuple[str, str]], now: int) -> int:
    """The level inside an element of an article: dropped if it surely is none of it, compared if in doubt."""
    if tag in FORMS:
        return MARKED
    level = DOUBT if tag in DROPPED else now
    if tag == "article":
        return level
    # A link or a span with such a name is a button; but code has spans that are comments.
    sure = SURE if tag in BLOCKS else NAMES - {"comment", "comments"}
    for name, value in attributes:
        if name == "style":
            if _HIDDEN.search(value):
                return MARKED
        elif name in ("hidden", "aria-hidden"):
            if value != "false":
                return MARKED
        elif name == "role":
            if value in ("navigation", "search", "menu", "toolbar"):
                return MARKED
            if set(_WORD.findall(value)) & NAMES:
                level = DOUBT
        elif name == "id" and (tag == "section" or re.fullmatch("h[1-6]", tag)):
            continue  # the name of a place in the text
        elif _surely(value, sure):
            return MARKED
        elif set(_WORD.findall(value)) & NAMES:
            level = DOUBT
    return level


def _level(tag: str, attributes: list[tuple[str, str]], now: int) -> int:
    """The level inside an element that starts at level ``now``."""
    if now >= DOUBT:
        return _article_level(tag, attributes, now)
    if now == MARKED or tag in DROPPED or tag == "header":
        return MARKED
    level = max(now, {"article": ARTICLE, "main": MAIN}.get(tag, OPEN))
    if tag not in ("html", "body", "article", "main"):
        for name, value in attributes:
            if name == "style":
                if _HIDDEN.search(value):
                    return MARKED
            elif name in ("hidden", "aria-hidden"):
                if value != "false":
                    return MARKED
            elif name == "role" and value in ("main", "article"):
                level = max(level, MAIN if value == "main" else ARTICLE)
            else:
                words = set(_WORD.findall(value))
                if words & NAMES or "header" in words:
                    return MARKED
    return level


#: The longest attributes, in characters, whose answer is kept.
REMEMBERED = 400


@lru_cache(maxsize=1 << 14)
def _inside(tag: str, attrs: str, level: int, place: int) -> tuple[int, int]:
    """The level and the place inside an element: a place is a chain of blocks and classes, whatever the page."""
    attributes = _attributes(attrs) if attrs else []
    classes = " ".join(v for n, v in attributes if n == "class")
    if tag in BLOCKS or classes:
        place = crc32(f"{tag} {classes}".encode("utf-8", "replace"), place)
    return _level(tag, attributes, level), place


#: Part of a block of text: number of the block, text, level, place.
Span = tuple[int, str, int, int]


def spans_of(page: str | None, seen: frozenset[str] = frozenset()) -> list[Span]:
    """The text of a page in order, block by block; a block has a span for each change of level or place in it.

    References are decoded. Elements named in ``seen`` are read although they are ``UNSEEN``: one of them is never
    closed on this page.
    """
    out: list[Span] = []
    if not page:
        return out
    stack: list[tuple[str, int, int]] = []
    names: Counter[str] = Counter()  # of the elements on the stack
    level, place, parts, at, block = OPEN, 0, [], 0, 0
    unseen = 0  # the length of the stack with an unseen element on its top

    def end_span() -> None:
        text = "".join(parts)
        if text and not text.isspace():
            out.append((block, entities.unescape(text), level, place))
            parts.clear()  # but white space belongs to the next span

    def end_block() -> None:
        nonlocal block
        end_span()
        parts.clear()
        block += 1

    tokens = tokens_of(page)
    for start, end, kind, tag, attrs in tokens:
        if start > at and not unseen:
            parts.append(page[at:start])
        at = end
        if kind == "!":
            if tag:
                # In drawings <title/> and <style/> are empty.
                empty = unseen and attrs.endswith("/")
                at = tokens.send(start + len(tag) + len(attrs) + 2 if empty else None)[1]
            continue
        own = stack[unseen - 1][0] if unseen else ""
        if own in ("iframe", "noscript") and not (kind == "</" and tag == own):
            continue
        if tag in BLOCKS and kind == "<" and not unseen:
            end_block()
        if tag == "br" and not unseen:
            parts.append(" ")
        if tag in VOID:
            continue
        if kind == "</":
            found = names[tag] > 0
            n = next(n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == tag) if found else -1
            if found and n < unseen - 1:
                return spans_of(page, seen | {own})  # what is around it ends first
            if found and n == unseen - 1:
                unseen = 0
            if not unseen and tag in BLOCKS:
                end_block()
            if found:
                if not unseen and stack[n][1:] != (level, place):
                    end_span()
                level, place = stack[n][1:]
                names.subtract(e[0] for e in stack[n:])
                del stack[n:]
        elif not attrs.endswith("/") or (tag in BLOCKS and not unseen):
            if tag == "p" and stack and stack[-1][0] == "p":
                _, level, place = stack.pop()
                names["p"] -= 1
            stack.append((tag, level, place))
            names[tag] += 1
            if unseen:
                continue
            if tag in UNSEEN and tag not in seen:
                unseen = len(stack)
                continue
            # Attributes may hold whole pictures: only short ones are remembered.
            inner = (_inside if len(attrs) <= REMEMBERED else _inside.__wrapped__)(tag, attrs, level, place)
            if inner != (level, place):
                end_span()
                level, place = inner
    if unseen:
        return spans_of(page, seen | {stack[unseen - 1][0]})
    parts.append(page[at:])
    end_block()
    return out


def blocks_of(spans: list[Span], dropped: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """The blocks of text left without some spans, white space made single spaces; empty blocks vanish."""
    out, last, parts = [], -1, []
    for n, (block, text, _, _) in enumerate(spans):
        if n in dropped:
            if parts and block == last:
                parts.append(" ")
            continue
        if block != last and parts:
            out.append(" ".join("".join(parts).split()))
            parts = []
        last = block
        parts.append(text)
    out.append(" ".join("".join(parts).split()))
    return [b for b in out if b]


def pieces_of(text: str) -> list[str]:
    """The pieces of a line that are compared: what stands between separators, white space made single spaces."""
    return [p for p in (" ".join(x.split()) for x in _SEPARATOR.split(text)) if p] or [""]


def common_lines(a: list[int], b: list[int], most_bits: int = 1 << 28) -> list[int]:
    """The places in ``a`` of a longest common subsequence of both.

    Lines that only one of them has are left out first, then equal ends. What stays takes one addition of numbers of
    len(b) bits for each line of ``a``, so that thousands of equal lines cost no more than others; beyond ``most_bits``
    of such numbers ``a`` is halved, and ``b`` is cut where the halves share most.
    """
    both = set(a) & set(b)
    at_a = [i for i, x in enumerate(a) if x in both]
    a, b = [a[i] for i in at_a], [x for x in b if x in both]
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner = _common(a[low : len(a) - high], b[low : len(b) - high], most_bits)
    return [at_a[i] for i in [*range(low), *(low + i for i in inner), *range(len(a) - high, len(a))]]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each start of ``a``, a number whose zero bits are the lines of ``b`` at which the common length grows."""
    full, where = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _common(a: list[int], b: list[int], most_bits: int) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in set(b) else []
    if len(a) * len(b) > most_bits:
        mid = len(a) // 2

        def lengths(a: list[int], b: list[int]) -> np.ndarray:
            *_, v = _rows(a, b)
            bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")
            return np.r_[0, np.cumsum(1 - bits[: len(b)].astype(np.int64))]

        total = lengths(a[:mid], b) + lengths(a[mid:][::-1], b[::-1])[::-1]
        j = int(total.argmax())
        return _common(a[:mid], b[:j], most_bits) + [mid + i for i in _common(a[mid:], b[j:], most_bits)]
    rows, i, j, out = list(_rows(a, b)), len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def near(path: str, other: str) -> int:
    """The length of the common start of two URL paths."""
    n = 0
    while n < len(path) and n < len(other) and path[n] == other[n]:
        n += 1
    return n


def place_of(url: str | None) -> tuple[str, str]:
    """Host (without www.) and path of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.netloc.lower().removeprefix("www."), parts.path)
    except ValueError:
        return ("", url or "")


#: How a span of a page compares with its neighbour: not at all, in a piece of it, or as a whole.
OTHER, TOUCHED, WHOLE = 0, 1, 2


def marks_of(spans: list[int], pieces: list[int], rival: list[int], n: int) -> list[int]:
    """What of ``n`` spans a rival shares; ``spans`` has the span of each piece, from 0."""
    there, shared = Counter(spans), Counter(spans[i] for i in common_lines(pieces, rival))
    return [WHOLE if shared[i] == there[i] else TOUCHED if shared[i] else OTHER for i in range(n)]


def main_text(spans: list[Span], template: set[int] | frozenset[int]) -> str:
    """What stays: all but the spans that are template (by comparison), or marked as boilerplate; articles stay."""
    gone = {n for n, s in enumerate(spans) if s[2] == MARKED or (n in template and s[2] != ARTICLE)}
    return "\n\n".join(blocks_of(spans, gone))


_OUTLINE = "host string, path string, key long, pieces array<long>, spans array<int>, places array<long>, whole long"


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Host and path of pages, hashes of all pieces of text with the span of each, and the place of each span.

    Spans that an article protects have no place. ``whole`` is a hash of all of it: equal pages are one page here.
    """
    for batch in batches:
        rows = []
        for key, url, page in zip(batch["key"], batch["url"], batch["page"]):
            pieces, owner, places = [], [], []
            for n, (_, text, level, place) in enumerate(spans_of(page)):
                for piece in pieces_of(text):
                    pieces.append(xxhash.xxh3_64_intdigest(piece.encode("utf-8", "replace")) - (1 << 63))
                    owner.append(n)
                places.append(-1 if level == ARTICLE else place)
            whole = xxhash.xxh3_64_intdigest(np.array([*pieces, *owner, *places], np.int64).tobytes()) - (1 << 63)
            rows.append((*place_of(url), key, pieces, owner, places, whole))
        yield pd.DataFrame(rows, columns=["host", "path", "key", "pieces", "spans", "places", "whole"])


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and last two different pages of a partition."""
    first, last = [], []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if not len(first) or (len(first) < 2 and row.whole != first[-1].whole):
                first.append(row)
            if not last or row.whole != last[-1].whole or row.host != last[-1].host:
                last = [*last[-1:], row]
            else:
                last[-1] = row
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rows = [(part, n, r.host, r.path, list(r.pieces), r.whole) for n, r in (*enumerate(first), *enumerate(last, 2))]
    yield pd.DataFrame(rows, columns=["part", "n", "host", "path", "pieces", "whole"])


def _carried(partitions: list[list[tuple]]) -> list[list[tuple]]:
    """The two nearest different pages ahead of each partition, nearest first; of equal pages the nearest one.

    A page that equals the nearest differs from the other one: two are enough, however many partitions copies fill.
    """
    out, near_by = [], []
    for pages in partitions:
        out.append(near_by)
        for page in pages:
            equal = near_by and (near_by[0][0], near_by[0][3]) == (page[0], page[3])
            near_by = [page, *(near_by[1:] if equal else near_by[:1])]
    return out


def compared(outlines: DataFrame) -> DataFrame:
    """(host, key, places, marks) of every page that has a different one on its host: how its spans compare with it.

    ``outlines`` are sorted by host and path over all partitions. Partitions are read in order as streams, so a host with
    a third of all pages is dealt to many tasks; the hashes of the four pages at each partition's edges pass through the
    driver to the others, over any number of partitions that copies fill.
    """
    edges: dict[int, list] = {}
    for r in outlines.mapInPandas(_edges, "part int, n int, host string, path string, pieces array<long>, whole long").collect():
        edges.setdefault(r["part"], []).append((r["n"], (r["host"], r["path"], list(r["pieces"]), r["whole"])))
    order = sorted(edges)
    ahead = _carried([[page for n, page in sorted(edges[p]) if n >= 2] for p in order])
    behind = _carried([[page for n, page in sorted(edges[p], reverse=True) if n < 2] for p in reversed(order)])
    shared = outlines.sparkSession.sparkContext.broadcast(dict(zip(order, zip(ahead, reversed(behind)))))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        columns = ["host", "key", "places", "marks"]
        before, after = shared.value.get(TaskContext.get().partitionId(), ([], []))
        waiting: list[tuple[int, str]] = []  # keys and paths of equal pages, that still wait for the next different one
        now: tuple | None = None  # such a page: host, pieces, whole, spans, places

        def settle(following: list[tuple]) -> list[tuple]:
            found: dict[int, list[int]] = {}  # by rival: copies have the same lines
            out = []
            for key, path in waiting:
                host, pieces, whole, spans, places = now
                sides = (next((r for r in side if (r[0], r[3]) != (host, whole)), None) for side in (before, following))
                rivals = [r for r in sides if r and r[0] == host]
                if rivals and places:
                    best = max(rivals, key=lambda r: near(path, r[1]))
                    if id(best) not in found:
                        found[id(best)] = marks_of(spans, pieces, best[2], len(places))
                    out.append((host, key, places, found[id(best)]))
            return out

        for batch in batches:
            done: list[tuple] = []
            for row in batch.itertuples(index=False):
                if now and (now[2], now[0]) != (row.whole, row.host):
                    done += settle([(row.host, row.path, list(row.pieces), row.whole)])
                    before, waiting, now = [(now[0], waiting[-1][1], now[1], now[2])], [], None
                now = now or (row.host, list(row.pieces), row.whole, list(row.spans), list(row.places))
                waiting.append((row.key, row.path))
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(settle(after) if now else [], columns=columns)

    return outlines.mapInPandas(compare, "host string, key long, places array<long>, marks array<int>")


def template_spans(found: DataFrame) -> DataFrame:
    """(key, template): the numbers of the spans that are template, of pages as ``compared`` gives them.

    A span is, if the neighbour shares it whole, or if its place on the host is: nine of ten spans there, of two at
    least, share a piece with the neighbour. Counting is pre-aggregated; hosts have few places that are template.
    """
    lines = found.select("host", F.explode(F.arrays_zip("places", "marks")).alias("s")).where("s.places >= 0")
    places = lines.groupBy("host", F.col("s.places").alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s.marks") > OTHER).alias("touched")
    )
    places = places.where((F.col("n") >= 2) & (10 * F.col("touched") >= SHARED_OF_TEN * F.col("n")))
    hosts = cut(places.groupBy("host").agg(F.collect_set("place").alias("bad"))).withColumnRenamed("host", "bad_host")
    # Both sides are exchanged for the join, so that a host with very many pages can be split.
    joined = found.join(hosts.hint("merge"), F.col("host") == F.col("bad_host"), "left")
    bad = F.coalesce("bad", F.array().cast("array<long>"))

    def gone(i: Column) -> Column:
        place, mark = F.get("places", i), F.get("marks", i)
        return (place >= 0) & ((mark == WHOLE) | F.array_contains(bad, place))

    each = F.when(F.size("places") > 0, F.sequence(F.lit(0), F.size("places") - 1)).otherwise(F.array().cast("array<int>"))
    rows = joined.select("key", F.filter(each, gone).alias("template")).where(F.size("template") > 0)
    return cut(rows.groupBy("key").agg(F.first("template").alias("template")))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of every page; all columns come back, a clashing ``text_col`` is replaced.

    Null and empty pages have an empty text. A null URL is a host of its own. Pages with equal text are compared with
    the nearest different page, so copies don't delete each other. Repeated rows get equal texts. A host with a single
    page is judged by its markup alone. Blocks of text stay whole where something inside them is dropped.

    What is sorted by host and path, and checkpointed, are hashes of pieces of text; pages themselves are exchanged
    once, for the join with what the comparison found, which adaptive execution can split by rows.
    """
    small_batches(pages.sparkSession)
    url, page = col(pages, url_col), col(pages, html_col)
    named = F.xxhash64(url, page)
    outlines = cut(pages.select(named.alias("key"), url.alias("url"), page.alias("page")).mapInPandas(_outlines, _OUTLINE))
    outlines = cut(outlines.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key"))
    template = template_spans(cut(compared(outlines)))
    key, found, other = fresh(pages, "html_key", "html_template", "html_other")
    template = template.select(F.col("key").alias(other), F.col("template").alias(found))
    out = pages.withColumn(key, named).join(template.hint("merge"), F.col(key) == F.col(other), "left")

    @F.pandas_udf("string")
    def text_of(page: pd.Series, found: pd.Series) -> pd.Series:
        texts = [main_text(spans_of(p), set(s) if s is not None else set()) for p, s in zip(page, found)]
        return pd.Series(texts, dtype=object)

    keep = [c for c in pages.columns if c.lower() != text_col.lower()]
    return out.select(*[col(pages, c) for c in keep], text_of(page, F.col(found)).alias(text_col))
