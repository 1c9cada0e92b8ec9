"""Main text of web pages: block rules, then differencing against the pages of nearest URL.

A page is cut into lines (the text of one block each). Markup that names a part (navigation,
header, form, comments ...) drops it; an article or main element holds the text where there
is one. A page is aligned, by longest common subsequence of lines, with the page of its host
whose URL path is next to its own, and shared lines are deleted: all of them on a page without
such an element, and inside an article those of parts whose class or id may or may not mean
boilerplate (share, related, tags ...). Plain lines of an article are its own even if another
page has them too."""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillgraph.llm._spark import by_value, let

by_value(__name__)
OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
#: Elements of which nothing is text; each ends at its own end tag.
RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in "script style noscript template svg textarea iframe title".split()}
#: Elements whose text stays on the line of the text around it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text, wherever they stand.
BOILER = frozenset("nav aside form footer button select option menu dialog head".split())
#: Words in class, id or role that name such a part.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer "
    "gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion "
    "sidebar sidebars signup sponsor sponsored subscribe".split()
)
#: Words that name boilerplate on one site and article parts on another: there the neighbouring pages decide.
UNSURE = frozenset("form overlay related respond search share sharing skip social tags toolbar widget widgets".split())
MAIN = frozenset(("article", "main"))


#: What holds a line: boilerplate markup, nothing in particular, an article or main element, an unsure part of one.
DROPPED, NEUTRAL, ARTICLE, PART = 0, 1, 2, 3
Line = tuple[str, int]


class _Stack:
    """Open elements, with counts of all that is asked about them, so that no question walks the stack."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, bool]] = []  # element, drops its text, is an article, is unsure
        self.names: Counter[str] = Counter()
        self.marked: Counter[str] = Counter()
        self.drops = self.articles = self.parts = 0
        self.blocks: list[int] = []  # places of the elements that are not inline

    def push(self, name: str, drops: bool, article: bool, part: bool) -> None:
        if name not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((name, drops, article, part))
        self._count(1, name, drops, article, part)

    def _count(self, n: int, name: str, drops: bool, article: bool, part: bool) -> None:
        self.names[name] += n
        self.drops += n * drops
        self.articles += n * article
        self.parts += n * part
        if drops or part:
            self.marked[name] += n

    def close(self, name: str) -> None:
        """Closes the innermost ``name`` and all that it holds; nothing if none is open."""
        while self.names[name]:
            top = self.open.pop()
            self._count(-1, *top)
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            if top[0] == name:
                return

    def in_paragraph(self) -> bool:
        """The innermost element that is not inline is a paragraph."""
        return bool(self.blocks) and self.open[self.blocks[-1]][0] == "p"

    def holds(self) -> int:
        return DROPPED if self.drops else (PART if self.parts else ARTICLE) if self.articles else NEUTRAL


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, element, attributes) of the markup in order; element is '' for markup that is no tag.

    The page is read forwards once. A "<" after which no ">" comes is text, and once a tag's
    quotes do not close, tags end at their first ">"."""
    at, last, quoted = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif at > last:
            return
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield at, end, False, "", ""
        elif m := OPEN.match(page, at):
            begin, end = m.end(), m.end()
            while quoted:
                stop = STOP.search(page, end)
                if stop is None or (page[stop.start()] != ">" and (end := page.find(page[stop.start()], stop.end()) + 1) == 0):
                    quoted = False
                elif page[stop.start()] == ">":
                    end = stop.start()
                    break
            if not quoted:
                end = page.find(">", begin)
            name, attributes = m[2].lower(), page[begin:end]
            end += 1
            if not m[1] and name in RAW and not attributes.endswith("/"):
                closing = RAW[name].search(page, end)
                end, name = closing.end() if closing else len(page), ""
            yield at, end, bool(m[1]), name, attributes
        else:
            at += 1
            continue
        at = end


def lines(page: str | None) -> list[Line]:
    """The non-empty lines of a page in order, each with what holds it. The work grows with the page's length."""
    out: list[Line] = []
    stack = _Stack()
    text: list[str] = []
    page = page or ""

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((line, stack.holds()))

    at = 0
    for start, end, closes, name, attributes in _tags(page):
        if start > at:
            text.append(entities.unescape(page[at:start]))
        at = end
        if not name:
            continue
        opens = not closes and name not in VOID and not attributes.endswith("/")
        drops = part = False
        if opens:
            inside = stack.articles > 0
            marks = _marks(attributes) - ({"header"} if inside else set())
            drops = name in BOILER or (name == "header" and not inside) or (bool(marks & MARKS) if name not in ("html", "body", *MAIN) else bool(marks & {"comment", "comments"}))
            part = not drops and name not in MAIN and bool(marks & UNSURE)
        if name not in INLINE or drops or part or (closes and stack.marked[name]):
            flush()
        if closes:
            stack.close(name)
        elif opens:
            if name == "p" and stack.in_paragraph():  # a paragraph ends the one before it
                stack.close("p")
            stack.push(name, drops, name in MAIN and not drops, part)
    if at < len(page):
        text.append(entities.unescape(page[at:]))
    flush()
    return out


def _marks(attributes: str) -> set[str]:
    if not attributes:
        return set()
    return {w for m in ATTRIBUTE.finditer(attributes) for w in NAME.findall((m[2] or m[3] or m[4] or "").lower())}


def unshared(own: list[str], other: list[str]) -> list[bool]:
    """Which lines of ``own`` a longest common subsequence with ``other`` leaves out.

    Common heads and tails are taken first; what remains is aligned bit-parallel."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    present = set(b)
    places = [i for i, line in enumerate(a) if line in present]
    a, wanted = [a[i] for i in places], set(a)
    b = [line for line in b if line in wanted]
    left = [True] * len(own)
    left[:head] = [False] * head
    if tail:
        left[-tail:] = [False] * tail
    for i in _common(a, b):
        left[head + places[i]] = False
    return left


#: Bits of alignment rows that are kept at a time (8 MB); longer pairs are halved.
KEPT_BITS = 1 << 26


def _rows(a: list[str], b: list[str], keep: bool) -> list[int]:
    """Rows of the alignment of ``a`` with ``b``: bit j of row i is 0 where the common length of
    a[: i + 1] and b[: j + 1] exceeds that of a[: i + 1] and b[:j]. All rows, or the last alone."""
    masks: dict[str, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    out = []
    for line in a:
        met = row & masks.get(line, 0)
        row = (row + met | row - met) & full
        if keep:
            out.append(row)
    return out if keep else [row]


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """The common length of ``a`` with each prefix of ``b``."""
    row, out = _rows(a, b, False)[0], [0]
    for c in format(row, f"0{max(1, len(b))}b")[::-1][: len(b)]:
        out.append(out[-1] + (c == "0"))
    return out


def _common(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``; memory grows with the sum of both, not the product."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > KEPT_BITS:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: (left[j] + right[len(b) - j], -j))
        return _common(a[:half], b[:cut]) + [half + i for i in _common(a[half:], b[cut:])]
    rows, found = _rows(a, b, True), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
    return found[::-1]


def main_text(page: list[Line], other: list[Line] | None) -> str:
    """The page's lines without boilerplate markup and without those that it shares with ``other``.

    In an article or main element the plain lines stay, shared or not (a quoted passage, a copy),
    and a line of an unsure part stays if ``other`` does not share it; beside such an element no
    line is the article's. A page without one keeps what is not shared; if all its lines are
    shared it is a copy of the other and keeps them."""
    inside = [(x, held) for x, held in page if held in (ARTICLE, PART)]
    deciding = inside if any(held == ARTICLE for _, held in inside) else page
    decides = any(held == PART for _, held in inside) if deciding is inside else any(held != DROPPED for _, held in page)
    alone = unshared([x for x, _ in page], [x for x, _ in other]) if other and decides else [True] * len(page)
    if deciding is inside:
        return " ".join(x for (x, held), own in zip(page, alone, strict=True) if held == ARTICLE or (held == PART and own))
    neutral = [(x, own) for (x, held), own in zip(page, alone, strict=True) if held != DROPPED]
    return " ".join([x for x, own in neutral if own] or [x for x, _ in neutral])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, host, path, page_id): each page against the one before it on its host,
    or the one after it if it has none before; two pages are held at a time.

    A bucket's rows of ``context`` are its neighbours in the buckets beside it: read, not returned."""
    last: tuple[tuple[int, str], list[Line]] | None = None  # the page before, its bucket and host
    waiting: tuple[object, object, bool, list[Line]] | None = None  # a host's first page
    kinds: pa.Schema | None = None
    done: list[tuple[object, object, str]] = []

    def add(page: object, url: object, context: bool, own: list[Line], other: list[Line] | None) -> None:
        if not context:
            done.append((page, url, main_text(own, other)))

    def out() -> pa.RecordBatch:
        ids, urls, texts = zip(*done, strict=True)
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kinds.field("page_id").type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    for batch in batches:
        kinds = batch.schema
        for k in range(batch.num_rows):
            page, url, host, bucket, context = (batch.column(c)[k].as_py() for c in ("page_id", "url", "host", "bucket", "context"))
            now = lines(batch.column("html")[k].as_py())
            first = last is None or last[0] != (bucket, host)
            if waiting is not None:
                add(*waiting, None if first else now)
                waiting = None
            if first:
                waiting = (page, url, context, now)
            else:
                add(page, url, context, now, last[1])
            last = ((bucket, host), now)
        if done:
            yield out()
    if waiting is not None:
        add(*waiting, None)
    if done:
        yield out()


ORDER = ("host", "path", "page_id")
#: Ranges of keys for each partition, so that partitions made of whole ranges are of near-equal size.
RANGES = 4


def _bounds(keys: DataFrame, n: int) -> list[tuple[Row, Row]]:
    """The first and last key of each of ``n`` ranges (fewer if some are empty), in order."""
    ranged = keys.repartitionByRange(n, *ORDER).groupBy(F.spark_partition_id().alias("part"))
    ends = ranged.agg(F.min(F.struct(*ORDER)).alias("first"), F.max(F.struct(*ORDER)).alias("last")).collect()
    return [(r["first"], r["last"]) for r in sorted(ends, key=lambda r: r["part"])]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Pages are dealt into ranges of (host, path, page_id), so a host with a third of all
    pages lies in as many partitions as it needs. The ranges' ends come from a pass over the
    keys alone (two keys a range come to the driver); the last page of a range goes to the next
    range too and its first page to the one before, so each page meets the same neighbour
    whatever the partitions are. Null html is an empty page; a page
    of null URL belongs to the host ''. A very long page costs time and memory in proportion to its
    length (its alignment: lines of both pages multiplied, by 64 at a time). Pages of equal host and
    path go by page_id, and rows alike in all three in any order; of several longest alignments the
    one that takes later lines counts. Character references are decoded, white space inside a line
    becomes one space, lines are joined by one space. Repeated rows each get a row. Other columns
    are not read, whatever their names; an empty table gives an empty result."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host")
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path")
    kind = pages.schema["page_id"].dataType.simpleString()
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = _bounds(pages.select(host, path, "page_id"), RANGES * n)
    keys = lambda rows: F.from_json(F.lit(json.dumps([r.asDict() for r in rows], default=str)), f"array<struct<host: string, path: string, page_id: {kind}>>")  # noqa: E731  folds to a literal
    step = max(1, math.isqrt(len(ends)))
    table = F.struct(keys([a for a, _ in ends[1:]]).alias("firsts"), keys([b for _, b in ends[:-1]]).alias("lasts"), keys([a for a, _ in ends[1::step]]).alias("coarse"))

    def places(k: Column, t: Column) -> Column:
        """The key's own bucket, the next one if it is the last key of its bucket, the one before if it is the first.

        The bucket is the number of first keys that are not beyond the key: counted among every ``step``-th, then between two of these."""
        place = lambda b, c: F.struct(b.cast("int").alias("bucket"), F.lit(c).alias("context"))
        count = lambda xs: F.size(F.filter(xs, lambda f: f <= k))
        bucket = let(count(t["coarse"]), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + count(F.slice(t["firsts"], (c - 1) * step + 1, F.lit(step)))))
        return let(bucket, lambda b: F.array_compact(F.array(place(b, False), F.when(F.get(t["lasts"], b) == k, place(b + 1, True)), F.when(F.get(t["firsts"], b - 1) == k, place(b - 1, True)))))

    at = let(F.struct(host, path, F.col("page_id")), lambda k: F.transform(let(table, lambda t: places(k, t)), lambda p: F.struct(p["bucket"].alias("bucket"), p["context"].alias("context"), k["host"].alias("host"), k["path"].alias("path"))))
    rows = pages.select("page_id", "url", F.explode(at).alias("_at"), "html").select("page_id", "url", "_at.*", "html")
    ranged = rows.repartitionById(n, F.floor(F.col("bucket") / RANGES).cast("int")).sortWithinPartitions("bucket", *ORDER)
    return ranged.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
