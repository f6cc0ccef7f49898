"""Main text of web pages by nearest-URL page differencing.

Pages are put in the order of host and URL path; each is compared with the ``NEAR`` pages before and after it of the
same host. A page's text lines (one for each block of markup, and where it lies) are aligned with a neighbour's by a
longest common subsequence, and shared lines are deleted as the site's template:

* A line that most of the neighbours share (three of them at least have to be there) goes wherever it lies, inside an
  article element too, unless such lines are over half of the article: then most neighbours are copies of it.
  Neighbours with the same lines count as one, a neighbour with all of the page's lines as none.
* A line outside an article element also goes if a single neighbour shares it, unless that neighbour is a copy of the
  page: one that has over half of its text, lines of most neighbours left out. Inside an article element such a line
  stays, as articles quote each other and share headings.

What differs from page to page but isn't the article, such as adverts and menus of links, can't be told by comparing
pages; it is told by its elements and their classes and roles.

The order is that of the whole table. Keys of pages alone are sorted and numbered; the keys at every ``rows``-th number
are the borders of blocks, of which there are ``BLOCKS`` at most, and each page goes to its block, those near a border
to the next block too. So a page has the same neighbours however the table is dealt, and a hot host is many blocks.

Defined cases: a null html is empty and gives the empty text; a null url is a host of its own, whose pages aren't
compared; equal URLs are ordered by id, then by a hash of the html; a page without neighbours keeps its lines; unclosed
elements end with their parent; an empty table gives an empty one; other columns are not read. A line that occurs over
64 times in each of two pages is aligned occurrence by occurrence.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import small_batches, tidy, written

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
#: A tag whose quotes are closed in it; it gives up at the next < or >, so what it fails on is read once more alone.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
#: Elements of HTML by their part in a page.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
APART = frozenset("nav aside form footer menu dialog search button fieldset".split())
ARTICLE = frozenset(("article", "main"))
#: Words of classes, ids and roles of what is no article.
APART_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus "
    "discussion feedback footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say where or in what such a thing stands.
CONTAINER_WORDS = frozenset(
    "area article articles bar block bottom box button buttons card cards container content desktop div element footer form group header inline inner item items left "
    "link links list main mobile page panel post posts primary reader right row secondary section site slot stories story thread tile top unit user wrap wrapper".split()
)
#: Elements that can hold the article of a page although they are apart elsewhere.
HOLDERS = frozenset(("form", "fieldset"))
#: Neighbours on either side, and the share of a page's own text that makes a neighbour a copy of it.
NEAR, COPY = 3, 0.5
#: Pages of a block, and blocks at most.
ROWS, BLOCKS = 250, 20_000
#: Characters of host and path that the order goes by: the keys at the borders are sent to the tasks.
KEY = 512


@dataclass
class Page:
    """Lines of a page; of each, whether it is apart from the text by its elements, and whether an article has it."""

    lines: list[str] = field(default_factory=list)
    apart: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)

    @cached_property
    def places(self) -> dict[str, list[int]]:
        found = defaultdict(list)
        for i, line in enumerate(self.lines):
            found[line].append(i)
        return dict(found)


def _is_apart(tag: str, attributes: str, inside: bool) -> bool:
    if tag in APART or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name in ("class", "id", "role") and any(_names_apart(x, inside) for x in value.split()):
            return True
    return False


@lru_cache(1 << 16)
def _names_apart(name: str, inside: bool) -> bool:
    """Is a class, id or role one of what is no article? Each part of the name must say so or name a container; outside of
    an article its first or last part is enough. So ``share-buttons`` is, and ``share-price-table`` in an article isn't."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    words = APART_WORDS if inside else APART_WORDS | {"header"}
    if not inside and parts and (parts[0] in words or parts[-1] in words):
        return True
    return any(p in words for p in parts) and all(p in words or p in CONTAINER_WORDS or p.isdigit() for p in parts)


class _Tags:
    """The tags of a source. What comes next of each mark is remembered, so a source is read a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.n = source, len(source)
        self.next: dict[str, tuple[int, int]] = {}

    def find(self, mark: str, at: int) -> int:
        """The next place of a mark, or the end."""
        asked, found = self.next.get(mark, (0, -1))
        if not asked <= at <= found:
            found = self.source.find(mark, at)
            found = self.n if found < 0 else found
            self.next[mark] = at, found
        return found

    def end(self, at: int) -> int:
        """The end of the tag whose attributes begin at ``at``: the first > outside quotes. A quote that isn't closed
        is an ordinary character."""
        while True:
            stop = self.find(">", at)
            double, single = self.find('"', at), self.find("'", at)
            if stop < min(double, single) or stop >= self.n:
                return stop
            close = self.find('"' if double < single else "'", min(double, single) + 1)
            if close >= self.n:
                return stop
            at = close + 1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(begin, end, closing, name, attributes); comments and declarations have no name. A tag that isn't closed is
        text. What is sent is where to go on."""
        at = 0
        while (begin := self.find("<", at)) < self.n:
            quick = _TAG.match(self.source, begin)
            if quick:
                at = quick.end()
                skip = yield begin, at, quick[1] == "/", quick[2].lower(), quick[3]
                at = at if skip is None else skip
                continue
            after = begin + 1
            closing = self.source.startswith("/", after)
            name = _NAME.match(self.source, after + closing)
            if self.source.startswith("!--", after):
                stop = min(self.n, self.find("-->", after + 3) + 2)
            elif name:
                stop = self.end(name.end())
            elif self.source[after : after + 1] in ("!", "?"):
                stop = self.find(">", after)
            else:
                stop = self.n
            if stop >= self.n and not self.source.startswith("!--", after):
                at = after
                continue
            at = stop + 1
            skip = yield begin, min(at, self.n), closing, name[0].lower() if name else "", self.source[name.end() : stop] if name else ""
            at = at if skip is None else skip


def parsed(source: str) -> Page:
    """The lines of a page. Where all of an article would be apart, because a form or an element with such a class is around
    it, or where a form holds most of a page without an article, that element isn't apart."""
    holders: frozenset[int] = frozenset()
    while True:
        page, more = _parsed(source, holders)
        if more <= holders:
            return page
        holders |= more


def _parsed(source: str, holders: frozenset[int]) -> tuple[Page, set[int]]:
    """The lines, where some elements (by their number) aren't apart, and the elements that shouldn't be."""
    page, text = Page(), []
    roots: list[int] = []  # of each line, the number of the outermost element that is apart, or -1
    tag_of: dict[int, str] = {}
    around: set[int] = set()  # apart, and an article is in it
    number = 0
    stack: list[tuple[str, int, bool]] = []  # element, number of the apart element, inside an article
    opened: Counter = Counter()  # elements on the stack

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", references.unescape("".join(text))).strip()
            text.clear()
            if line:
                page.lines.append(line)
                roots.append(stack[-1][1] if stack else -1)
                page.apart.append(roots[-1] >= 0)
                page.inside.append(bool(stack) and stack[-1][2])

    tags, ends = iter(_Tags(source)), None
    done, skip = 0, None
    while True:
        try:
            begin, end, closing, tag, attributes = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if begin > done:
            text.append(source[done:begin])
        done = end
        if not tag:
            continue
        alone = attributes.rstrip().endswith("/")
        if tag in RAW and not closing:
            if tag != "head" and not alone:
                ends = ends or _Tags(source.translate(_LOWER))
                skip = done = min(ends.find(">", ends.find(f"</{tag}", end)) + 1, len(source))
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCK:
            flush()
        if closing:
            if opened[tag]:
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == tag:
                        break
        elif tag not in VOID and not alone:
            if tag in _ENDS_OWN and opened[tag]:  # ends an open one of its kind
                k = len(stack) - 1
                while stack[k][0] != tag and stack[k][0] not in _HOLDS:
                    k -= 1
                if stack[k][0] == tag:
                    for gone, _, _ in stack[k:]:
                        opened[gone] -= 1
                    del stack[k:]
            apart, inside = stack[-1][1:] if stack else (-1, False)
            number += 1
            if apart < 0 and number not in holders and _is_apart(tag, attributes, inside):
                apart, tag_of[number] = number, tag
            if tag in ARTICLE and apart >= 0 and (tag_of[apart] in HOLDERS or tag_of[apart] not in APART):
                around.add(apart)
            stack.append((tag, apart, inside or tag in ARTICLE))
            opened[tag] += 1
    if done < len(source):
        text.append(source[done:])
    flush()
    if any(i and not a for i, a in zip(page.inside, page.apart, strict=True)):
        return page, set()
    sizes: Counter = Counter()
    for root, line in zip(roots, page.lines, strict=True):
        sizes[root] += len(line)
    whole = sum(sizes.values())
    return page, around | {r for r, n in sizes.items() if r >= 0 and tag_of[r] in HOLDERS and 2 * n > whole}


_LOWER = {c: c + 32 for c in range(65, 91)}
_ENDS_OWN = frozenset("p li dt dd tr td th option".split())
_HOLDS = frozenset("ul ol dl table div section article blockquote body".split())


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    return aligned(Page(a), Page(b))


def aligned(a: Page, b: Page) -> set[int]:
    """Places in a's lines of a longest common subsequence with b's: increasing runs over the places of equal lines."""
    where = b.places
    shared = a.places.keys() & where.keys()
    if not shared:
        return set()
    often = {line for line in shared if len(where[line]) > 64 and len(a.places[line]) > 64}
    seen: dict[str, int] = defaultdict(int)
    tails: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in sorted(i for line in shared for i in a.places[line]):
        line = a.lines[i]
        if line in often:
            k = seen[line]
            seen[line] += 1
            places = where[line][k : k + 1]
        else:
            places = reversed(where[line])
        for j in places:
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j), links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def template(page: Page, neighbours: list[Page], main: list[bool]) -> tuple[set[int], set[int]]:
    """Places of lines that most neighbours share, and of those that one shares which isn't a copy of the page."""
    others = {tuple(o.lines): o for o in neighbours if o.lines != page.lines}
    shared = [aligned(page, o) for o in others.values()]
    votes = Counter(k for found in shared for k in found)
    most = {k for k, n in votes.items() if 2 * n > len(shared) >= 3}
    size = sum(len(line) for k, line in enumerate(page.lines) if main[k] and k not in most)
    once: set[int] = set()
    for found in shared:
        if sum(len(page.lines[k]) for k in found if main[k] and k not in most) <= COPY * size:
            once |= found
    return most, once


def main_text(page: Page, neighbours: list[Page]) -> str:
    article = any(i and not a for i, a in zip(page.inside, page.apart, strict=True))
    main = [(not a) and (i or not article) for i, a in zip(page.inside, page.apart, strict=True)]
    most, once = template(page, neighbours, main)
    if article and sum(len(page.lines[k]) for k in most if main[k]) > COPY * sum(len(line) for k, line in enumerate(page.lines) if main[k]):
        most = {k for k in most if not page.inside[k]}  # most neighbours are copies of the article
    return "\n".join(line for k, line in enumerate(page.lines) if main[k] and k not in most and (page.inside[k] or k not in once))


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: str = "url") -> Column:
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"(\.html?|/)$", "")


ORDER = ("host", "path", "id", "print")


def borders(keys: DataFrame, rows: int = ROWS, near: int = NEAR) -> list[tuple[tuple, tuple, tuple]]:
    """Of each border between blocks: the keys ``near`` places before it, at it, and ``near`` - 1 places after it.

    Keys are sorted by range, numbered within their range, and the ranges' counts give the number in the table. What
    is collected is three keys of at most 2 * KEY characters for each of at most BLOCKS borders.
    """
    low = (1 << 33) - 1
    placed = written(keys.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("at", F.monotonically_increasing_id()), "keys")
    ranges = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    total = placed.count()
    rows = max(rows, 2 * near + 1, -(-total // BLOCKS))
    number = placed.join(F.broadcast(ranges.select("range", before.alias("before"))), F.shiftright("at", 33) == F.col("range"))
    number = number.withColumn("number", F.col("before") + F.col("at").bitwiseAND(F.lit(low)))
    place = F.pmod(F.col("number") + near, F.lit(rows))  # 0: near before a border
    found = number.filter(place.isin(0, near, 2 * near - 1)).select("number", *ORDER).collect()
    at = {r["number"]: tuple(r[1:]) for r in found}
    return [(at[k - near], at[k], at.get(k + near - 1, ("\U0010ffff",))) for k in range(rows, total, rows)]


def dealt(pages: DataFrame, rows: int = ROWS, near: int = NEAR) -> DataFrame:
    """The pages by block and order; ``own`` says whether a page is of the block or near it."""
    key = [F.substring(host_of(), 1, KEY).alias("host"), F.substring(path_of(), 1, KEY).alias("path"), F.coalesce(F.col("page_id").try_cast("long"), F.lit(-(1 << 63))).alias("id")]
    keys = pages.select("page_id", "url", "html", *key, F.xxhash64("html").alias("print"))
    edges = borders(keys.select(*ORDER), rows, near)
    early, starts, late = ([e[k] for e in edges] for k in range(3))

    def blocks_of(host: pd.Series, path: pd.Series, id_: pd.Series, print_: pd.Series) -> pd.Series:
        def of(key: tuple) -> list[int]:
            own = bisect_right(starts, key)
            # near the end of its block or of the one before, or near the start
            out = [own]
            if own < len(starts) and key >= early[own]:
                out.append(own + 1)
            if own and key <= late[own - 1]:
                out.append(own - 1)
            return out

        return pd.Series(list(map(of, zip(host, path, id_, print_, strict=True))))

    if not edges:
        spread = keys.withColumn("block", F.lit(0)).withColumn("own", F.lit(True))
    else:
        found = F.pandas_udf(blocks_of, T.ArrayType(T.IntegerType()))(*ORDER)
        spread = keys.withColumn("blocks", found).select("*", F.posexplode("blocks").alias("nth", "block")).withColumn("own", F.col("nth") == 0)
    order = ["block", *ORDER]
    return spread.select("block", *ORDER, "own", "page_id", "url", "html").repartition("block").sortWithinPartitions(*order)


def extracted(pages: DataFrame, rows: int = ROWS, near: int = NEAR) -> DataFrame:
    """page_id, url, text of each page."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(pages.sparkSession)
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    kind = to_arrow_type(schema["page_id"].dataType)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque()  # pages of one block and host around the next to be judged
        at = 0
        out: tuple[list, list, list] = ([], [], [])

        def judge() -> None:
            row = held[at]
            if row["own"]:
                around = [held[k]["page"] for k in range(max(0, at - near), min(len(held), at + near + 1)) if k != at]
                for c, v in zip(out, (row["page_id"], row["url"], main_text(row["page"], around if row["url"] is not None else [])), strict=True):
                    c.append(v)

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["page_id", "url", "text"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "host", "own", "page_id", "url")}
                if held and (held[-1]["block"], held[-1]["host"]) != (row["block"], row["host"]):
                    while at < len(held):
                        judge()
                        at += 1
                    held.clear()
                    at = 0
                row["page"] = parsed(batch.column("html")[i].as_py() or "")
                held.append(row)
                while at + near < len(held):
                    judge()
                    at += 1
                    if at > near:
                        held.popleft()
                        at -= 1
                if len(out[0]) >= 500:
                    yield batch_out()
        while at < len(held):
            judge()
            at += 1
        yield batch_out()

    return dealt(pages, rows, near).mapInArrow(tidy(extract), schema)
