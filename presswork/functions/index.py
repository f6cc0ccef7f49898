"""The parts of a body as intervals of its source: text blocks and their lines, links, empty blocks, excluded contexts.

A part is found by one pass over the tags with a small state, so a body costs its length. Intervals count code points, as
``substring`` does, and every part's text is what its interval decodes to.

    block     b1, b2, ...   a paragraph, list item, division or heading that holds text, line breaks and bare formatting
    line      b1.s1, ...    the text of a block between its line breaks
    blank     b1.s2, ...    a line without text
    link      l1, l2, ...   a closed anchor with a target
    empty     e1, e2, ...   a paragraph, division or list item without anything to see
    excluded  x1, x2, ...   a comment, or a container whose content isn't the article's

Numbers are those of the document's order and count what isn't listed too: parts in an excluded context, blocks whose
formatting isn't balanced, and blank lines.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .batches import bounded

#: Names of blocks, of those that can be empty, of bare formatting, and of containers outside the article. Fixed values.
BLOCKS = frozenset({"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"})
EMPTIES = frozenset({"p", "div", "li"})
FORMATS = frozenset({"b", "i", "strong", "em", "span"})
OUTSIDE = ("script", "style", "template", "textarea", "noscript", "iframe", "embed", "object", "video", "audio", "svg")

_EXCLUDED = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(OUTSIDE) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAGS = re.compile(r"<[^<>]*>|[<>]")
_VISIBLE = re.compile(r"<!--.*?(?:-->|\Z)|<[^<>]*>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)>")
_BREAK = re.compile(r"\r\n|\r|\n|<br\b[^>]*>", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MARKUP = re.compile(r"<[^<>]*>")
_PIECE = re.compile(r"<[^<>]*>|&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|.", re.S)


class Part(NamedTuple):
    """``inner``: what is between a block's or link's tags; ``cut``: what goes with a part that is removed; ``block``: a line's block."""

    kind: str
    part_id: str
    parent_id: str | None
    tag: str | None
    text: str
    start: int
    stop: int
    inner_start: int
    inner_stop: int
    cut_start: int
    cut_stop: int
    href: str | None = None
    images: int = 0
    block_start: int | None = None
    block_stop: int | None = None


PART = (
    "kind string, part_id string, parent_id string, tag string, text string, start int, stop int, inner_start int, inner_stop int, "
    "cut_start int, cut_stop int, href string, images int, block_start int, block_stop int"
)


def decoded(body: str, start: int, stop: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of a stretch of source, and for each of its characters the source that it comes from.

    A tag and a run of white space are one space; none is at the ends. A reference is one piece of source.
    """
    text: list[str] = []
    places: list[tuple[int, int]] = []
    for m in _PIECE.finditer(body, start, stop):
        for c in " " if m[0][0] == "<" and len(m[0]) > 1 else unescape(m[0]):
            if not c.isspace():
                text.append(c)
                places.append(m.span())
            elif text and text[-1] != " ":
                text.append(" ")
                places.append(m.span())
            elif text:
                places[-1] = (places[-1][0], m.end())
    if text and text[-1] == " ":
        del text[-1], places[-1]
    return "".join(text), places


def plain(source: str) -> str:
    """The text of ``decoded`` alone, without a step for each character."""
    return " ".join(unescape(_MARKUP.sub(" ", source)).split())


def balanced(source: str) -> bool:
    """Does every formatting tag have its partner?"""
    held = []
    for m in _TAG.finditer(source):
        name = m[2].lower()
        if name in FORMATS and not m[1]:
            held.append(name)
        elif name in FORMATS and (not held or held.pop() != name):
            return False
    return not held


def _text_blocks(body: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(tag, start, inner start, inner stop, stop) of every block without other markup."""
    held = None
    for m in _TAGS.finditer(body):
        tag = _TAG.fullmatch(m[0])
        if _BREAK.fullmatch(m[0]):
            continue
        name = tag[2].lower() if tag else ""
        if name in FORMATS and not tag[3].strip():
            continue
        if name in BLOCKS and not tag[1]:
            held = (name, m.start(), m.end())
        elif held and name == held[0] and not tag[3].strip():
            yield (*held, m.start(), m.end())
            held = None
        else:
            held = None


def _lines(body: str, block: str, tag: str, start: int, begin: int, end: int, stop: int) -> Iterator[Part]:
    """The lines of a block: each goes with the break behind it, the last with the one before it."""
    breaks = [m.span() for m in _BREAK.finditer(body, begin, end)]
    starts, stops = [begin, *(b for _, b in breaks)], [*(a for a, _ in breaks), end]
    for k, (a, b) in enumerate(zip(starts, stops, strict=True)):
        text = plain(body[a:b])
        cut = (a, breaks[k][1]) if k < len(breaks) else (breaks[-1][0] if breaks else a, b)
        yield Part("line" if text else "blank", f"{block}.s{k + 1}", block, tag, text, a, b, a, b, *cut, block_start=start, block_stop=stop)


def _links(body: str) -> Iterator[Part]:
    """Anchors in the order of their ends; ids are given later."""
    held: list[tuple[int, int, str]] = []
    for m in _VISIBLE.finditer(body):
        tag = _TAG.fullmatch(m[0])
        if not tag or tag[2].lower() != "a":
            continue
        if not tag[1]:
            href = _HREF.search(m[0])
            held.append((m.start(), m.end(), unescape(next((g for g in href.groups() if g is not None), "")) if href else ""))
        elif held:
            start, inner, href = held.pop()
            if href:
                content = body[inner : m.start()]
                yield Part("link", "", None, "a", plain(content), start, m.end(), inner, m.start(), start, m.end(), href, len(re.findall(r"<img\b", content, re.I)))


def _empty_blocks(body: str) -> Iterator[tuple[str, int, int, int, int]]:
    """Blocks with nothing but white space, comments and empty formatting."""
    held, inside, at = None, None, 0
    for m in _VISIBLE.finditer(body):
        if held and body[at : m.start()].strip():
            held = None
        at = m.end()
        tag = _TAG.fullmatch(m[0])
        name = tag[2].lower() if tag else ""
        if name in EMPTIES and not tag[1]:
            held, inside = (name, m.start(), m.end()), None
        elif not held:
            continue
        elif inside:
            held, inside = (held if tag and tag[1] and name == inside else None), None
        elif m[0].startswith("<!--"):
            continue
        elif name in FORMATS and not tag[1]:
            inside = name
        elif tag and tag[1] and name == held[0]:
            yield (*held, m.start(), m.end())
            held = None
        else:
            held = None


def parts(body: str | None) -> list[Part]:
    """All parts of a body, kind by kind, each in the document's order."""
    body = body or ""
    spans = [m.span() for m in _EXCLUDED.finditer(body)]
    begins = [a for a, _ in spans]

    def outside(at: int) -> bool:
        i = bisect_right(begins, at) - 1
        return i >= 0 and at < spans[i][1]

    out = []
    for n, (tag, start, inner, end, stop) in enumerate(_text_blocks(body), 1):
        if not outside(start) and balanced(body[inner:end]):
            out.append(Part("block", f"b{n}", None, tag, plain(body[inner:end]), start, stop, inner, end, start, stop))
            out += _lines(body, f"b{n}", tag, start, inner, end, stop)
    for n, link in enumerate(sorted(_links(body), key=lambda x: x.start), 1):
        if not outside(link.start):
            out.append(link._replace(part_id=f"l{n}"))
    for n, (tag, start, inner, end, stop) in enumerate(_empty_blocks(body), 1):
        if not outside(start):
            out.append(Part("empty", f"e{n}", None, tag, "", start, stop, inner, end, start, stop))
    out += [Part("excluded", f"x{n}", None, None, "", a, b, a, b, a, b) for n, (a, b) in enumerate(spans, 1)]
    return out


class BodyParts:
    """The table function: a row for each part."""

    def eval(self, body: str):
        yield from parts(body)


#: Bodies without any tag have no part and don't reach Python.
PROBE = "<"


def table_function():
    return F.udtf(BodyParts, returnType=PART)


def register(spark: SparkSession, name: str = "body_parts") -> None:
    """Makes ``SELECT ... FROM articles, LATERAL body_parts(body_html)`` possible."""
    spark.udtf.register(name, table_function())


def part_table(rows: DataFrame, key: str, body: str | Column = "body_html", *kinds: str) -> DataFrame:
    """key and the parts of each body, of some kinds or all."""
    bounded(rows.sparkSession)
    source = F.col(body) if isinstance(body, str) else body
    held = rows.select(F.col(key), source.alias("_body")).filter(F.contains("_body", F.lit(PROBE)))
    found = held.lateralJoin(table_function()(F.col("_body").outer())).drop("_body")
    return found.filter(F.col("kind").isin(*kinds)) if kinds else found


def substance(text: Column) -> Column:
    """What two texts have in common if they say the same: letters and digits, compatible forms as one, in lower case."""
    from .quality import compatible

    return F.regexp_replace(F.lower(compatible(text)), r"[^\p{L}\p{N}]", "")


#: The shortest text that the beginning of another can repeat. Fixed value.
LEAST_PREFIX = 4


def repeated_parts(found: DataFrame, key: str) -> DataFrame:
    """The parts that a document could lose without losing a word: key, part_id, text, keep_id, keep_text, occurrences.

    A part goes if another says the same or begins with it (from LEAST_PREFIX letters on); of equal ones the first stays.
    Sorted by their letters, texts that begin with another follow it directly, so the one behind each part tells whether it
    goes, and the next that doesn't go is what is kept: two windows over a document's parts, no pairs.
    ``occurrences``: how often the part's letters are found in all of the document's.
    """
    from pyspark.sql import Window as W

    lettered = found.select(key, "part_id", "text", "start", substance(F.col("text")).alias("letters")).filter("letters <> ''")
    order = W.partitionBy(key).orderBy("letters", F.desc("start"))
    after = F.lead("letters").over(order)
    goes = F.coalesce((after == F.col("letters")) | ((F.char_length("letters") >= LEAST_PREFIX) & F.startswith(after, F.col("letters"))), F.lit(False))
    marked = lettered.withColumn("goes", goes)
    kept = F.first(F.when(~F.col("goes"), F.struct("part_id", "text")), ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    marked = marked.withColumn("kept", kept).filter("goes")
    whole = lettered.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "letters"))), lambda x: x["letters"]), "").alias("_whole"))
    times = (F.char_length("_whole") - F.char_length(F.replace("_whole", F.col("letters"), F.lit("")))) / F.char_length("letters")
    return marked.join(whole, key).select(key, "part_id", "text", F.col("kept.part_id").alias("keep_id"), F.col("kept.text").alias("keep_text"), times.cast("int").alias("occurrences"))


def cut_out(bodies: DataFrame, cuts: DataFrame, key: str, body: str = "body_html") -> DataFrame:
    """key and ``clean``: the bodies without the intervals (key, start, stop) of a table; overlaps count once.

    Native: a body's sorted intervals are folded into the pieces between them. Bodies without an interval stay as they are.
    """
    gone = cuts.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))).alias("_gone"))
    rows = bodies.select(key, F.coalesce(body, F.lit("")).alias("_body")).join(gone, key, "left")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

    def piece(s, x):
        kept = F.when(x["start"] > s["at"], F.concat(s["kept"], F.array(F.substring(F.col("_body"), s["at"] + 1, x["start"] - s["at"])))).otherwise(s["kept"])
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), kept.alias("kept"))

    folded = F.aggregate("_gone", none, piece)
    rest = F.concat(F.array_join(folded["kept"], ""), F.substring(F.col("_body"), folded["at"] + 1, F.char_length("_body")))
    return rows.select(key, F.when(F.col("_gone").isNull(), F.col("_body")).otherwise(rest).alias("clean"))
