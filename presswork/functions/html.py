"""HTML cleaning as Arrow-batched functions over one pruned column, with native probes in front of them."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import bounded

_TOKEN = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|<[!?][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: Containers whose content isn't text. Fixed values.
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "embed", "video", "audio", "svg", "math"}
_EMPTY = re.compile(r"<(p|div|li)\b[^>]*>(?:\s|&nbsp;|<br\s*/?>)*</\1\s*>", re.I)
_ANCHOR_REST = re.compile(r"</?a\b[^>]*>?", re.I)
PROBE_ANCHOR, PROBE_EMPTY = r"(?i)<a[\s>]", r"(?i)<(p|div|li)\b[^>]*>(\s|&nbsp;|<br\s*/?>)*</"


def _tokens(source: str):
    """(text, tag name, closing, raw token) one after the other; text has no name."""
    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            yield source[at : m.start()], None, False, source[at : m.start()]
        name = _NAME.match(m[0])
        yield "", name[1].lower() if name else "", m[0].startswith("</"), m[0]
        at = m.end()
    if at < len(source):
        yield source[at:], None, False, source[at:]


def to_text(source: str | None) -> str:
    """Visible text: containers without text left out, references decoded, white space and blocks as one space."""
    parts, depth = [], 0
    for text, name, closing, _ in _tokens(source or ""):
        if name in _RAW:
            depth = max(0, depth - 1) if closing else depth + 1
        elif name is None and not depth and (piece := re.sub(r"\s+", " ", unescape(text)).strip()):
            parts.append(piece)
    return " ".join(parts)


def without_links(source: str | None) -> str:
    """Closed anchors go with their text, images in them stay; an unclosed anchor loses its tag alone."""
    source = source or ""
    out, depth = [], 0
    for _, name, closing, raw in _tokens(source):
        if name == "a":
            depth = max(0, depth - 1) if closing else depth + 1
        elif not depth or name == "img":
            out.append(raw)
    return _ANCHOR_REST.sub("", source if depth else "".join(out))


def without_empty_blocks(source: str | None) -> str:
    """Text containers without content go, until none is left."""
    source, before = source or "", None
    while source != before:
        source, before = _EMPTY.sub("", source), source
    return source


def links(source: str | None) -> list[tuple[str, str, int]]:
    """(href, text, images) of closed anchors."""
    out, held = [], None
    for text, name, closing, raw in _tokens(source or ""):
        if name == "a" and not closing:
            href = re.search(r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", raw, re.I)
            held = [unescape(next((g for g in href.groups() if g is not None), "")) if href else "", [], 0]
        elif name == "a" and held:
            out.append((held[0], re.sub(r"\s+", " ", unescape("".join(held[1]))).strip(), held[2]))
            held = None
        elif held and name is None:
            held[1].append(text)
        elif held and name == "img":
            held[2] += 1
    return out


def blocks(source: str | None) -> list[tuple[str, str, str]]:
    """(id, tag, text) of paragraphs, list items and headings in order."""
    out, tag, held = [], None, []
    for text, name, closing, _ in _tokens(source or ""):
        if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"):
            if tag and (line := re.sub(r"\s+", " ", unescape("".join(held))).strip()):
                out.append((f"b{len(out) + 1}", tag, line))
            tag, held = (None if closing else name), []
        elif name is None and tag:
            held.append(text)
    if tag and (line := re.sub(r"\s+", " ", unescape("".join(held))).strip()):
        out.append((f"b{len(out) + 1}", tag, line))
    return out


def _mapped(function, kind: T.DataType):
    """A column function which maps Arrow batches; it is made when it is used, not when a worker imports this."""

    def column(html):
        bounded()

        def each(values: pd.Series) -> pd.Series:
            return values.map(function)

        return F.pandas_udf(each, kind)(html)

    return column


def _gated(function, probe: str):
    """A text function for the rows alone in which a native probe finds work; the others reach Python as nulls."""

    def column(html: Column | str) -> Column:
        bounded()

        def each(values: pd.Series) -> pd.Series:
            return values.map(function, na_action="ignore")

        body = F.col(html) if isinstance(html, str) else html
        return F.coalesce(F.pandas_udf(each, T.StringType())(F.when(body.rlike(probe), body)), body)

    return column


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType()), T.StructField("images", T.IntegerType())])
_BLOCK = T.StructType([T.StructField("block_id", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])
text_of = _mapped(to_text, T.StringType())
unlinked = _gated(without_links, PROBE_ANCHOR)
compacted = _gated(without_empty_blocks, PROBE_EMPTY)
links_of = _mapped(links, T.ArrayType(_LINK))
blocks_of = _mapped(blocks, T.ArrayType(_BLOCK))


def plain_text(body: Column) -> Column:
    """Visible text: natively where the body has neither markup nor references."""
    bounded()

    def each(values: pd.Series) -> pd.Series:
        return values.map(to_text, na_action="ignore")

    marked = F.pandas_udf(each, T.StringType())(F.when(body.rlike("[<&]"), body))
    return F.coalesce(marked, F.btrim(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s+", " ")))


def cleaned(rows: DataFrame, body: str = "body_html") -> DataFrame:
    """Anchors and then empty blocks removed where a native probe finds any; counts of what was found."""
    probed = rows.withColumn("had_links", F.col(body).rlike(PROBE_ANCHOR))
    step = probed.withColumn("_step", unlinked(body))
    step = step.withColumn("had_empty", F.coalesce(F.col("_step").rlike(PROBE_EMPTY), F.lit(False)))
    return step.withColumn("clean", compacted("_step")).drop("_step")


def link_table(rows: DataFrame, key: str, body: str = "body_html") -> DataFrame:
    found = rows.filter(F.col(body).rlike(PROBE_ANCHOR)).select(key, F.posexplode(links_of(body)).alias("pos", "l"))
    return found.select(key, "pos", "l.*")


def block_table(rows: DataFrame, key: str, body: str = "body_html") -> DataFrame:
    return rows.select(key, F.posexplode(blocks_of(body)).alias("pos", "b")).select(key, "pos", "b.*")


def repeated_blocks(blocks_: DataFrame, key: str) -> DataFrame:
    """Blocks whose text occurs in the same document before: a grouped count, no self join."""
    per = blocks_.groupBy(key, "text").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return per.filter("n > 1")
