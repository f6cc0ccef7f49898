r"""Fill-in-middle: texts cut twice at drawn units and put in another order behind marks.

A text's UTF-8 bytes lie in blocks of ``BLOCK`` bytes. A Fenwick tree over the blocks has for each the number of units
that begin in it and of code points; a cut is a number of units, whose block the tree finds by binary lifting (which
sums the code points before it on the way), and whose byte is then found inside that block alone. So a cut costs the
logarithm of a text's blocks and one block, however long the text is.

Units are code points, or the matches of a pattern from left to right; what none matches belongs to the unit before it,
and to the first one at the beginning. A text's draws are the 8-digit groups of the hex sha256 of ``seed:key``.

    plain  the text: it is empty, has a mark in it, or drew to stay plain
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

As no mark is in a text that is cut, the output alone gives the text back (``restored``, with native functions).

Defined cases: a null text is empty and plain; a null key is drawn for as an empty one; repeated rows are each cut, at
the same places; keys of any type are hashed as Spark casts them to strings; an empty table gives an empty one; a text
is one row and one task's, whatever its length; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import small_batches, tidy, utf8
from .op04_patched_for import chunks

#: Bytes of a block.
BLOCK = 4096
#: Marks of prefix, suffix and middle; of 100 texts, those that are cut, and of those the ones whose suffix comes first.
MARKS, CUT, SUFFIX_FIRST = ("<P>", "<S>", "<M>"), 90, 20
#: A unit that is a word with the white space behind it.
WORDS = r"\S+\s*"


class BlockTree:
    """A Fenwick tree over the blocks of a text: units that begin in each, and code points."""

    def __init__(self, data: np.ndarray, starts: np.ndarray | None = None, size: int = BLOCK):
        """data: UTF-8 bytes; starts: a flag for each byte at which a unit begins (None: each code point is one)."""
        self.size, self.n_bytes = size, len(data)
        self.points = (data & 0xC0) != 0x80
        self.starts = self.points if starts is None else starts
        self.n_blocks = -(-len(data) // size)
        self.unit_tree, self.n_units = self._tree(self.starts)
        self.point_tree, self.n_points = (self.unit_tree, self.n_units) if starts is None else self._tree(self.points)
        self.top = 1 << (self.n_blocks.bit_length() - 1) if self.n_blocks else 0

    def _tree(self, flags: np.ndarray) -> tuple[list[int], int]:
        """Node i holds the blocks (i - lowest bit of i, i]."""
        if self.n_blocks <= 1:
            total = int(np.count_nonzero(flags))
            return [0, total], total
        counts = np.add.reduceat(flags, np.arange(0, len(flags), self.size), dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        i = np.arange(1, len(before))
        return [0, *(before[i] - before[i - (i & -i)]).tolist()], int(before[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code points before it) of the place after so many units."""
        at = points = 0
        step, left = self.top, units
        while step:  # the last block before which at most ``units`` units begin
            if at + step <= self.n_blocks and self.unit_tree[at + step] <= left:
                at += step
                left -= self.unit_tree[at]
                points += self.point_tree[at]
            step >>= 1
        if at == self.n_blocks:
            return self.n_bytes, points
        begin = at * self.size
        byte = begin + int(np.flatnonzero(self.starts[begin : begin + self.size])[left])
        return byte, points + int(np.count_nonzero(self.points[begin:byte]))


def unit_starts(text: bytes, pattern: re.Pattern[bytes]) -> np.ndarray:
    """The flags of the bytes at which a pattern's matches begin, the first moved to the beginning."""
    flags = np.zeros(len(text), bool)
    found = [m.start() for m in pattern.finditer(text) if m.end() > m.start()]
    if found:
        flags[[0, *found[1:]]] = True
    return flags


def rearranged(text: bytes, draws: tuple[int, int, int, int], marks: tuple[bytes, bytes, bytes], pattern=None, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, size: int = BLOCK):
    """(units, form, prefix code points, middle code points, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    tree = BlockTree(data, None if pattern is None else unit_starts(text, pattern), size)
    n = tree.n_units
    if not text or draws[2] % 100 >= cut or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, points = tree.cut(first)
    b, more = tree.cut(second)
    p, s, m = marks
    if draws[3] % 100 < suffix_first:
        return n, "spm", points, more - points, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", points, more - points, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", seed: int = 1, unit: str | None = None, marks: tuple[str, str, str] = MARKS,
    cut: int = CUT, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK,
) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of each text.

    unit: a pattern over ASCII of what a unit is (None: a code point); cut: of 100 texts those that are cut.
    """
    small_batches(docs.sparkSession)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("text"), *draws)
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])
    signs, source = tuple(m.encode() for m in marks), unit and unit.encode()

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(source) if source else None
        for batch in batches:
            for part in chunks(batch):
                data, ends = utf8(part.column("text"))
                data, ends = data.tobytes(), ends.tolist()
                draws = zip(*(part.column(f"h{i}").to_pylist() for i in range(4)), strict=True)
                done = [rearranged(data[a:b], h, signs, pattern, cut, suffix_first, block) for a, b, h in zip(ends, ends[1:], draws)]
                n, form, prefix, middle, output = zip(*done, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("_key"), *columns], schema.names)

    return rows.mapInArrow(tidy(arrange), schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks))
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
