r"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Every string of ``length`` bytes that also starts in a document with a smaller id is removed. Instead of all
positions of all documents, which would be sorted at every offset, one position is kept for each run of windows:
the place in the window whose ``PREFIX``-byte prefix has the least hash (the leftmost, of equals). Equal windows
have it at the same offset, so the ranks of those places decide for the windows around them.

1. Places are ranked by their first ``PREFIX`` bytes. A rank that lies in one document alone is unique and goes.
2. Within a rank, places are ranked by the whole stretch of their windows (up to 2 * length - PREFIX bytes). All
   windows of a stretch that a smaller document has too are removed at once. If all places of a rank have one
   stretch, it is settled; the others (ends of shared passages, chance repeats of the prefix) stay.
3. The windows of the places that are left are ranked by all their bytes, past the threshold.

Ranks are equivalence classes of fingerprints: 64 bits of a polynomial over random byte values for windows in step 3
and for stretches in step 2, there besides 32 bits or more for the prefix. Spark deals the places to buckets by their
rank; a task ships only the smallest document of each class that it has itself, so a string which every document has
costs a row for each task. A rank with over ``HOT`` stretches in one task, a phrase that goes on in many ways, isn't
gathered: two of its places stand for it in its bucket, the others go to step 3 at once. The number of buckets
follows the bytes of the input. What is found is dealt to buckets of documents and united there.

Defined cases: a null text is empty; a text shorter than ``length`` keeps all; ids are integers (one that isn't a
number counts as null); equal ids are not smaller than each other; a null id is smaller than all others; very long
texts are cut into overlapping pieces; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import long_list, small_batches, tidy, utf8, written

LENGTH, PREFIX = 50, 24
#: Bytes that are hashed at once, places or windows that are dealt out at once, and bytes of input for each bucket.
PIECE, DEALT, BUCKET_BYTES = 1 << 20, 1 << 19, 1 << 22
#: Stretches of one rank in what a task deals at once; a rank with more isn't gathered.
HOT = 64
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)
_LOW = (1 << 24) - 1
NULL_ID = -(1 << 63)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes; powers of the base and of its inverse."""
    values = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = PIECE + 2 * LENGTH + 2
    inverse = pow(_BASE, -1, 1 << 64)

    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return values, powers(_BASE), powers(inverse)


class Prints:
    """Fingerprints of the substrings of up to PIECE bytes."""

    def __init__(self, data: np.ndarray):
        values, power, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return (out ^ (out >> np.uint64(31))) * _MIX

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = (self.sums[size:] - self.sums[:n]) * self.inverse[:n]
        return (out ^ (out >> np.uint64(31))) * _MIX


def packs(data: np.ndarray, ends: np.ndarray, length: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each piece, its start in the row, its bounds in the bytes): pieces of at most PIECE (or ``most``)
    in all. A longer row is cut into pieces that overlap by length - 1, so each window lies in one piece."""
    row, base, begin, end, size = [], [], [], [], 0
    most = most or PIECE
    for r in range(len(ends) - 1):
        at = int(ends[r])
        while int(ends[r + 1]) - at >= length:
            stop = min(int(ends[r + 1]), at + most)
            if size and size + stop - at > most:
                yield _pack(data, row, base, begin, end)
                row, base, begin, end, size = [], [], [], [], 0
            row.append(r), base.append(at - int(ends[r])), begin.append(at), end.append(stop)
            size += stop - at
            if stop == ends[r + 1]:
                break
            at = stop - length + 1
    if row:
        yield _pack(data, row, base, begin, end)


def _pack(data, row, base, begin, end):
    bounds = np.concatenate([[0], np.cumsum(np.subtract(end, begin))])
    return np.concatenate([data[a:b] for a, b in zip(begin, end, strict=True)]), np.array(row), np.array(base, np.int64), bounds


def places(data: np.ndarray, bounds: np.ndarray, length: int, prefix: int) -> dict[str, np.ndarray]:
    """For each run of windows with one place: piece, first window, number of further ones, rank, stretch."""
    prints = Prints(data)
    key = prints.all(prefix)
    rank_of = key
    key = (key & ~np.uint64(_LOW)) | np.arange(len(key), dtype=np.uint64)
    width, have = length - prefix + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[: len(key) - have], key[have:])
        have *= 2
    if width > have:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(key)]
    windows = np.flatnonzero(np.arange(len(key)) + length <= bounds[piece + 1])
    at = (key[windows] & np.uint64(_LOW)).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(first) else first
    left, right = windows[first], windows[last]
    return {"piece": piece[left], "left": left, "more": right - left, "rank": rank_of[at[first]], "stretch": prints.of(left, right + length) ^ (right - left).astype(np.uint64)}


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers by significance: sorted or small ones then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(parts: list[bytes], kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(size, -1).T).view(kind).reshape(-1) for p in parts])


def least_first(rank: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (rank, second, doc), and where in it a new (rank, second) begins."""
    order = np.lexsort((doc, second, rank))
    r, s = rank[order], second[order]
    return order, np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])]))


def smaller(order: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """In that order: has the class a smaller document?"""
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    return doc[order] > np.repeat(doc[order][starts], sizes)


#: What a blob has: places or windows to rank, ones that are settled, or places that are open at once.
RANK, SETTLED, OPEN = 0, 1, 2
#: Of a bucket's rows: numbers in planes.
BLOB = "bucket int, state int, rank binary, stretch binary, span binary, doc binary, nth binary"
NAMES = ["bucket", "state", "rank", "stretch", "span", "doc", "nth"]


def crowded(rank: np.ndarray, stretch: np.ndarray, doc: np.ndarray, order: np.ndarray, starts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places, settled ones apart, of ranks with over HOT stretches, but for the first and the last by document and
    stretch: these two stand for the rank in its bucket, so that other tasks' places of it stay open too."""
    r = rank[order]
    classes = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    begins = np.zeros(len(r), np.int64)
    begins[starts] = 1
    hot = np.add.reduceat(begins, classes) > HOT
    if not hot.any():
        return np.zeros(0, np.int64)
    own = order[np.repeat(hot, np.diff(np.concatenate([classes, [len(r)]]))) & ~known[order]]
    own = own[np.lexsort((stretch[own], doc[own], rank[own]))]
    first = np.concatenate([[True], rank[own][1:] != rank[own][:-1]])
    return own[~(first | np.concatenate([first[1:], [True]]))]


def by_document(doc: np.ndarray, nth: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document: rows of one id are dealt out too."""
    mixed = (doc.view(np.uint64) * _MIX + nth.astype(np.uint64)) * _MIX
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _runs(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(code, where it is) for each code."""
    kept = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(code[kept]) > 0])) if len(code) else []
    for a, b in zip(edges, [*edges[1:], len(kept)]):
        yield int(code[kept[a]]), kept[a:b]


def _blobs(buckets: int, parts: list[tuple], staged: bool) -> Iterator[pa.RecordBatch]:
    """Settles what a smaller document of the task itself decides, and deals everything to buckets: what is to be
    ranked by its rank, the rest by its document. Places (staged) have half of their rank kept and the whole
    stretch, windows the whole rank and no stretch."""
    if not parts:
        return
    rank, stretch, span, doc, nth = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    if not len(rank):
        return
    order, starts = least_first(rank, stretch, doc)
    known = np.zeros(len(rank), bool)
    known[order] = smaller(order, starts, doc)
    state = known.astype(np.int64)
    if staged:
        state[crowded(rank, stretch, doc, order, starts, known)] = OPEN
    bucket = np.where(state == RANK, (rank % np.uint64(buckets)).astype(np.int64), by_document(doc, nth, buckets))
    columns: list[list] = [[] for _ in NAMES]
    for code, own in _runs(bucket * 3 + state):
        ranked = code % 3 == RANK
        columns[0].append(code // 3)
        columns[1].append(code % 3)
        columns[2].append(b"" if not ranked else planes((rank[own] >> np.uint64(32)).astype(np.uint32) if staged else rank[own]))
        columns[3].append(planes(stretch[own]) if staged and ranked else b"")
        for c, v in zip(columns[4:], (span[own], doc[own], nth[own]), strict=True):
            c.append(planes(v))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    for i in range(0, len(columns[0]), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 64], k) for c, k in zip(columns, kinds, strict=True)], NAMES)


#: What ranking gives, dealt by documents: spans to remove and open ones, numbers in planes.
FOUND = "bucket int, open boolean, span binary, doc binary, nth binary"


def _span_table(doc, nth, span, open_) -> pa.Table:
    return pa.table([pa.array(doc, pa.int64()), pa.array(nth, pa.int32()), pa.array(span, pa.int64()), pa.array(open_, pa.bool_())], ["doc", "nth", "span", "open"])


def _read(table: pa.Table, name: str, kind: str) -> np.ndarray:
    found = [x for x in table.column(name).to_pylist() if x]
    return unplaned(found, kind) if found else np.zeros(0, kind)


def _spans(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _read(table, "doc", "<i8"), _read(table, "nth", "<i4"), _read(table, "span", "<u8").astype(np.int64)


def _dealt_on(table: pa.Table, buckets: int, rank) -> pa.Table:
    """What ranking a bucket's rows gives, with those that were settled or open before, in blobs for documents."""
    state, out = table.column("state").to_numpy(), []
    for kind in (SETTLED, OPEN):
        doc, nth, span = _spans(table.filter(pa.array(state == kind)))
        out.append(_span_table(doc, nth, span, np.full(len(doc), kind == OPEN)))
    if (state == RANK).any():
        out.append(rank(table.filter(pa.array(state == RANK))))
    found = pa.concat_tables(out)
    doc, nth, span, open_ = (found.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "nth", "span", "open"))
    columns: list[list] = [[] for _ in range(5)]
    for code, own in _runs(by_document(doc, nth, buckets) * 2 + open_):
        for c, v in zip(columns, (code >> 1, bool(code & 1), planes(span[own]), planes(doc[own]), planes(nth[own])), strict=True):
            c.append(v)
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 3]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "open", "span", "doc", "nth"])


def _in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, nth and span of a bucket of documents in their order, and where a new document begins."""
    doc, nth, span = _spans(table)
    order = np.lexsort((span, nth, doc))
    doc, nth, span = doc[order], nth[order], span[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1])
    return doc, nth, span, new


def _listed(doc: np.ndarray, nth: np.ndarray, new: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> pa.Table:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.table([pa.array(doc[new], pa.int64()), pa.array(nth[new], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], ["doc", "nth", "spans"])


def _collected(table: pa.Table) -> pa.Table:
    """(doc, nth, spans) of a bucket of documents."""
    doc, nth, span, new = _in_order(table)
    return _listed(doc, nth, new, np.bincount(np.cumsum(new) - 1), span)


def united(table: pa.Table, length: int) -> pa.Table:
    """(doc, nth, spans) of a bucket of documents, where spans are the disjoint, sorted byte spans (start, end, ...)."""
    doc, nth, span, new = _in_order(table)
    own = np.cumsum(new) - 1
    start, end = span >> 6, (span >> 6) + (span & 63) + length
    upto = np.maximum.accumulate(end + (own << 40)) - (own << 40)  # the furthest end so far in the document
    first = new.copy()
    first[1:] |= start[1:] > upto[:-1]
    last = np.concatenate([first[1:], [True]]) if len(first) else first
    return _listed(doc, nth, new, 2 * np.bincount(own[first]), np.column_stack([start[first], upto[last]]).reshape(-1))


def _rank_places(table: pa.Table) -> pa.Table:
    """Step 2: the places of a bucket, ranked by prefix and stretch."""
    rank, stretch, (doc, nth, span) = _read(table, "rank", "<u4"), _read(table, "stretch", "<u8"), _spans(table)
    order, starts = least_first(rank, stretch, doc)
    gone = smaller(order, starts, doc)
    r, d = rank[order], doc[order]
    classes = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    sizes = np.diff(np.concatenate([classes, [len(r)]]))
    shared = np.repeat(np.minimum.reduceat(d, classes) != np.maximum.reduceat(d, classes), sizes)
    begins = np.zeros(len(r), np.int64)
    begins[starts] = 1
    left = shared & ~gone & (np.repeat(np.add.reduceat(begins, classes), sizes) > 1)
    pick = gone | left
    own = order[pick]
    return _span_table(doc[own], nth[own], span[own], left[pick])


def _rank_windows(table: pa.Table) -> pa.Table:
    """Step 3: windows of a bucket, ranked by all their bytes."""
    rank, (doc, nth, span) = _read(table, "rank", "<u8"), _spans(table)
    order, starts = least_first(rank, np.zeros(len(rank), np.uint8), doc)
    own = order[smaller(order, starts, doc)]
    return _span_table(doc[own], nth[own], span[own], np.zeros(len(own), bool))


def _identified(docs: DataFrame, key: str) -> DataFrame:
    """(doc, nth, text): rows of one id, where there are any, are numbered by text."""
    from pyspark.sql import Window as W

    doc = F.coalesce(F.col(key).try_cast("long"), F.lit(NULL_ID))
    rows = docs.select(doc.alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if rows.groupBy("doc").count().filter("count > 1").limit(1).count():
        return rows.withColumn("nth", F.row_number().over(W.partitionBy("doc").orderBy("text"))).select("doc", "nth", "text")
    return rows.select("doc", F.lit(0).alias("nth"), "text")


def repeated_spans(rows: DataFrame, length: int = LENGTH, prefix: int = PREFIX, piece_bytes: int = PIECE) -> DataFrame:
    """(doc, nth, spans): for each document with removed bytes, their spans (start, end, ...)."""
    if length - prefix >= 64 or length <= prefix:
        raise ValueError("length must be over prefix, by less than 64")
    if not 2 * length <= piece_bytes <= PIECE:
        raise ValueError("pieces have two lengths at least, and PIECE bytes at most")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET_BYTES))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            doc, nth = batch.column("doc").to_numpy(), batch.column("nth").to_numpy()
            data, ends = utf8(batch.column("text"))
            for piece, row, base, bounds in packs(data, ends, length, piece_bytes):
                p = places(piece, bounds, length, prefix)
                own = row[p["piece"]]
                start = p["left"] - bounds[p["piece"]] + base[p["piece"]]
                parts.append((p["rank"], p["stretch"], (start * 64 + p["more"]).astype("<u8"), doc[own], nth[own]))
                if sum(len(x[0]) for x in parts) >= DEALT:
                    yield from _blobs(buckets, parts, True)
        yield from _blobs(buckets, parts, True)

    dealt = rows.mapInArrow(tidy(sample), BLOB)
    lists = "doc bigint, nth int, spans array<bigint>"
    settled = written(dealt.groupBy("bucket").applyInArrow(lambda table: _dealt_on(table, buckets, _rank_places), FOUND), "spans")
    open_ = settled.filter("open").groupBy("bucket").applyInArrow(_collected, lists)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            doc, nth, spans = batch.column("doc").to_numpy(), batch.column("nth").to_numpy(), batch.column("spans")
            data, ends = utf8(batch.column("text"))
            for piece, row, base, bounds in packs(data, ends, length, piece_bytes):
                prints = Prints(piece)
                for i, r in enumerate(row):
                    span = spans[int(r)].values.to_numpy()
                    begin, more = span >> 6, (span & 63) + 1
                    s = np.repeat(begin, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                    s = s[(s >= base[i]) & (s + length <= base[i] + bounds[i + 1] - bounds[i])]
                    at = s - base[i] + bounds[i]
                    parts.append((prints.of(at, at + length), np.zeros(len(s), np.uint8), (s * 64).astype("<u8"), np.full(len(s), doc[r]), np.full(len(s), nth[r])))
                if sum(len(x[0]) for x in parts) >= DEALT:
                    yield from _blobs(buckets, parts, False)
        yield from _blobs(buckets, parts, False)

    ranked = rows.join(open_, ["doc", "nth"]).mapInArrow(tidy(windows), BLOB).groupBy("bucket")
    last = ranked.applyInArrow(lambda table: _dealt_on(table, buckets, _rank_windows), FOUND)
    return settled.filter("not open").unionByName(last).groupBy("bucket").applyInArrow(lambda table: united(table, length), lists)


def deduplicated(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, prefix: int = PREFIX, piece_bytes: int = PIECE) -> DataFrame:
    """key, n_bytes, removed_spans (start, end, ...), kept (the bytes that are left)."""
    small_batches(docs.sparkSession)
    rows = _identified(docs, key)
    joined = rows.join(repeated_spans(rows, length, prefix, piece_bytes), ["doc", "nth"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            found, kept = [], []
            for i, spans in enumerate(batch.column("spans")):
                own = data[ends[i] : ends[i + 1]]
                cuts = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
                edges = [0, *cuts.tolist(), len(own)]
                kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                found.append(cuts)
            doc = [None if x == NULL_ID else x for x in batch.column("doc").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.diff(ends), pa.int64()), long_list(found), pa.array(kept, pa.binary())], ["doc", "n_bytes", "removed_spans", "kept"])

    return joined.mapInArrow(tidy(cut), "doc bigint, n_bytes bigint, removed_spans array<bigint>, kept binary").withColumnRenamed("doc", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select(key, "n_bytes", n_removed.cast("long").alias("n_removed"), (F.size("removed_spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
