r"""Benchmark decontamination by an FM-index for each training shard.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case. A window is 10 consecutive words
of a benchmark item (all of them if it has fewer). A shard is a run of a task's documents; its text is the sequence
of word numbers of its documents, where stretches that can't hold a window, for lack of benchmark words, are left
out and replaced by a separator. All windows are searched backward at once through a wavelet matrix over the
Burrows-Wheeler transform; occurrences are located by walking to sampled suffix positions, and overlapping ones are
merged to removal spans.

Benchmark words go to the tasks in blocks of at most ``BLOCK_WORDS`` words (items by a hash of their ids), so what
is shipped is bounded; more blocks mean more passes over the documents. Every block is searched in the whole texts,
and the spans of all are merged for each row, which is numbered for that.

Defined cases: null has no words; item ids are of any type, a null id is an item's id too and has the empty name; an
item without words has no window; items with equal windows are all reported; an item isn't split, so a block has one
item at least; a document inside which windows overlap has each word counted once; repeated rows are judged each; empty tables
give no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import long_list, small_batches, tidy, written

WINDOW = 10
#: Benchmark words that are shipped to tasks at once, words of a shard's text, and the step of suffix samples.
BLOCK_WORDS, SHARD_WORDS, SAMPLE = 2_000_000, 1 << 20, 8

_MAP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_IN = np.array([b != 0x20 for b in _MAP])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_MAP).split()


class Phrases:
    """The windows of a block of items, and their words' numbers from 1; 0 is the separator."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.windows = list(owners)
        self.owners = list(owners.values())
        self.shortest = min(map(len, self.windows), default=1)


class FMIndex:
    """Suffix order, Burrows-Wheeler transform and wavelet matrix of numbers from 0 to alphabet."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = len(text) + 1
        self.text_length, self.bits = n, max(1, (alphabet + 1).bit_length())
        values = np.concatenate([text.astype(np.int64) + 1, [0]])  # 0 ends the text
        order = np.argsort(values, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(values[order]) > 0)])
        step = 1
        while step < n and rank.max() < n - 1:  # doubling until every suffix has its own rank
            pair = rank * (n + 1)
            pair[:-step] += rank[step:] + 1
            order = np.argsort(pair, kind="stable")
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) > 0)])
            step *= 2
        self.sampled = order % SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]
        last = values[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=(1 << self.bits) + 1))])
        self.zeros, self.ranks = [], []
        for b in range(self.bits - 1, -1, -1):
            ones = (last >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.int32))
            self.zeros.append(n - int(ones.sum()))
            last = np.concatenate([last[ones == 0], last[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` of the transform."""
        begin = np.zeros_like(at)
        for b, ranks, zeros in zip(range(self.bits - 1, -1, -1), self.ranks, self.zeros, strict=True):
            one = (symbol >> b) & 1 == 1
            begin = np.where(one, zeros + ranks[begin], begin - ranks[begin])
            at = np.where(one, zeros + ranks[at], at - ranks[at])
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ranks, zeros in zip(self.ranks, self.zeros, strict=True):
            one = ranks[at + 1] > ranks[at]
            out = out * 2 + one
            at = np.where(one, zeros + ranks[at], at - ranks[at])
        return out

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of windows of one length, one in a row, by backward search."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), self.text_length, np.int64)
        live = np.arange(len(windows))
        for j in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[live, j] + 1
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        at, todo, walked = rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.sampled_before[at[done]]] + walked
            todo, at = todo[~done], at[~done]
            symbol = self.access(at)
            at = self.first[symbol] + self.rank(symbol, at)
            walked += 1
        return out


def hits(docs: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of each occurrence in the documents' word numbers."""
    none = np.zeros(0, np.int64)
    lengths = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([*docs, none]).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), lengths)
    # stretches of benchmark words within a document, of at least the shortest window
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(flat > 0, doc, -1), [-1]])))
    starts, ends = edge[:-1], edge[1:]
    keep = (flat[starts] > 0) & (ends - starts >= phrases.shortest) if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none, none, none
    size = ends - starts
    new = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(new[-1], np.int64)
    place = np.zeros(new[-1], np.int64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    to = np.repeat(new[:-1], size) + inside
    place[to] = np.repeat(starts, size) + inside
    text[to] = flat[place[to]]
    index = FMIndex(text, len(phrases.number))
    out = []
    for length in sorted(set(map(len, phrases.windows))):
        chosen = np.array([i for i, w in enumerate(phrases.windows) if len(w) == length], np.int64)
        low, high = index.search(np.array([phrases.windows[i] for i in chosen], np.int64).reshape(len(chosen), length))
        count = high - low
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = place[index.locate(rows)]
        out.append((doc[at], at - np.repeat(np.cumsum(lengths) - lengths, lengths)[at], np.repeat(chosen, count)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted, disjoint spans as rows (start, end)."""
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([first[1:], [True]])
    return np.column_stack([starts[first], ends[last]])


#: Added to the columns of the documents: number of words, word spans (start, end, ...), items, and the spans' bytes.
ADDED = {"_fm_words": "n_words", "_fm_spans": "hit_spans", "_fm_items": "item_ids", "_fm_bytes": "byte_spans"}


def _kinds(item: T.DataType) -> tuple[T.DataType, ...]:
    return T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(item), T.ArrayType(T.LongType())


def _search(docs: DataFrame, items: list[tuple[object, str | None]], columns: list[str], item: T.DataType, cut: bool = False) -> DataFrame:
    """The columns of docs with the added ones, or cut instead: in the same trip to Python."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*[f for f in docs.schema if f.name in columns], *[T.StructField(n, k) for n, k in zip(ADDED, _kinds(item), strict=True)]])
    given = T.StructType([f for f in schema if f.name in columns]) if cut else schema

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items)
        number, kind = phrases.number.get, to_arrow_type(T.ArrayType(item))

        def judge(held: pa.RecordBatch, texts: list[bytes], ids: list[np.ndarray]) -> pa.RecordBatch:
            doc, first, window = hits(ids, phrases)
            length = np.array([len(w) for w in phrases.windows], np.int64)
            spans, places = ([np.zeros(0, np.int64)] * len(ids) for _ in range(2))
            found: list[list] = [[] for _ in ids]
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(len(ids) + 1))
            for d in np.unique(doc):
                own = order[edges[d] : edges[d + 1]]
                span = merged(first[own], first[own] + length[window[own]])
                inside = np.concatenate([[False], _IN[np.frombuffer(texts[d], np.uint8)], [False]])
                begin, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
                spans[d], places[d] = span.reshape(-1), np.column_stack([begin[span[:, 0]], end[span[:, 1] - 1]]).reshape(-1)
                found[d] = sorted({i for w in np.unique(window[own]) for i in phrases.owners[w]}, key=lambda i: (i is None, i))
            if cut:
                return _without(held, [x.tolist() for x in places], columns)
            extra = [pa.array([len(x) for x in ids], pa.int64()), long_list(spans), pa.array(found, kind), long_list(places)]
            return pa.RecordBatch.from_arrays([*[held.column(c) for c in columns], *extra], [*columns, *ADDED])

        for batch in batches:
            texts, ids, begin, size = [], [], 0, 0
            for i in range(batch.num_rows):
                raw = (batch.column("text")[i].as_py() or "").encode()
                found = raw.translate(_MAP).split()
                texts.append(raw)
                ids.append(np.fromiter((number(w, 0) for w in found), np.int32, len(found)))
                size += len(found)
                if size >= SHARD_WORDS or i == batch.num_rows - 1:
                    yield judge(batch.slice(begin, i + 1 - begin), texts, ids)
                    texts, ids, begin, size = [], [], i + 1, 0

    return docs.mapInArrow(tidy(shard), given)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks whose words number about ``block_words`` each."""
    n_words = F.coalesce(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0))
    total = benchmark.agg(F.coalesce(F.sum(n_words), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        rows = benchmark.select("item_id", "text") if blocks == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text")
        yield [(r[0], r[1]) for r in rows.collect()]


#: Number of a row of the documents, where several blocks are searched.
ROW = "_fm_row"


def _searched(docs: DataFrame, benchmark: DataFrame, columns: list[str], block_words: int, cut: bool = False) -> DataFrame:
    """The columns of docs with the added ones, or cut instead, over all blocks of the benchmark."""
    blocks, item = item_blocks(benchmark, block_words), benchmark.schema["item_id"].dataType
    items, more = next(blocks), next(blocks, None)
    if more is None:
        return _search(docs, items, columns, item, cut)
    numbered = written(docs.select(*[F.col(f"`{c}`") for c in columns], *([] if "text" in columns else ["text"])).withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    found = []
    for k, block in enumerate(chain([items, more], blocks)):
        hit = _search(numbered.select(ROW, "text"), block, [ROW], item)
        found.append(written(hit if k == 0 else hit.filter(F.size("_fm_items") > 0), "hits"))
    parts = F.collect_list(F.struct("_fm_spans", "_fm_bytes", "_fm_items"))
    rows = reduce(DataFrame.unionByName, found).groupBy(ROW).agg(F.max("_fm_words").alias("_fm_words"), parts.alias("p"))
    flat = lambda c: F.flatten(F.col(f"p.{c}")).alias(c)
    rows = rows.select(ROW, "_fm_words", flat("_fm_spans"), flat("_fm_bytes"), F.array_sort(F.array_distinct(F.flatten("p._fm_items"))).alias("_fm_items"))
    united = rows.mapInArrow(tidy(_united), rows.schema)
    whole = numbered.select(ROW, *[F.col(f"`{c}`") for c in columns]).join(united, ROW).select(*[F.col(f"`{c}`") for c in columns], *ADDED)
    return _cut(whole, columns) if cut else whole


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans of each row; where words touch, the bytes between them go too, as within one block."""
    for batch in batches:
        spans, cut = [], []
        for s, b in zip(batch.column("_fm_spans"), batch.column("_fm_bytes"), strict=True):
            s, b = s.values.to_numpy().reshape(-1, 2), b.values.to_numpy().reshape(-1, 2)
            whole = merged(s[:, 0], s[:, 1]) if len(s) else s
            of = np.searchsorted(whole[:, 0], s[:, 0], side="right") - 1
            begin, end = np.full(len(whole), np.iinfo(np.int64).max), np.zeros(len(whole), np.int64)
            np.minimum.at(begin, of, b[:, 0]), np.maximum.at(end, of, b[:, 1])
            spans.append(whole.reshape(-1)), cut.append(np.column_stack([begin, end]).reshape(-1))
        arrays = {c: batch.column(c) for c in batch.schema.names} | {"_fm_spans": long_list(spans), "_fm_bytes": long_list(cut)}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, n_words, hit_spans (word start, end, ...), item_ids of each document."""
    rows = docs.select(F.col(key).alias("doc_id"), "text")
    found = _searched(rows, benchmark, ["doc_id"], block_words).withColumnsRenamed(ADDED)
    return found.select(F.col("doc_id").alias(key), "n_words", "hit_spans", "item_ids", "byte_spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without their removal spans, from first to last word of each; n_chars follows if it is there."""
    columns = list(docs.columns)
    numbered = docs.select(*[F.col(f"`{c}`") for c in columns])
    return _searched(numbered, benchmark, columns, block_words, cut=True)


def _without(batch: pa.RecordBatch, places: list[list[int]], columns: list[str]) -> pa.RecordBatch:
    """The columns of the rows without the bytes (start, end, ...) of each text."""
    if not any(places):
        return batch.select(columns)
    texts = batch.column("text").to_pylist()
    for i, spans in enumerate(places):
        if spans:
            raw, at, kept = texts[i].encode(), 0, []
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                kept.append(raw[at:a])
                at = b
            texts[i] = b"".join([*kept, raw[at:]]).decode()
    arrays = {c: batch.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}
    if "n_chars" in arrays:
        old = arrays["n_chars"].to_pylist()
        arrays["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(texts, places, old, strict=True)], arrays["n_chars"].type)
    return pa.RecordBatch.from_arrays([arrays[c] for c in columns], columns)


def _cut(found: DataFrame, columns: list[str]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _without(batch, batch.column("_fm_bytes").to_pylist(), columns)

    return found.mapInArrow(tidy(cut), T.StructType([f for f in found.schema if f.name in columns]))


def span_words(spans: str = "hit_spans"):
    """Number of words in the union of spans (start, end, ...)."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(2)), lambda i: F.struct(F.get(spans, i).alias("a"), F.get(spans, i + 1).alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.array_sort(pairs), start, add)["n"])


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: F.coalesce(x.cast("string"), F.lit("")))), ",")
    n_hit = span_words()
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
