r"""Token-ID output in patched frame-of-reference blocks.

Texts are encoded, an end id follows each document, and the ids go to blocks of 512: the block's minimum is
subtracted, the rest is packed at the width that holds a percentile of the block's values, values that need more
bits go to an exception list, and an index has the start of each block. Documents lie in ascending id order.

Files are written and read by Spark, so they may lie in any store it knows. A row is a segment: ``part`` and
``seq`` (its place), ``doc_ids``, ``ends`` (number of ids after each document, within the segment), ``n_ids``,
``index`` (byte offset of each block, little-endian 64 bits) and ``data``. A block in ``data``:

    minimum u32 | width u8 | pad u8 | exceptions u16 | values u16 | pad u16   (12 bytes, values: how many are real)
    512 values of ``width`` bits, lowest bit first in 64-bit words              (64 * width bytes)
    exceptions: place u16 each, then the whole difference u32 each

Defined cases: a null text is empty (one end id); rows of equal id are ordered by text; a null id comes first; an
empty table gives no segment; other columns are not read; very long texts are one document in one segment.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import kept, scratch, small_batches, tidy, utf8, written

BLOCK, WIDE = 512, 0.9
#: Ids of a segment (at a document's end).
SEGMENT = 1 << 18
#: What a worker remembers (a power of two of pieces), and the most bytes and ids of such a piece.
SLOTS, LONGEST, MOST = 1 << 20, 16, 8
#: Pieces in a string that the library encodes at once.
RUN = 500
#: Bytes of text that are encoded at once (one text at least).
CHUNK = 1 << 20
#: Kinds of bytes: 0 letter, digit or part of one beyond ASCII, 1 mark, 2 full stop or comma, 3 white space, 4 any else.
_KIND = np.array([0 if c >= 128 or chr(c).isalnum() else 2 if c in b".," else 3 if c in b" \t\n" else 1 if 32 < c < 127 else 4 for c in range(256)], np.uint8)
#: Two bytes of which the text can't be cut before the second: marks or white space that stand together.
_TOGETHER = np.zeros(25, bool)
_TOGETHER[[3 * 5 + 3, 3 * 5 + 2, 2 * 5 + 2, 1 * 5 + 2]] = True
_CUTS = np.array([c in b" .,\n" for c in range(256)])


def _uncut(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts are encoded as a whole: those in which marks or white space stand together where they'd be cut."""
    odd = np.zeros(len(ends) - 1, bool)
    if not len(data):
        return odd
    kind = _KIND[data]
    bad = np.zeros(len(data), bool)
    bad[:-1] = _TOGETHER[kind[:-1] * np.uint8(5) + kind[1:]]
    last = ends[1:][ends[1:] > ends[:-1]] - 1
    bad[last] = kind[last] == 3
    bad |= kind == 4
    odd[np.searchsorted(ends, np.flatnonzero(bad), side="right") - 1] = True
    high = data >= 128
    if high.any() and not data[high].tobytes().decode().isalpha():
        for r in np.flatnonzero(~odd):
            own = high[ends[r] : ends[r + 1]]
            odd[r] = own.any() and not data[ends[r] : ends[r + 1]][own].tobytes().decode().isalpha()
    return odd


HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("pad", "u1"), ("exceptions", "<u2"), ("values", "<u2"), ("pad2", "<u2")])
SEGMENT_SCHEMA = "part int, seq int, doc_ids array<bigint>, ends array<bigint>, n_ids bigint, index binary, data binary"


def _words(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 16 bytes of each piece as two 64-bit words; what lies beyond the piece is 0."""
    padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)])
    at = np.ndarray(len(data) + LONGEST - 7, "<u8", padded, 0, (1,))  # the 8 bytes from each place on
    ones = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = at[starts] & ones[np.minimum(size, 8)]
    return np.column_stack([low, at[np.minimum(starts + 8, len(data))] & ones[np.clip(size - 8, 0, 8)]])


def _slots(words: np.ndarray) -> np.ndarray:
    mixed = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ words[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)
    return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    Its pre-tokenizer splits letters, digits, marks and white space, so between a letter and a mark, and before a
    lone white space, a text can be cut and the parts encoded by themselves. Texts are cut there, before full
    stops and commas, and each different new piece of a chunk is encoded once and remembered. Pieces that begin with a
    space are encoded as one string, which is cut where an id begins with a space. A text in which marks or white space
    stand together at such a place is one piece, encoded by itself.

    Short pieces of few ids are remembered in arrays, each in the slot that its bytes' hash names, until another
    piece takes it; a slot has the piece's own bytes, so two are never taken for one. All pieces of a chunk are looked
    up at once, and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        # of each slot's piece: bytes, their number (0: none), ids, their number
        self.words, self.size = np.zeros((SLOTS, 2), np.uint64), np.zeros(SLOTS, np.uint8)
        self.ids, self.count = np.zeros((SLOTS, MOST), "<u2" if len(self.begins) <= 1 << 16 else "<u4"), np.zeros(SLOTS, np.uint8)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: pa.Array, spaced: int, uncut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one piece's after another's, and the number of each one's. The first ``spaced``
        begin with a space; those of the others that ``uncut`` marks are whole texts."""
        data, edges = utf8(pieces)
        raw, edges = data.tobytes(), edges.tolist()
        text = lambda a, b: raw[edges[a] : edges[b]].decode()
        runs = [(i, min(i + RUN, spaced)) for i in range(0, spaced, RUN)]
        alone = (np.flatnonzero(~uncut[spaced:]) + spaced).tolist()
        encoded = iter(self.tokenizer.encode_batch_fast([*(text(a, b) for a, b in runs), *(text(i, i + 1) for i in alone)], add_special_tokens=False))
        flat, count = [np.zeros(0, "<u4")], np.zeros(len(uncut), np.int64)
        for a, b in runs:
            ids = np.array(next(encoded).ids, "<u4")
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) == b - a:
                count[a:b] = np.diff(begin, append=len(ids))
            else:  # an id in the midst of a piece begins with a space's byte
                each = [self.whole(text(i, i + 1)) for i in range(a, b)]
                ids, count[a:b] = np.frombuffer(b"".join(each), "<u4"), [len(x) // 4 for x in each]
            flat.append(ids)
        for i in range(spaced, len(uncut)):
            flat.append(np.frombuffer(self.whole(text(i, i + 1)), "<u4") if uncut[i] else np.array(next(encoded).ids, "<u4"))
            count[i] = len(flat[-1])
        return np.concatenate(flat), count

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, count = self.encode_column(pa.array(texts, pa.string()), 0)
        edges = np.cumsum(count).tolist()
        return [ids[a : b - 1].tobytes() for a, b in zip([0, *edges], edges)]

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, each followed by the end id, and the number of ids of each."""
        data, ends = utf8(texts)
        if not len(data):
            return np.full(len(texts), end_id, "<u4"), np.ones(len(texts), np.int64)
        data, odd = np.ascontiguousarray(data), _uncut(data, ends)
        cut = _CUTS[data]
        cut[ends[:-1][ends[1:] > ends[:-1]]] = True
        for r in np.flatnonzero(odd):
            cut[ends[r] + 1 : ends[r + 1]] = False
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data))
        size = np.diff(bounds)
        words = _words(data, starts, size)
        slot = _slots(words)
        there = self.words.take(slot, 0)
        known = (self.size[slot] == size) & (there[:, 0] == words[:, 0]) & (there[:, 1] == words[:, 1])
        ids, count = self.ids.take(slot, 0), self.count[slot].astype(np.int64)

        new = np.flatnonzero(~known)
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        cells = cells.take(pa.array(new)).dictionary_encode()
        which = cells.indices.to_numpy()
        first = np.zeros(len(cells.dictionary), np.int64)  # a place of each different piece
        first[which] = new
        uncut = odd[np.searchsorted(ends, starts[first], side="right") - 1]
        spaced = (data[starts[first]] == 32) & ~uncut
        order = np.argsort(~spaced, kind="stable")
        first, which = first[order], np.argsort(order)[which]
        found, many = self.learn(cells.dictionary.take(pa.array(order)), int(spaced.sum()), uncut[order])
        few = many <= MOST
        rows = np.zeros((len(many), MOST), self.ids.dtype)
        rows[np.arange(MOST) < np.where(few, many, 0)[:, None]] = found[np.repeat(few, many)]
        ids[new], count[new] = rows[which], many[which]

        fit = np.flatnonzero(few & (size[first] <= LONGEST))
        to, one = np.unique(slot[first[fit]], return_index=True)
        fit = fit[one]
        self.words[to], self.size[to], self.ids[to], self.count[to] = words[first[fit]], size[first[fit]], rows[fit], many[fit]

        before = np.concatenate([[0], np.cumsum(count)])
        total = np.diff(before[np.searchsorted(starts, ends)]) + 1
        out = np.full(int(total.sum()), end_id, "<u4")
        free = np.ones(len(out), bool)
        free[np.cumsum(total) - 1] = False
        begin = np.cumsum(many) - many
        for i in np.flatnonzero(~few[which]).tolist():  # pieces of many ids; before each text are the end ids of others
            k, at = which[i], before[new[i]] + np.searchsorted(ends, starts[new[i]], side="right") - 1
            out[at : at + many[k]] = found[begin[k] : begin[k] + many[k]]
            free[at : at + many[k]] = False
        out[free] = ids[np.arange(MOST) < np.where(count > MOST, 0, count)[:, None]]
        return out, total


@kept
@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps what it knows from task to task of this function."""
    return Encoder(path)


_BITS = np.array([int(x).bit_length() for x in range(1 << 16)], np.uint8)


def pack(ids: np.ndarray, wide: float = WIDE) -> tuple[bytes, bytes]:
    """(index, data) of the blocks of ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", b""
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    rows = full.reshape(n, BLOCK)
    low = rows.min(1)
    rows = rows - low[:, None]
    high = rows >> np.uint32(16)
    bits = _BITS[rows & np.uint32(0xFFFF)] if not high.any() else np.where(high > 0, _BITS[high] + np.uint8(16), _BITS[rows & np.uint32(0xFFFF)])
    width, most = np.zeros(n, np.uint8), int(bits.max())
    for w in range(most):  # too narrow while fewer than the percentile's values fit
        width += np.count_nonzero(bits <= w, axis=1) < np.ceil(wide * BLOCK)
    over = bits > width[:, None]
    counts = np.count_nonzero(over, axis=1)
    head = np.zeros(n, HEAD)
    head["low"], head["width"], head["exceptions"], head["values"] = low, width, counts, BLOCK
    head["values"][-1] = len(ids) - (n - 1) * BLOCK
    packed: list[bytes] = [b""] * n
    for w in range(1, most + 1):
        at = np.flatnonzero(width == w)
        if len(at):
            size = w * (BLOCK // 8)
            raw = _pack_width(rows[at] & np.uint32((1 << w) - 1), w)
            for k, b in enumerate(at.tolist()):
                packed[b] = raw[k * size : (k + 1) * size]
    block, place = np.nonzero(over)
    ends = np.cumsum(counts)
    places, values = place.astype("<u2").tobytes(), rows[block, place].astype("<u4").tobytes()
    heads, parts, starts, at = head.tobytes(), [], np.zeros(n, "<u8"), 0
    for b, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        starts[b] = at
        part = heads[b * HEAD.itemsize : (b + 1) * HEAD.itemsize] + packed[b] + places[2 * (e - c) : 2 * e] + values[4 * (e - c) : 4 * e]
        parts.append(part)
        at += len(part)
    return starts.tobytes(), b"".join(parts)


def _pack_width(rows: np.ndarray, w: int) -> bytes:
    """Blocks of w-bit values: 64 values to w words of 64 bits, the lanes of all words at once."""
    lanes = np.ascontiguousarray(rows.reshape(-1, 64).T).astype(np.uint64)
    out = np.zeros((w, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * w, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def _unpack_width(packed: bytes, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(packed, "<u8").reshape(-1, w).T)
    out, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << w) - 1)
    for i in range(64):
        word, shift = divmod(i * w, 64)
        lane = words[word] >> np.uint64(shift)
        if shift + w > 64:
            lane |= words[word + 1] << np.uint64(64 - shift)
        out[i] = lane & mask
    return np.ascontiguousarray(out.T).reshape(-1, BLOCK)


def unpack(index: bytes, data: bytes) -> np.ndarray:
    """The ids of all blocks."""
    starts = np.frombuffer(index, "<u8").astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw, data = data, np.frombuffer(data, np.uint8)
    head = np.ascontiguousarray(data[starts[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(-1)
    rows = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(head["width"][head["width"] > 0]).tolist():
        at = np.flatnonzero(head["width"] == w)
        size = w * (BLOCK // 8)
        rows[at] = _unpack_width(b"".join([raw[a : a + size] for a in (starts[at] + HEAD.itemsize).tolist()]), w)
    counts = head["exceptions"].astype(np.int64)
    block = np.repeat(np.arange(len(starts)), counts)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(counts)])[block]
        base = starts[block] + HEAD.itemsize + head["width"][block].astype(np.int64) * (BLOCK // 8)
        place = np.ascontiguousarray(data[(base + 2 * nth)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
        rows[block, place] = np.ascontiguousarray(data[(base + 2 * counts[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rows += head["low"][:, None]
    return rows.reshape(-1)[: (len(starts) - 1) * BLOCK + int(head["values"][-1])]


def block_ids(index: bytes, data: bytes, n_ids: int, begin: int, end: int) -> np.ndarray:
    """Ids begin..end of a segment, from the blocks that hold them alone."""
    first, last = begin // BLOCK, -(-end // BLOCK)
    starts = np.frombuffer(index, "<u8")
    stop = int(starts[last]) if last < len(starts) else len(data)
    part = (starts[first:last] - starts[first]).astype("<u8").tobytes()
    return unpack(part, data[int(starts[first]) : stop])[begin - first * BLOCK : min(end, n_ids) - first * BLOCK]


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of text, one row at least."""
    sizes = np.cumsum(np.diff(utf8(batch.column("text"))[1]))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK)))
        yield batch.slice(at, stop - at)
        at = stop


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", end_id: int = 0) -> None:
    """Writes the segments of all texts to ``path``, in ascending order of key."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = docs.select(F.col(key).alias("doc_id"), text.alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_all, seq, part = encoder(tokenizer).encode_column, 0, TaskContext.get().partitionId()

        def segment(keys: list, counts: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
            whole = np.concatenate(ids)
            index, data = pack(whole)
            columns = ([part], [seq], [keys], [np.cumsum(np.concatenate(counts))], [len(whole)], [index], [data])
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "seq", "doc_ids", "ends", "n_ids", "index", "data"])

        keys, counts, ids, size = [], [], [], 0
        for batch in batches:
            for piece in chunks(batch):
                found, count = encode_all(piece.column("text"), end_id)
                keys += piece.column("doc_id").to_pylist()
                counts.append(count)
                ids.append(found)
                size += len(found)
                if size >= SEGMENT:
                    yield segment(keys, counts, ids)
                    keys, counts, ids, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield segment(keys, counts, ids)

    ordered.mapInArrow(tidy(encode, keep=True), SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``base``, the number of ids in all segments before each."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.withColumn("inner", inner).join(parts.withColumn("before", before), "part").select("part", "seq", (F.col("inner") + F.col("before")).alias("base"))
    # a row for each segment, and a written table has a known size: small, it is sent to the segments, else joined
    return segments.join(written(base, "bases"), ["part", "seq"])


def token_report(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the segments."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, ends, base = row.column("doc_ids")[0].as_py(), row.column("ends")[0].as_py(), row.column("base")[0].as_py()
                ids = unpack(row.column("index")[0].as_py(), row.column("data")[0].as_py()).astype("<u4")
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([base + a for a in starts], pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.mapInArrow(tidy(decode), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes the files and reports each document from what is read back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, key, end_id)
    return token_report(read_tokens(spark, path))
