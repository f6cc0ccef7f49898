r"""Similarity join of word sets by chosen paths.

A text is the set of its five-word shingles (words ``\w+`` in lower case; a text of fewer words, but not none, is
one shingle). Two texts are linked if the Jaccard similarity of their sets is 0.8 or more.

1. Texts of one set are one node. 128 minimum hashes turn a set into tokens (coordinate, value), which two sets
   share in proportion to their similarity.
2. A run splits all nodes by one or two sampled tokens (1 / threshold of them on average). Buckets of at most
   ``SMALL`` nodes are compared by brute force; larger ones are split again, to a depth of ``DEPTH``; what is still
   large after that, a group of near copies, is compared in blocks of it, pair of blocks by pair of blocks. Runs
   are repeated, all at once, until a pair at the threshold meets with probability ``RECALL`` at any depth.
3. Comparisons in buckets use 4 bits of each minimum hash, far under the threshold, and give candidate clusters.
   Within a cluster the exact sets of all pairs are compared; a large one in blocks.

No pair is a row: a bucket gives each node an edge to the least node that it is connected to, and a number of
links. A class is a connected component of the links.

Defined cases: a null text or one without words is a class of its own without links; copies of one set link to each
other; repeated rows count as documents each; equal ids are different documents; ids are integers (one that isn't a
number counts as null); the least id of a class leaves nulls out; an empty table gives an empty one; other columns pass through :func:`distinct_documents` and are else not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, small_batches, tidy, written

SHINGLE, THRESHOLD = 5, 0.8
HASHES, SMALL, DEPTH, RECALL = 128, 1000, 3, 0.9995
#: Sketch agreement that makes a candidate, as a similarity, and nodes of a block in the exact comparison.
CANDIDATE, BLOCK = 0.62, 256
_WORD = re.compile(r"\w+")
_ROLL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    """Hashes of words, remembered by a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: _Words, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    roll = _ROLL if size <= 5 else np.random.Generator(np.random.PCG64(size)).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    out = h[: len(h) - k + 1] * roll[0]
    for i in range(1, k):
        out = out + h[i : len(h) - k + 1 + i] * roll[i]
    return np.unique(_mixed(out + np.uint64(k)))


@cache
def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimum_hashes(items: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(out, (_multipliers()[:, None] * items[None, at : at + 2048]).min(1), out=out)
    return (out >> np.uint64(24)).astype(np.uint32)  # minima are small: their high bits say little


def sketch(hashes: np.ndarray) -> bytes:
    low = (_mixed(hashes.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


_SAME = np.array([(v >> 4 == 0) + (v & 15 == 0) for v in range(256)], np.uint8)
_ENOUGH = int(HASHES * (CANDIDATE + (1 - CANDIDATE) / 16))


def survival(depth: int, similarity: float = THRESHOLD) -> float:
    """The probability that a pair of that similarity meets in a bucket after so many splits."""
    q = 1.0
    for _ in range(depth):
        p = similarity * q
        q = 1 - (2 - 1 / THRESHOLD) * (1 - p) - (1 / THRESHOLD - 1) * (1 - p) ** 2
    return q


def runs_for(recall: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def chosen(paths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, new path): each path goes on by one or two tokens, sampled by the path alone."""
    mixed = _mixed(paths)
    two = np.flatnonzero((mixed >> np.uint64(40)).astype(np.float64) / (1 << 24) < 1 / THRESHOLD - 1)
    row = np.concatenate([np.arange(len(paths)), two])
    nth = np.concatenate([np.zeros(len(paths), np.uint64), np.ones(len(two), np.uint64)])
    pick = ((mixed[row] & np.uint64(0xFFFF)) % np.uint64(HASHES) + nth * (((mixed[row] >> np.uint64(16)) & np.uint64(0xFFFF)) % np.uint64(HASHES - 1) + np.uint64(1))) % np.uint64(HASHES)
    token = hashes[row, pick.astype(np.int64)].astype(np.uint64)
    return row, _mixed(mixed[row] * np.uint64(0x9E3779B97F4A7C15) + (pick << np.uint64(33)) + token)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _similar_in_buckets(key: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket (rows are in the order of key) whose sketches agree enough."""
    found, at = [], np.arange(len(key))
    step = 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]  # a run of equal keys: what isn't equal now isn't further on
        if not len(at):
            break
        for i in range(0, len(at), 1 << 15):
            own = at[i : i + (1 << 15)]
            same = _SAME[sketches[own] ^ sketches[own + step]].sum(1, dtype=np.uint16) >= _ENOUGH
            found.append(np.column_stack([own[same], own[same] + step]))
        step += 1
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def by_bucket(batches: Iterator[pa.RecordBatch], key: str, most: int, do: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls do with tables of whole buckets, from batches in the order of key; a table has about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held)
        values = table.column(key).to_numpy()
        cut = int(np.flatnonzero(values == values[-1])[0])  # the last bucket may go on
        if cut:
            yield from do(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from do(pa.Table.from_batches(held))


EDGE = "a bigint, b bigint"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(rows: DataFrame) -> DataFrame:
    """Edges (a, b) among the nodes of each bucket; rows are (path, node, sketch)."""

    def bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node = table.column("path").to_numpy(), table.column("node").to_numpy()
        many = np.zeros(len(key), bool)
        equal = key[1:] == key[:-1]
        many[1:] |= equal
        many[:-1] |= equal
        own = np.flatnonzero(many)
        if len(own):
            raw = table.column("sketch").take(pa.array(own)).combine_chunks()
            sketches = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(own), HASHES // 2)
            a, b = _similar_in_buckets(key[own], sketches)
            if len(a):
                label = labels(len(own), a, b)
                at = np.flatnonzero(label != np.arange(len(own)))
                yield _edges(node[own[at]], node[own[label[at]]])

    dealt = rows.repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(tidy(lambda batches: by_bucket(batches, "path", 20_000, bucket)), EDGE)


SIGNED = "doc bigint, print bigint, node bigint, sketch binary, hashes binary"


def signed(docs: DataFrame, key: str, size: int = SHINGLE) -> DataFrame:
    """(doc, print, node, sketch, hashes) of each row: hashes of the text and of its set, null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                node, sketches, hashes = [], [], []
                for text in piece.column("text"):
                    items = shingles(text.as_py(), known, size)
                    low = minimum_hashes(items) if len(items) else None
                    node.append(xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63) if len(items) else None)
                    sketches.append(None if low is None else sketch(low))
                    hashes.append(None if low is None else low.tobytes())
                yield pa.RecordBatch.from_arrays([piece.column("doc"), piece.column("print"), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), pa.array(hashes, pa.binary())], ["doc", "print", "node", "sketch", "hashes"])

    return docs.select(F.col(key).try_cast("long").alias("doc"), F.xxhash64("text").alias("print"), "text").mapInArrow(tidy(sign), SIGNED)


PATHS = "path bigint, node bigint, sketch binary"


def _split(rows: DataFrame, runs: int) -> DataFrame:
    """The next paths of rows (node, sketch, hashes) and, but for the first split, path."""
    first = "path" not in rows.columns

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                n = piece.num_rows
                hashes = np.frombuffer(b"".join(piece.column("hashes").to_pylist()), np.uint32).reshape(n, HASHES)
                if first:
                    start = np.tile(_mixed(np.arange(1, runs + 1, dtype=np.uint64)), n)
                    of = np.repeat(np.arange(n), runs)
                else:
                    start, of = piece.column("path").to_numpy().view(np.uint64), np.arange(n)
                row, path = chosen(start, hashes[of])
                take = pa.array(of[row])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), piece.column("node").take(take), piece.column("sketch").take(take)], ["path", "node", "sketch"])

    return rows.mapInArrow(tidy(split), PATHS)


def candidates(nodes: DataFrame, small: int = SMALL, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """Candidate edges (a, b) among nodes (node, sketch, hashes)."""
    runs, edges, paths = runs_for(recall, depth), [], None
    for level in range(1, depth + 1):
        paths = written(_split(nodes if level == 1 else paths.join(nodes.select("node", "hashes"), "node"), runs), "paths")
        large = written(paths.groupBy("path").count().filter(F.col("count") > small), "large")
        if not large.limit(1).count():
            edges.append(_compare(paths))
            break
        edges.append(_compare(paths.join(large, "path", "left_anti")))
        paths = paths.join(large, "path")
    else:
        blocks = F.ceil(F.col("count") / small).cast("int")
        mine = F.pmod(F.xxhash64("node"), blocks)
        pairs = paths.select("path", "node", "sketch", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        key = F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other"))
        edges.append(_compare(pairs.select(key.alias("path"), "node", "sketch")))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections: products of 0/1 matrices over a few thousand items at a time."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    item = np.cumsum(new) - 1
    shared = np.bincount(item)[item] > 1
    owner, item = owner[shared], item[shared]
    item = np.unique(item, return_inverse=True)[1]
    for at in range(0, int(item.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(item, [at, at + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[owner[a:b], item[a:b] - at] = 1
        out += held @ held.T
    return out


FOUND = "node bigint, links bigint, least bigint, whole boolean"


def _exact(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """For each node of a bucket: number of linked documents in it, the least node it is connected to, and whether
    the bucket is its whole cluster. Rows are (path, node, mine, first, second, copies, text)."""

    def bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
        known = _Words()
        key = table.column("path").to_numpy()
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
        node, copies, mine = (table.column(c).to_numpy() for c in ("node", "copies", "mine"))
        first, second = table.column("first").to_numpy(), table.column("second").to_numpy()
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            texts, own, sets, seen = table.column("text"), [], [], set()
            for i in range(a, b):
                items = shingles(texts[i].as_py(), known, size)
                # rows of equal id and other text aren't the node
                if len(items) and xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63) == node[i] and node[i] not in seen:
                    seen.add(node[i]), own.append(i), sets.append(items)
            own = np.array(own, np.int64)
            if not len(own):
                continue
            own, sets = own[np.argsort(node[own])], [sets[j] for j in np.argsort(node[own])]
            n = np.array([len(s) for s in sets], np.float64)
            both = intersections(sets)
            like = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
            np.fill_diagonal(like, False)
            if first[a] != second[a]:
                like &= mine[own][:, None] != mine[own][None, :]
            i, j = np.nonzero(np.triu(like))
            label = labels(len(own), i, j)
            out.append((node[own], like @ copies[own], node[own[label]], np.full(len(own), first[a] < 0)))
        if out:
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), pa.array(columns[2]), pa.array(columns[3], pa.bool_())], ["node", "links", "least", "whole"])

    dealt = rows.repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(tidy(lambda batches: by_bucket(batches, "path", 2 * BLOCK, bucket)), FOUND)


def similar_documents(docs: DataFrame, key: str = "doc_id", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc, print, node, links, root for each row: root is the node that stands for the class, null without words."""
    small_batches(docs.sparkSession)
    rows = written(signed(docs, key, size), "signed")
    some = rows.filter("node is not null")
    classes = written(some.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "print")).alias("first")), "classes")
    nodes = some.dropDuplicates(["node"]).select("node", "sketch", "hashes")
    clusters = components(candidates(nodes, recall=recall)).select("node", F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").count()
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    members = clusters.join(sizes, "cluster").join(classes, "node").withColumn("blocks", blocks)
    members = members.withColumn("mine", F.when(F.col("blocks") == 1, -1).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    texts = docs.select(F.col(key).try_cast("long").alias("doc"), F.xxhash64("text").alias("print"), "text")
    held = members.join(texts, F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.print") == F.col("print")))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    pairs = held.select("cluster", "node", "copies", "mine", "text", other)
    pairs = pairs.select("cluster", "node", "copies", "mine", "text", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"))
    bucket = F.when(F.col("first") < 0, F.xxhash64("cluster")).otherwise(F.xxhash64("cluster", "first", "second"))
    found = written(_exact(pairs.withColumn("path", bucket).drop("cluster"), size, threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    parts = found.filter("not whole and node <> least")
    roots = found.filter("whole").select("node", F.col("least").alias("root"))
    if parts.limit(1).count():
        roots = roots.unionByName(components(parts.select("node", "least"), "node", "least"))
    judged = classes.join(links, "node", "left").join(roots, "node", "left")
    judged = judged.select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root"))
    return rows.select("doc", "print", "node").join(judged, "node", "left").select("doc", "print", "node", F.coalesce("links", F.lit(0)).alias("links"), "root")


def classes(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """key, class_id (the least id of the class) and n_links of each document."""
    found = written(similar_documents(docs, key, **how), "similar")
    least = found.filter("root is not null").groupBy("root").agg(F.min("doc").alias("class_id"))
    out = found.join(least, "root", "left")
    return out.select(F.col("doc").alias(key), F.coalesce("class_id", "doc").alias("class_id"), F.col("links").cast("long").alias("n_links"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """One document of each class, the one with the least id (null ids last); columns as they were. Rows are told
    apart by id and text, so of rows of one id those of other classes stay; of repeated rows one stays. All rows
    without words stay."""
    found = written(similar_documents(docs, key, **how), "similar").filter("root is not null")
    rows = found.groupBy("root", "doc", "print").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "print")).alias("kept"))
    kept = F.col("doc").eqNullSafe(F.col("kept.doc")) & (F.col("print") == F.col("kept.print"))
    judged = written(rows.join(first, "root").select("doc", "print", "n", kept.alias("kept")), "kept")
    own = [F.col(key).try_cast("long").alias("_path_doc"), F.xxhash64("text").alias("_path_print")]
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *own)

    def those(table: DataFrame, how: str, of: DataFrame) -> DataFrame:
        side = of.select(F.col("doc").alias("_path_d"), F.col("print").alias("_path_p"))
        return table.join(side, F.col("_path_doc").eqNullSafe(F.col("_path_d")) & (F.col("_path_print") == F.col("_path_p")), how)

    left = those(marked, "left_anti", judged.filter("not kept"))
    repeated = judged.filter("kept and n > 1")
    if repeated.limit(1).count():
        left = those(left, "left_anti", repeated).unionByName(those(left, "left_semi", repeated).dropDuplicates(["_path_doc", "_path_print"]))
    return left.drop("_path_doc", "_path_print")
