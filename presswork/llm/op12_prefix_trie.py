r"""Conversation prefix trie: what conversations share from their first turn on, and what a prefix cache would save.

A turn's id is 128 bits of the sha256 of its role and text; a conversation is the bytes of its turns' ids. Conversations
are dealt to range shards by those bytes and conv_id, so that conversations with a common prefix are neighbours, and a
hot group of equal ones is dealt out by conv_id. In a shard, ids become dense numbers in padded matrices of at most
``SLAB`` columns (deeper turns follow in further matrices, of the rows alone that go on): numpy's lexsort orders the
rows, changes between neighbours accumulated by OR over the columns mark where nodes begin, and reduceat gives every
depth's nodes their members. Sums over subtrees go up depth by depth.

Only the nodes on the paths of a shard's first and last row can have members in another shard. Those partial nodes are
merged by the hash of their path; their tree is small (two paths for each shard), so one task sums it up.

Tables: conversations (conv_id, turn, role, text) give sequences (conv_id, turns), those give nodes:

    key          the hash of the node's path if it was merged, else null
    conv_id      smallest member              depth     number of turns, 0 for the root
    turn_id      hex id of its last turn (null for the root); n_bytes: UTF-8 bytes of its text
    parent_conv_id  the parent's conv_id (null for the root)
    n_convs      conversations that begin with it
    n_children, n_leaves (childless nodes of its subtree)
    saved_tokens sum over its subtree of (n_convs - 1) * n_bytes
    ends_sha256  hash of the ascending conv_ids that end here, joined by commas (that of nothing if none)

Defined cases: a null role or text is empty; a null turn comes first; equal turns of a conversation are ordered by the id
of what is said, and a repeated row is a turn of its own; a conv_id that is null or no number is no conversation; a
conversation without turns is a member of the root; an empty table has no node, not even a root; other columns are not
read. A conversation is a row of about 40 bytes a turn without texts, which one task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy, written

#: Columns of a matrix, and turns of a shard that are aimed at.
SLAB, SHARD = 64, 1_000_000
ID = 16
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = (
    "merged boolean, key string, parent_key string, conv_id bigint, depth bigint, turn_id string, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, n_bytes bigint, ends_sha256 string, ends array<bigint>"
)
COLUMNS = ["conv_id", "depth", "turn_id", "n_bytes", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of place, id, n_bytes) of each conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID)
    rows = conversations.select(
        F.expr("try_cast(conv_id AS bigint)").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), "turn", said.alias("id"), F.octet_length(text).cast("long").alias("n_bytes")).alias("t"),
    )
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_openings(found: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Sequences whose first h turns come from the conversation ``c - c % every``; h = crc32(c) % most."""
    c = F.col("conv_id")
    own = found.withColumns({"h": (F.crc32(c.cast("string").cast("binary")) % most).cast("int"), "base": c - c % every})
    opening = found.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("opening"))
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    first = F.slice(F.coalesce("opening", none), F.lit(1), F.col("h"))
    return own.join(opening, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


class Shard:
    """The nodes of a shard's conversations."""

    def __init__(self, conv: np.ndarray, paths: list[bytes], sizes: np.ndarray, slab: int = SLAB):
        """conv: conv_id of each row; paths: bytes of its turns' ids; sizes: n_bytes of all turns, row after row."""
        self.conv, self.paths, self.sizes = conv, paths, sizes
        self.lens = np.array([len(p) // ID for p in paths], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])
        raw = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
        self.ids = self._dense(raw)
        self.first, self.last = (f(range(len(paths)), key=lambda r: (paths[r], conv[r])) for f in (min, max))
        self.levels: list[dict[str, np.ndarray]] = []
        self.at = np.zeros(len(paths), np.int64)  # each row's node, counted over all levels
        self.n = 0
        self.first_path, self.last_path = [], []
        everyone = np.lexsort((conv,))
        self._level(everyone, np.zeros(1, np.int64), np.full(1, -1), np.full(1, -1), 0)
        depth = 0
        alive = np.flatnonzero(self.lens > 0)
        while len(alive):
            self._matrix(alive, depth, slab)
            depth += slab
            alive = np.flatnonzero(self.lens > depth)

    @staticmethod
    def _dense(raw: np.ndarray) -> np.ndarray:
        """Numbers of ids in their order."""
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        ranked = raw[order]
        new = np.ones(len(raw), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        out = np.empty(len(raw), np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def _matrix(self, alive: np.ndarray, depth: int, slab: int) -> None:
        """Depths depth + 1 to depth + slab."""
        width = int(min(slab, self.lens[alive].max() - depth))
        place = depth + np.arange(width)
        real = place < self.lens[alive][:, None]
        matrix = np.full((len(alive), width), -1, np.int64)
        matrix[real] = self.ids[(self.starts[alive][:, None] + place)[real]]
        group = self.at[alive]
        order = np.lexsort((self.conv[alive], *matrix.T[::-1], group))
        alive, matrix, group = alive[order], matrix[order], group[order]
        change = np.ones(matrix.shape, bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, 0] |= group[1:] != group[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        for j in range(width):
            held = np.flatnonzero(matrix[:, j] >= 0)
            begins = np.flatnonzero(change[held, j])
            heads = alive[held[begins]]
            self._level(alive[held], begins, self.at[heads], self.starts[heads] + depth + j, depth + j + 1)

    def _level(self, rows: np.ndarray, begins: np.ndarray, parent: np.ndarray, turn: np.ndarray, depth: int) -> None:
        """A depth's nodes: rows in order, where its nodes begin among them, their parents and the places of their turns."""
        sizes = np.diff(np.append(begins, len(rows)))
        ending = self.lens[rows] == depth
        self.levels.append({
            "conv": np.minimum.reduceat(self.conv[rows], begins), "n": sizes, "parent": parent, "turn": turn,
            "bytes": self.sizes[turn] if depth else np.zeros(1, np.int64), "row": rows[begins],
            "ended": self.conv[rows[ending]], "n_ended": np.add.reduceat(ending.astype(np.int64), begins),
        })
        self.at[rows] = self.n + np.repeat(np.arange(len(begins)), sizes)
        for path, row in ((self.first_path, self.first), (self.last_path, self.last)):
            if self.lens[row] >= depth:
                path.append(int(self.at[row]))
        self.n += len(begins)

    def nodes(self) -> Iterator[pa.RecordBatch]:
        """Complete nodes, and partial ones with the keys of their paths."""
        every = {k: np.concatenate([lv[k] for lv in self.levels]) for k in ("conv", "n", "parent", "bytes", "turn", "row", "n_ended")}
        bounds = np.cumsum([0, *(len(lv["n"]) for lv in self.levels)])
        open_ = np.zeros(self.n, bool)
        open_[self.first_path] = open_[self.last_path] = True
        children = np.bincount(every["parent"][~open_], minlength=self.n).astype(np.int64)
        leaves, saved = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        leaves[~open_] = children[~open_] == 0
        saved[~open_] = ((every["n"] - 1) * every["bytes"])[~open_]
        for a, b in zip(bounds[-2:0:-1].tolist(), bounds[:1:-1].tolist(), strict=True):  # complete nodes add to their parents
            own = a + np.flatnonzero(~open_[a:b])
            np.add.at(leaves, every["parent"][own], leaves[own])
            np.add.at(saved, every["parent"][own], saved[own])
        keys = self._keys()
        for depth, level in enumerate(self.levels):
            a, b = int(bounds[depth]), int(bounds[depth + 1])
            yield self._batch(depth, level, slice(a, b), open_, children, leaves, saved, every, keys)

    def _keys(self) -> dict[int, str]:
        """The hash of the path of each partial node."""
        out = {}
        for row, path in ((self.first, self.first_path), (self.last, self.last_path)):
            hashed = hashlib.sha256()
            for depth, node in enumerate(path):
                if depth:
                    hashed.update(self.paths[row][ID * (depth - 1) : ID * depth])
                out[node] = hashed.copy().hexdigest()
        return out

    def _batch(self, depth, level, own: slice, open_, children, leaves, saved, every, keys) -> pa.RecordBatch:
        nodes, partial = range(own.start, own.stop), open_[own].tolist()
        stops = np.cumsum(level["n_ended"]).tolist()
        ended = level["ended"].tolist()
        ends = [ended[a:b] for a, b in zip([0, *stops], stops)]
        parents = level["parent"].tolist()
        hashed = [None if p else hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else NOTHING for p, e in zip(partial, ends, strict=True)]
        turns = [self.paths[r][ID * (depth - 1) : ID * depth].hex() if depth else None for r in level["row"].tolist()]
        up = [None if p < 0 or open_[p] else int(every["conv"][p]) for p in parents]
        lists = [e if p else None for p, e in zip(partial, ends, strict=True)]
        columns = [
            pa.array(partial, pa.bool_()), pa.array([keys.get(i) for i in nodes], pa.string()), pa.array([keys.get(p) for p in parents], pa.string()),
            pa.array(level["conv"], pa.int64()), pa.array([depth] * len(partial), pa.int64()), pa.array(turns, pa.string()), pa.array(up, pa.int64()), pa.array(level["n"], pa.int64()),
            pa.array(children[own], pa.int64()), pa.array(leaves[own], pa.int64()), pa.array(saved[own], pa.int64()), pa.array(level["bytes"], pa.int64()),
            pa.array(hashed, pa.string()), pa.array(lists, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in NODE.split(", ")])


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, paths, sizes = [], [], []
    for batch in batches:
        conv += batch.column("conv_id").to_pylist()
        paths += batch.column("path").to_pylist()
        sizes.append(batch.column("sizes").flatten().to_numpy())
    if conv:
        yield from Shard(np.array(conv, np.int64), paths, np.concatenate(sizes).astype(np.int64)).nodes()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children, leaves and savings of the merged nodes, from the deepest to the root."""
    nodes = {row["key"]: row for batch in batches for row in batch.to_pylist()}
    for row in sorted(nodes.values(), key=lambda r: -r["depth"]):
        row["n_leaves"] += row["n_children"] == 0
        row["saved_tokens"] += (row["n_convs"] - 1) * row["n_bytes"]
        parent = nodes.get(row["parent_key"])
        row["parent_conv_id"] = parent and parent["conv_id"]
        if parent:
            parent["n_children"] += 1
            parent["n_leaves"] += row["n_leaves"]
            parent["saved_tokens"] += row["saved_tokens"]
    if nodes:
        yield pa.RecordBatch.from_pylist(list(nodes.values()), pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in MERGED.split(", ")]))


MERGED = "key string, parent_key string, conv_id bigint, depth bigint, turn_id string, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, n_bytes bigint"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's lists, which come in order; none is held as a whole."""
    key, hashed, some = None, None, False
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, hashed.hexdigest()))
                key, hashed, some = k, hashlib.sha256(), False
            hashed.update((b"," if some else b"") + ",".join(map(str, ids)).encode())
            some = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["key", "found"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([hashed.hexdigest()])], ["key", "found"])


def trie(found: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of sequences (conv_id, turns); shards: their number (None: by the number of turns)."""
    spark = found.sparkSession
    flat = found.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("path"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes")
    )
    flat = written(flat, "sequences")
    if shards is None:
        turns = flat.agg(F.sum(F.size("sizes"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // SHARD + 1)
    parts = written(flat.repartitionByRange(shards, "path", "conv_id").mapInArrow(tidy(_shard_nodes), NODE), "trie")
    whole, partial = parts.filter("not merged"), parts.filter("merged")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    one = partial.groupBy("key", "parent_key", "depth", "turn_id", "n_bytes").agg(F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in sums])
    # two paths for each shard: as many rows as shards have depths
    merged = written(one.select(*[f.split()[0] for f in MERGED.split(", ")]).repartition(1).mapInArrow(_summed, MERGED), "merged")
    lists = partial.filter("size(ends) > 0").select("key", "ends").withColumn("least", F.get("ends", 0))
    ends = lists.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_ends, "key string, found string")
    complete = merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("found", F.lit(NOTHING)))
    # a written table has a known size: small, it is sent to the nodes, else joined
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    below = whole.join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return complete.select("key", *COLUMNS).unionByName(below.select("key", *COLUMNS))


def conversation_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the conversations as they are."""
    return trie(sequences(conversations), shards)
