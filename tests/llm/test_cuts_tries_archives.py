"""Fill-in-middle, prefix trie and packaged archives against plain Python, with nulls, ties, repeats, hot groups and long texts."""

from __future__ import annotations

import hashlib
import io
import random
import re
import struct
import urllib.parse
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.llm import op11_fill_middle as fim, op12_prefix_trie as tries, op13_packaged_warc as warc

TEXTS = [None, "", "a", "é", "two words", "with <P> inside", "<M>", "ends in <", "日本語のテキスト" * 40, "x" * 9000, "é€😀" * 3000, "line one\nline two\n\n", " lead", "\t", *["again and again"] * 5]


def cut_plainly(key, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, middle, last = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{last}<P>{first}<M>{middle}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{first}<S>{last}<M>{middle}")


@pytest.mark.parametrize("block", [1, 2, 7, 64, 4096])
def test_cuts(spark, block):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(190)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({"n": F.lit("x"), "output": F.lit(1), "_key": F.lit(2), "h0": F.lit(3)})
    got = fim.fill_in_middle(docs, block=block).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r["doc_id"]: (*r[1:6],) for r in got} == {k: cut_plainly(k, t) for k, t in rows}
    assert {r["doc_id"]: r["again"] for r in got} == {k: t or "" for k, t in rows}
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_odd_keys(spark):
    docs = spark.createDataFrame([("a", "some text"), (None, "some text"), ("a", "some text")], "doc_id string, text string")
    got = Counter(fim.fill_in_middle(docs).select("doc_id", "output").collect())
    assert got == Counter([("a", cut_plainly("a", "some text")[4])] * 2 + [(None, cut_plainly("", "some text")[4])])
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_cuts_at_words(spark):
    texts = ["one two  three\nfour", "  lead here", "", "é " * 500, "single", "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in fim.fill_in_middle(docs, unit=fim.WORDS, cut=100, block=16).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect():
        text = texts[row["doc_id"]]
        assert row["again"] == text and row["n"] == len(text.split())
        if row["form"] != "plain":
            edges = {0, len(text), *(m.start() for m in list(re.finditer(fim.WORDS, text))[1:])}
            assert {row["prefix_chars"], row["prefix_chars"] + row["middle_chars"]} <= edges


def test_tree_finds_every_cut():
    text = ("aé€😀" * 50).encode()
    for size in (1, 3, 8, 1000):
        tree = fim.BlockTree(np.frombuffer(text, np.uint8), size=size)
        assert [tree.cut(k) for k in range(201)] == [(len(text.decode()[:k].encode()), k) for k in range(201)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def nodes_plainly(rows, every=5, most=9, share=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32], (r, x)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    built = own
    if share:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % most
            built[c] = own.get(c - c % every, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, held in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(held) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(built[c]) == len(k)).encode()).hexdigest()
    return Counter((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], ends(k)) for k, v in members.items())


def nodes_found(found):
    return Counter(tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations():
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["", "a", "bé", None, "long " * 20])) for c in range(120) for t in range(draw.randrange(7))]
    rows += [(500 + c, t, "user", "copy") for c in range(150) for t in range(3)]  # a hot group
    rows += [(c, t, "user", f"deep {t if t < 150 else (t, c)}") for c in (901, 902) for t in range(170)]  # long ones which share much
    rows += [(1000, None, "user", "first"), (1000, None, "user", "first"), (1000, 4, "b", "tie"), (1000, 4, "a", "tie"), (None, 1, "user", "nobody's"), (-3, 1, "user", "copy")]
    return rows


@pytest.mark.parametrize("shards,slab", [(1, 64), (5, 64), (40, 64), (7, 3)])
def test_trie(spark, shards, slab, monkeypatch):
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"turns": F.lit(1), "path": F.lit(2), "key": F.lit("k")})
    if slab != 64:
        monkeypatch.setattr(tries.Shard.__init__, "__defaults__", (slab,))
    assert nodes_found(tries.trie(tries.with_shared_openings(tries.sequences(table)), shards)) == nodes_plainly(rows)


def test_trie_without_rebuilding(spark):
    rows = conversations()
    assert nodes_found(tries.conversation_trie(spark.createDataFrame(rows, SCHEMA), 6)) == nodes_plainly(rows, share=False)
    texts = spark.createDataFrame([(str(c) if c is not None else "no number", t, r, x) for c, t, r, x in rows], "conv_id string, turn bigint, role string, text string")
    assert nodes_found(tries.conversation_trie(texts, 3)) == nodes_plainly(rows, share=False)


@pytest.mark.parametrize("slab", [1, 2, 5, 64])
def test_shard_of_slabs(slab):
    """Matrices of any width give the same nodes."""
    draw = random.Random(slab)
    paths = [b"".join(bytes([draw.randrange(2)]) * 16 for _ in range(draw.randrange(9))) for _ in range(200)]
    shard = tries.Shard(np.arange(200), paths, np.ones(sum(len(p) // 16 for p in paths), np.int64), slab)
    got = [(r["depth"], r["conv_id"], r["n_convs"]) for b in shard.nodes() for r in b.to_pylist()]
    members = defaultdict(list)
    for c, p in enumerate(paths):
        for d in range(len(p) // 16 + 1):
            members[p[: 16 * d]].append(c)
    assert Counter(got) == Counter((len(k) // 16, v[0], len(v)) for k, v in members.items())


def test_trie_of_nothing_and_of_no_turns(spark):
    assert tries.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 1, "user", "only") for c in (7, 8, 11)]  # no base: what is left has few turns or none
    assert nodes_found(tries.trie(tries.with_shared_openings(tries.sequences(spark.createDataFrame(rows, SCHEMA))))) == nodes_plainly(rows)


PAGES = "page_id bigint, url string, html string"
LONG = "<p>" + "a page of some length, " * 20 + "é</p>"


def pages():
    rows = [(i, f"http://h{i % 3}.example:80{i % 2}/dir/{i}?q=é {i}", f"<p>page {i}</p>" + "x" * (i % 200)) for i in range(60)]
    rows += [(100 + i, "https://copies.example/", LONG) for i in range(50)] + [(90, None, LONG)]
    rows += [(200, "u", None), (201, "", ""), (202, "http://[bad", "y" * 99), (203, "x", "y" * 99), (204, "line\r\nbreak: x", "z" * 100), (205, "\x01", "z" * 100), (None, "n", "z" * 100), (None, "n", "w" * 100)]
    return rows + [rows[0]]


def archived_plainly(rows):
    least = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            least[h] = min(p, least.get(h, p))
    out = []
    for p, u, h in rows:
        body = (h or "").encode()
        first = least.get(h)
        first = None if first == p else first
        out.append((p, u or "", len(body), hashlib.sha256(body).hexdigest(), "response" if first is None else "revisit", first))
    return Counter(out)


@pytest.mark.parametrize("wide", [False, True])
def test_archives(spark, tmp_path, wide):
    table = spark.createDataFrame(pages(), PAGES).repartition(3).withColumns({"digest": F.lit(1), "page": F.lit(2), "first_page": F.lit(3)})
    got = Counter(tuple(r) for r in warc.archived(table, f"file://{tmp_path}/a b", wide=wide).collect())
    escaped = Counter()
    for row, n in archived_plainly(pages()).items():
        escaped[(row[0], warc.head_line(row[1]), *row[2:])] += n
    assert got == escaped
    for file in (tmp_path / "a b").iterdir():  # any reader of ZIP files reads them
        with zipfile.ZipFile(file) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX, warc.PACKAGE}


def test_small_archives_and_restored_pages(spark, tmp_path):
    table = spark.createDataFrame(pages(), PAGES)
    manifest = warc.write_archives(table, f"file://{tmp_path}", size=500)
    (tmp_path / "left-by-a-lost-task.wacz").write_bytes(b"half of it")
    assert manifest.count() > 5 and manifest.agg(F.sum("n_records")).first()[0] == len(pages())
    back = warc.restored(warc.read_records(warc.index(manifest), with_payload=True))
    want = Counter((p if p is None else str(p), (h or "").encode()) for p, _, h in pages())
    assert Counter((r["page"], bytes(r["payload"])) for r in back.collect()) == want
    assert warc.archived(table.limit(0), f"file://{tmp_path}/none").count() == 0


def test_a_changed_payload_is_told():
    digest = hashlib.sha256(b"written").hexdigest()
    assert warc.parsed(warc.record("1", "u", b"written", digest, None))["payload"] == b"written"
    with pytest.raises(ValueError):
        warc.parsed(warc.record("1", "u", b"changed", digest, None))


def package(data: bytes) -> warc.Package:
    return warc.Package(pa.BufferReader(data))


def test_packages_of_other_writers():
    """Deflated indexes, comments with a signature in them, archives without an index, plain records, ZIP64 fields."""
    one, two = warc.gzipped(warc.record("1", "http://a/", b"one", hashlib.sha256(b"one").hexdigest(), None)), warc.gzipped(warc.record("2", "http://b/", b"two", hashlib.sha256(b"two").hexdigest(), None))
    line = '{"filename": "data.warc.gz", "offset": %d, "length": %d}'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("archive/data.warc.gz", one + two, zipfile.ZIP_STORED)
        z.writestr("indexes/index.cdx", "!meta\n" + f"a) 1 {line % (0, len(one))}\nb) 1 {line % (len(one), len(two))}\n", zipfile.ZIP_DEFLATED)
        z.writestr("archive/unnamed.warc.gz", two, zipfile.ZIP_STORED)
        z.writestr("archive/packed.warc.gz", two, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 and more " + b"x" * 40
    found = package(buffer.getvalue())
    assert found.archives() == ["archive/data.warc.gz", "archive/unnamed.warc.gz"]
    ranges = list(found.records())
    assert [k for k, _, _ in ranges] == [0, 1, 2]
    pages = [warc.parsed(zlib.decompress(buffer.getvalue()[o : o + n], 47))["page"] for _, o, n in ranges]
    assert pages == ["1", "2", "2"]
    with pytest.raises(ValueError):
        package(b"no archive at all" * 3)


@pytest.mark.parametrize("wide", [False, True])
def test_directories(wide):
    members = [(f"archive/é{i}.warc", bytes([i % 256]) * i) for i in range(300)]
    data, begins = warc.zipped(members, wide)
    found = package(data)
    assert {n: found.begin(n) for n in found.members} == dict(zip([n for n, _ in members], begins, strict=True))
    assert all(found.read(n) == d for n, d in members)
    assert (struct.pack("<4s", warc.LOCATOR) in data) == wide
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("archive/é7.warc") == b"\x07" * 7 and len(z.namelist()) == 300


def test_ranges_are_read_together():
    rows = [(0, 10), (10, 10), (9_000_000, 5), (9_000_005, 5_000_000), (14_000_010, 1)]
    assert list(warc.ranges(rows)) == [[(0, 10), (10, 10)], [(9_000_000, 5)], [(9_000_005, 5_000_000)], [(14_000_010, 1)]]


def test_url_keys():
    assert warc.url_key("https://www.A.org:8080/Path?q=1") == "org,a,www:8080)/path?q=1" and warc.url_key("http://b.de") == "de,b)/"
    assert " " not in warc.url_key("http://x.y/a b\n") and urllib.parse.unquote(warc.page_of(warc.urn("a/b c"))) == "a/b c"
