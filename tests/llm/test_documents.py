"""The operators over documents against brute force, on rows with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.llm import common, op02_chosen_path, op03_cotraining, op04_patched_for, op05_fm_index, op07_suffixes, op08_outliers, op09_mixing, op10_language, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names are those of helpers.
CLASH = ("size", "rate", "copies", "node", "path", "doc", "score", "lang_pred", "n_words", "item_ids", "spans", "kept", "level", "bucket")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words(rng, 120)
    near = [*base[:60], "changed", *base[61:]]
    out = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(base), "en", "a", 1), (3, " ".join(near), "en", "b", 1), (4, None, "en", "a", None), (5, "", None, None, 0), (6, "one two", "fr", "b", 7),
        (7, "one two", "fr", "b", 7), (8, "\n\n  \n", "fr", None, 5), (9, "### *** ...", None, "c", 9), (10, " ".join(words(rng, 30000)), "en", "c", 0), (11, ("same line here\n" * 300), "de", "c", 0),
        (None, "a null id has a text too, of more than ten words in all, to be sure", "en", "a", 1), (12, "Été à Paris — “guillemets”… naïve. " * 9, "fr", "a", 2), (13, "a" * 5000, "en", "a", 3),
        (14, "passage before " + " ".join(base[20:50]) + " and after", "en", "b", 4),
    ]
    out += [out[2], out[5]]  # repeated rows
    for i in range(60):
        t = words(rng, rng.randrange(40, 90))
        out.append((100 + i, " ".join(t).capitalize() + ".", rng.choice(["en", "fr"]), rng.choice("abc"), 1))
    out += [(200 + i, " ".join([*base[: 100 + i % 7], f"tail{i}"]), "en", "hot", 1) for i in range(40)]  # a group of near copies
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingled(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize("small,block", [(1000, 256), (4, 3)])
def test_join_finds_every_link(docs, rows, monkeypatch, small, block):
    monkeypatch.setattr(op02_chosen_path, "BLOCK", block)
    monkeypatch.setattr(op02_chosen_path.candidates, "__defaults__", (small, op02_chosen_path.DEPTH, op02_chosen_path.RECALL))
    sets = [(i, shingled(t)) for i, t, *_ in rows]
    links = [[b for b in range(len(sets)) if b != a and sets[a][1] and 5 * len(sets[a][1] & sets[b][1]) >= 4 * len(sets[a][1] | sets[b][1])] for a in range(len(sets))]
    root = list(range(len(sets)))
    for _ in sets:
        for a, near in enumerate(links):
            root[a] = min([root[a], *[root[b] for b in near]])
    least = [min((sets[b][0] for b in range(len(sets)) if root[b] == root[a] and sets[b][0] is not None), default=None) for a in range(len(sets))]
    want = Counter((sets[a][0], least[a], len(links[a])) for a in range(len(sets)))
    assert Counter(tuple(r) for r in op02_chosen_path.classes(docs).collect()) == want


def test_join_keeps_one_of_each_class(clashing, rows):
    kept = op02_chosen_path.distinct_documents(clashing)
    assert kept.columns == clashing.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == ids[7] == 0 and ids[6] == 1
    assert {4, 5, 8, 9} <= set(ids)  # nothing to compare


def test_rows_of_one_id_are_told_apart(spark):
    a, u, z = "all the words of text a are here", "some other unique text is in this row", "and one more of its own to see"
    rows = [(1, a), (7, a), (7, u), (None, a), (9, z), (9, z), (None, u + "!"), (None, z), (None, None), (None, None), (9, "..."), (9, "..."), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({"doc": F.lit(1), "print": F.lit(2), "root": F.lit("r"), "n": F.lit(0)})
    got = op02_chosen_path.distinct_documents(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, a), (7, u), (9, z), (None, None), (None, None), (9, "..."), (9, "..."), (12, None)])


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(80)] + [(7, 7), (9, 8), (8, 9)] + [(-3, 500)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: 100 for n in range(100, 161)} | {501 + i: -3 for i in range(80)} | {500: -3, -3: -3, 7: 7, 8: 8, 9: 8}
    assert found == want


def test_join_of_nothing(empty):
    assert op02_chosen_path.classes(empty).count() == 0 and op02_chosen_path.distinct_documents(empty).count() == 0


def test_recall_bound():
    n = op02_chosen_path.runs_for(0.9995)
    assert 1 - (1 - op02_chosen_path.survival(op02_chosen_path.DEPTH)) ** n >= 0.9995


def test_tokens_round_trip(docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    at, want = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in op04_patched_for.tokens(docs, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tokens_of_nothing(empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert op04_patched_for.tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("values", [[], [7], [0] * 700, list(range(2000)), [5] * 511 + [4_000_000_000], [1, 2**32 - 1] * 900])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    index, data = op04_patched_for.pack(ids)
    assert op04_patched_for.unpack(index, data).tolist() == values
    if len(values) > 600:
        assert op04_patched_for.block_ids(index, data, len(values), 510, 530).tolist() == values[510:530]


def test_random_blocks():
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(30):
        ids = rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(1, 3000)), dtype=np.uint64).astype(np.uint32)
        assert (op04_patched_for.unpack(*op04_patched_for.pack(ids)) == ids).all()


def test_encoder_cuts_texts_safely():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = op04_patched_for.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = [*"ab.,'  \n_#é中1²\t\x1fs-!?“…×", "'s", " the", "...", " .", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


@pytest.mark.parametrize("slots", [2, 64, 1 << 20])
def test_encoder_with_any_number_of_slots(slots, monkeypatch):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(op04_patched_for, "SLOTS", slots)
    encoder = op04_patched_for.Encoder(queries.tokenizer_file())
    rng = random.Random(3)
    words = ["".join(rng.choice("abzéß中Q") for _ in range(n)) for n in range(24) for _ in range(6)] + ["\0", "a\0", "…" * 9, "x" * 7, "x" * 8, "x" * 15, "x" * 16]
    texts = ["", *(rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", ",", ". ", "\n"]) for _ in range(rng.randrange(40))) + rng.choice(words) for _ in range(300)), ""]
    for _ in range(2):
        assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]


def test_encoder_remembers_many_words():
    """Words that a worker has encoded stay known over some MB of other words."""
    pytest.importorskip("public_tokenizers")
    encoder = op04_patched_for.Encoder(queries.tokenizer_file())

    class Counting:
        def __init__(self, inner):
            self.inner, self.bytes = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.bytes += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **options)

    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(400_000)]
    texts = [" ".join(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    seen = []
    for _ in range(2):
        counting.bytes = 0
        for text in texts:
            encoder.encode([text])
        seen.append(counting.bytes)
    assert 0 < seen[1] < seen[0] / 2


BENCHMARK = [(1, None), (2, ""), (3, "one two"), (4, "w1x w2x w3x"), (4, "repeated id")]


@pytest.fixture(scope="module")
def benchmark_rows(rows):
    base = rows[0][1].split()
    return [*BENCHMARK, (10, " ".join(base[20:45]).upper()), (11, " ".join(base[30:41])), (12, " ".join(base[30:41])), (77, "not in any of the documents, this one, I am very sure")]


def contaminated(rows, items):
    wordlist = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = wordlist(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, found = wordlist(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def test_index_finds_every_window(spark, docs, rows, benchmark_rows):
    items = spark.createDataFrame(benchmark_rows, "item_id bigint, text string")
    want = contaminated(rows, benchmark_rows)
    got = op05_fm_index.digest(op05_fm_index.contamination(docs, items)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    blocks = op05_fm_index.digest(op05_fm_index.contamination(docs.dropDuplicates(["doc_id"]), items, block_words=12)).collect()
    assert set(map(tuple, blocks)) == set(want)


def test_decontamination_cuts_spans(spark, clashing, rows, benchmark_rows):
    items = spark.createDataFrame(benchmark_rows, "item_id bigint, text string")
    got = op05_fm_index.decontaminated(clashing, items)
    assert got.columns == clashing.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    base = rows[0][1].split()
    assert " ".join(base[20:45]) not in texts[14][0] and texts[14][0].startswith("passage before ") and texts[14][0].endswith("and after")
    assert texts[4] == (None, None) and texts[5] == ("", 0) and texts[100][0] == next(r[1] for r in rows if r[0] == 100)


def test_blocks_cut_what_one_block_cuts(spark):
    w = [f"q{i}" for i in range(40)]
    items = [(1, " ".join(w[:14])), (2, " ".join(w[8:24])), (3, " ".join(w[24:36])), (4, " ".join(["left", *w[30:39]])), (5, "lone words"), (6, "lone left right words")]
    texts = [f"Left {' '.join(w)} right, words", f"a lone {' '.join(w[8:24])} words", f"left {' '.join(w[24:36])} {' '.join(w[31:39])}", f"left - {' '.join(w[:14])}; {' '.join(w[30:39])}", None, "", "clean"]
    rows = [(i, t, "en", "a", None if t is None else len(t)) for i, t in enumerate(texts)] + [(0, texts[1], "en", "a", 3), (0, texts[0], "en", "a", 4)]
    docs, benchmark = spark.createDataFrame(rows, SCHEMA).withColumn("n words", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string")
    assert len(list(op05_fm_index.item_blocks(benchmark, 6))) > 3
    one, many = op05_fm_index.decontaminated(docs, benchmark), op05_fm_index.decontaminated(docs, benchmark, block_words=6)
    assert many.columns == docs.columns and Counter(map(tuple, many.collect())) == Counter(map(tuple, one.collect()))


def test_repeated_rows_are_judged_each_in_blocks(spark, docs, rows, benchmark_rows):
    items = spark.createDataFrame(benchmark_rows, "item_id bigint, text string")
    other = " ".join(["before", *rows[0][1].split()[30:41], "after"])
    extra = [(14, other, "en", "b", 4), (14, " ".join(["clean"] * len(other.split())), "en", "b", 4)]
    every = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = op05_fm_index.digest(op05_fm_index.contamination(every, items, block_words=12)).collect()
    assert Counter(map(tuple, got)) == Counter(contaminated([*rows, *extra], benchmark_rows))


@pytest.mark.parametrize("kind,names", [("bigint", [5, None, 7]), ("string", ["b", None, "a"])])
@pytest.mark.parametrize("block_words", [3, 100])
def test_item_ids_of_any_kind(spark, kind, names, block_words):
    texts = ["one two three", "one two three", "two three four five"]
    items = spark.createDataFrame(list(zip(names, texts, strict=True)), f"item_id {kind}, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six"), (2, "none of it"), (3, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in op05_fm_index.contamination(docs, items, block_words=block_words).collect()}
    assert found[1]["item_ids"] == sorted([n for n in names if n is not None]) + [None] and found[2]["item_ids"] == found[3]["item_ids"] == []
    digest = {r["doc_id"]: r for r in op05_fm_index.digest(op05_fm_index.contamination(docs, items)).collect()}
    assert digest[1]["n_items"] == 3 and digest[1]["items_sha256"] == hashlib.sha256(",".join(sorted("" if n is None else str(n) for n in names)).encode()).hexdigest()


def test_index_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert op05_fm_index.contamination(docs, none).filter("size(hit_spans) > 0").count() == 0
    assert op05_fm_index.contamination(empty, none).count() == 0


def without_repeats(rows, length):
    first: dict[bytes, int] = {}
    texts = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(i, first.get(b[s : s + length], i))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want.append((None if i == -(1 << 63) else i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(want)


@pytest.mark.parametrize("length,prefix,piece", [(50, 16, 1 << 20), (20, 7, 1 << 20), (50, 24, 1 << 20), (50, 24, 1500)])
def test_repeated_strings_against_brute_force(docs, rows, length, prefix, piece):
    got = op07_suffixes.digest(op07_suffixes.deduplicated(docs, length=length, prefix=prefix, piece_bytes=piece)).collect()
    assert Counter(map(tuple, got)) == without_repeats([r[:2] for r in rows], length)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_prefixes_that_go_on_in_many_ways(spark, parts):
    rng = np.random.Generator(np.random.PCG64(9))
    starts = rng.integers(97, 123, (40000, 24), dtype=np.uint8)
    hot = starts[op07_suffixes.Prints(starts.reshape(-1)).of(np.arange(40000) * 24, np.arange(1, 40001) * 24).argmin()].tobytes().decode()
    tail = lambda n, letters: "".join(chr(97 + c) for c in rng.integers(0, letters, n))
    rows = [(i, tail(int(rng.integers(0, 40)), 26) + hot + "same" + tail(9, 2) + "the rest of it is like this " + tail(int(rng.integers(0, 12)), 2)) for i in range(600)]
    rows += [(int(rng.integers(0, 600)), rows[i][1]) for i in range(0, 600, 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = Counter(map(tuple, op07_suffixes.digest(op07_suffixes.deduplicated(docs)).collect()))
    assert got == without_repeats(rows, 50) and sum(n for (_, _, gone, *_), n in got.items() if gone) > 100


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(op07_suffixes, "PIECE", 200)
    data = np.frombuffer(bytes(range(97, 122)) * 40, np.uint8)
    seen = []
    for piece, row, base, bounds in op07_suffixes.packs(data, np.array([0, 30, 900, 1000]), 50):
        for r, b, a, e in zip(row, base, bounds[:-1], bounds[1:], strict=True):
            seen += [(r, b + s) for s in range(e - a - 49)]
            assert len(piece) <= 200
    assert sorted(seen) == [(1, s) for s in range(821)] + [(2, s) for s in range(51)]


def test_stretches_of_a_hot_prefix_are_told_apart(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    letters = lambda *shape: rng.integers(97, 123, shape, dtype=np.uint8)
    prints = lambda rows, n: op07_suffixes.Prints(rows.reshape(-1)).of(np.arange(len(rows)) * n, np.arange(1, len(rows) + 1) * n)
    starts = letters(40000, 24)
    hot = starts[prints(starts, 24).argmin()]  # its hash is the least in each window, so each text has its place there
    texts = np.column_stack([np.broadcast_to(hot, (200000, 24)), letters(200000, 26)])
    low = (np.concatenate([prints(part, 50) for part in np.split(texts, 10)]) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    _, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
    alike = texts[count[inverse] > 1]
    found = np.unique(alike, axis=0)
    assert len(found) == len(alike) > 4
    docs = spark.createDataFrame([(i, bytes(t).decode()) for i, t in enumerate(found)], "doc_id bigint, text string").repartition(2)
    assert {r["doc_id"]: bytes(r["kept"]) for r in op07_suffixes.deduplicated(docs).collect()} == {i: bytes(t) for i, t in enumerate(found)}


def test_repeated_strings_of_nothing(empty):
    assert op07_suffixes.deduplicated(empty).count() == 0


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(docs, rows):
    got = op08_outliers.quality_rules(docs).collect()
    assert Counter((r["doc_id"], *r[1:6]) for r in got) == Counter((i, *statistics(t)) for i, t, *_ in rows)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


@pytest.mark.parametrize("position_bits", [60, 62, 5])
def test_windows_of_equal_hash_are_told_apart(docs, rows, position_bits):
    """With a hash of 4 or 2 bits almost all neighbours differ; with 5 bits for places longer texts don't fit."""
    got = op08_outliers.base_statistics(docs, keep=(), position_bits=position_bits).collect()
    assert Counter(map(tuple, got)) == Counter((i, *statistics(t)) for i, t, *_ in rows)


def test_outliers_against_a_plain_estimate(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    good = rng.multivariate_normal([5, 5, 0.5, 0, 0], np.diag([1, 0.2, 0.1, 0.01, 0.01]), 400)
    bad = rng.multivariate_normal([5, 9, 6, 4, 4], np.diag([0.1] * 5), 80)
    rows = [("en", "s", *map(float, x)) for x in np.vstack([good, bad])] + [("de", None, *map(float, x)) for x in good[:10]]
    vectors = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"v{i} double" for i in range(5)))
    found = {(r["lang"], r["source"]): r for r in op08_outliers.estimates(vectors).collect()}
    assert {k: e["n"] for k, e in found.items()} == {("en", "s"): 480, ("de", None): 10}
    e = found["en", "s"]
    assert np.allclose([e[f"m{i}"] for i in range(5)], good.mean(0), atol=0.3)
    low = np.array([[e[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    distance = lambda x: (np.linalg.solve(low, (x - np.array([e[f"m{i}"] for i in range(5)])).T) ** 2).sum(0)
    assert (distance(bad) > op08_outliers.CUTOFF).all() and (distance(good) < op08_outliers.CUTOFF).mean() > 0.99


def least_determinant(x):
    """Mean and floored covariance of the three quarters of the rows whose covariance has the least determinant."""
    floors = np.diag(np.array(op08_outliers.FLOORS) ** 2)
    subsets = [x[list(c)] for c in itertools.combinations(range(len(x)), math.ceil(len(x) * op08_outliers.SUBSET))]
    return min(((s.mean(0), np.cov(s.T, bias=True) + floors) for s in subsets), key=lambda e: np.linalg.det(e[1]))


@pytest.mark.parametrize("seed", range(3))
def test_outliers_against_all_subsets(spark, seed):
    """Verdicts of groups of 7 and 8 vectors, each drawn towards its language's and all texts' estimate."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = rng.multivariate_normal([5, 5, 0.5, 0.2, 0.2], np.diag([0.5, 0.1, 0.1, 0.01, 0.01]), 15)
    bad = {2, 9}
    for i in bad:
        x[i] += [0, 5, 6, 4, 5]
    groups = {("en", "a"): range(7), ("en", None): range(7, 15)}
    rows = [(*g, *map(float, x[i])) for g, of in groups.items() for i in of]
    vectors = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"v{i} double" for i in range(5)))
    found = op08_outliers.shrunk(op08_outliers.estimates(op08_outliers.levelled(vectors), group=op08_outliers.LEVELS)).collect()
    lang = least_determinant(x)  # all texts are of one language
    assert len(found) == len(groups)
    for e in found:
        of = groups[e["lang"], e["source"]]
        own, w = least_determinant(x[list(of)]), len(of) / (len(of) + op08_outliers.PRIOR)
        mean, cov = (w * a + (1 - w) * b for a, b in zip(own, lang, strict=True))
        plain = {i for i in of if (x[i] - mean) @ np.linalg.solve(cov, x[i] - mean) > op08_outliers.CUTOFF}
        low = np.array([[e[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
        got = {i for i in of if (np.linalg.solve(low, x[i] - np.array([e[f"m{k}"] for k in range(5)])) ** 2).sum() > op08_outliers.CUTOFF}
        assert got == plain == bad & set(of)


def test_no_number_of_texts_is_a_switch(spark):
    """As a group grows by one, the distance of a text changes little, around the prior too."""
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.multivariate_normal([5, 5, 0.5, 0.2, 0.2], np.diag([0.5, 0.1, 0.1, 0.01, 0.01]), 141)
    x[:41, 1] += 1  # the group's words are longer than its language's
    at = []
    for n in (39, 40, 41):
        rows = [("en", "a", *map(float, v)) for v in x[:n]] + [("en", "b", *map(float, v)) for v in x[41:]]
        vectors = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"v{i} double" for i in range(5)))
        e = next(r for r in op08_outliers.shrunk(op08_outliers.estimates(op08_outliers.levelled(vectors), group=op08_outliers.LEVELS)).collect() if r["source"] == "a")
        at.append(e["m1"])
    assert 5.2 < at[1] < 5.8 and max(at) - min(at) < 0.1


@pytest.mark.parametrize("n", [6, 30])
def test_small_groups_are_judged(spark, n):
    rng = random.Random(n)
    junk = lambda k: " ".join(f"{w}$$$%%%###&&&{k}" for w in words(rng, 60, 10**6))
    groups = [("en", "a"), ("en", "b"), ("fr", "a"), (None, "c")]
    rows = [(100 * g + i, " ".join(words(rng, rng.randrange(60, 90), 10**6)), *of, 1) for g, of in enumerate(groups) for i in range(n)]
    rows += [(1000 + g, junk(g), *of, 1) for g, of in enumerate(groups)]
    got = {r["doc_id"]: r for r in op08_outliers.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and all(r["distance"] is not None for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {1000 + g for g in range(len(groups))}


def test_outliers_of_nothing(empty):
    assert op08_outliers.quality_rules(empty).count() == 0


def test_mix_meets_its_targets(docs, rows):
    got = op09_mixing.mixing_report(docs).collect()
    assert len(got) == len(rows)
    sizes: Counter = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += statistics(t)[0]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, rest = {}, set(), 1.5 * sum(sizes.values())
    while True:
        left = rest - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            target = share | {s: 2 * sizes[s] for s in full}
            break
        full |= over
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
    assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(op09_mixing.mixing_report(docs.repartition(5)).collect(), key=str)]


def test_mix_repeats_documents(clashing):
    report = Counter()
    for r in op09_mixing.mixing_report(clashing).collect():
        report[r["doc_id"]] += r["copies"]
    mixed = op09_mixing.mixed(clashing)
    assert mixed.columns == clashing.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +report


def test_mix_of_nothing(empty):
    assert op09_mixing.mixing_report(empty).count() == 0 and op09_mixing.mixed(empty).count() == 0


def profile_of(texts):
    counts: Counter = Counter()
    for t in texts:
        s = re.sub(r"\s+", " ", " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " ")
        for n in (1, 2, 3):
            counts.update(g for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g != " ")
    code = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
    return {code(g): n for g, n in counts.items()}


def test_ngrams_against_a_counter():
    texts = ["Été, à Paris!", "", "123", "ab  ab\nab", "ÜBER über"]
    owner, gram, n = op10_language.counted(texts)
    for k, t in enumerate(texts):
        own = owner == k
        got = dict(zip(gram[own].tolist(), n[own].tolist(), strict=True))
        assert got == profile_of([t])


def test_languages(spark):
    rng = random.Random(1)
    vocabulary = {"en": "the of and house water under".split(), "fr": "le été où maison être eau".split(), "de": "der und über häuser wasser straße".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=30)), lang) for i in range(300) for lang in [rng.choice(list(vocabulary))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "fr"), (1003, "the house", None), (None, "der und das", "de"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = op10_language.languages(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [found[i] for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1003] == "en" and found[None] == "de"
    assert all(found[i] == lang for i, _, lang in rows[:300])
    extra = docs.withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "source": F.lit("s")})
    kept = op10_language.in_known_language(extra)
    assert kept.columns == extra.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() == len(rows) - 3


def test_languages_in_blocks_and_their_places_and_distances(spark):
    rng = random.Random(3)
    langs = [f"l{k}" for k in range(7)]
    letters = {lang: "".join(rng.sample("abcdefghijklmnop", 8)) for lang in langs}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(2, 7))) for _ in range(rng.randrange(1, 25))), lang) for i in range(200) for lang in [rng.choice(langs)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    size = 60
    ranked = lambda counts: {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size], 1)}
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    profiles = {lang: ranked(profile_of([t for _, t, own in learn if own == lang])) for lang in langs}
    assert op10_language.profiles_of(docs, size=size) == profiles
    want = {}
    for i, t, _ in rows:
        own = ranked(profile_of([t]))
        far = {lang: sum(min(size, abs(p - profiles[lang][g])) if g in profiles[lang] else size for g, p in own.items()) for lang in langs}
        best = min(langs, key=lambda lang: (far[lang], lang))
        want[i] = (best, pytest.approx(1 - far[best] / (size * len(own))))
    for most in (500, 2, 3):
        got = op10_language.identified(docs, profiles, ["doc_id"], size, most).collect()
        assert {r["doc_id"]: (r[1], r[2]) for r in got} == want


def test_texts_in_no_known_language_go(spark):
    rng = random.Random(6)
    known = [(i, " ".join(rng.choices("the of and house water under stone bread".split(), k=20)), "en") for i in range(60)]
    other = [(100 + i, " ".join(rng.choices("жизнь вода хлеб камень дорога".split(), k=20)), None) for i in range(10)]
    kept = op10_language.in_known_language(spark.createDataFrame(known + other, "doc_id bigint, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in known}


def test_languages_of_nothing(spark, empty):
    assert op10_language.languages(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in op10_language.languages(unlabelled).collect()] == ["und"]


def test_cotraining_ranks_good_texts_higher(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        t = " ".join(words(rng, 80)) if good else " ".join(w.upper() + "$$$" for w in words(rng, 80))
        rows.append((i, t, "en", "a"))
        if i % 3 == 0:
            labels.append((i, int(good)))
    rows += [(None, None, None, None), (700, "", None, "b"), (0, rows[0][1], "en", "a")]
    labels += [(0, labels[0][1]), (5000, 1), (None, 0), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("score", F.lit(1))
    got = op03_cotraining.classified(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["good"] == ("$" not in rows[r["doc_id"]][1])


def area_under_curve(pairs):
    good, bad = ([x for x, y in pairs if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_rounds_do_no_harm_and_views_add_up(spark):
    """On documents whose labels were never given: text tells four of five apart, the source three of four."""
    rng = random.Random(11)
    truth, rows = {}, []
    for i in range(1500):
        truth[i] = good = int(rng.random() < 0.5)
        style = good if rng.random() < 0.8 else 1 - good
        pool = [f"w{k}x" for k in (range(0, 300) if style else range(200, 500))]
        source = rng.choice("abc" if (good if rng.random() < 0.75 else 1 - good) else "def")
        rows.append((i, " ".join(rng.choices(pool, k=60)), "en", source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(300)], "doc_id bigint, quality int")
    area = {}
    for rounds in (0, 3):
        got = [r for r in op03_cotraining.classified(docs, labels, rounds=rounds).collect() if r["doc_id"] >= 300]
        area[rounds] = {c: area_under_curve([(r[c], truth[r["doc_id"]]) for r in got]) for c in ("text_score", "meta_score", "score")}
    assert all(area[3][c] > area[0][c] - 0.02 for c in area[0])
    assert area[3]["score"] > max(area[3]["text_score"], area[3]["meta_score"])


def test_metadata_view_has_no_characters(spark):
    """Texts of equal size and lines have the same metadata view, whatever their characters are."""
    rows = [(1, "plain words\nof text", "en", "a"), (2, "$$$$$ 12345\nOF TEXT", "en", "a"), (3, "plain words\nof text", "en", "b"), (4, "plain\nwords of\ntext", "en", "a")]
    got = {r["doc"]: r for r in op03_cotraining.features(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[1]["meta"] == got[2]["meta"] and got[1]["content"] != got[2]["content"]
    assert got[1]["content"] == got[3]["content"] and len({got[i]["meta"] for i in (1, 3, 4)}) == 3


def test_cotraining_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in op03_cotraining.classified(docs, none).collect()} == {0.5}
    assert op03_cotraining.classified(empty, none).count() == 0


def test_decontamination_is_one_trip_to_python(spark, docs, benchmark_rows):
    items = spark.createDataFrame(benchmark_rows, "item_id bigint, text string")
    plan = op05_fm_index.decontaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_whole_texts_come_in_batches_of_about_a_megabyte(spark):
    common.small_batches(spark)
    docs = spark.range(1000).coalesce(1).selectExpr("id", "repeat('x', IF(id = 7, 3000000, 20000)) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [sum(len(t.as_py()) for t in b.column("text"))]}) for b in batches)
    got = docs.mapInArrow(common.tidy(sizes), "rows bigint, bytes bigint").collect()
    assert sum(r["rows"] for r in got) == 1000 and sum(r["bytes"] for r in got) == 999 * 20_000 + 3_000_000
    assert max(r["bytes"] for r in got) < 4_200_000 and sorted(r["bytes"] for r in got)[-2] < 1_100_000


def test_other_functions_let_go_of_the_encoder():
    path = queries.tokenizer_file()
    first = op04_patched_for.encoder(path)
    assert list(common.tidy(lambda batches: iter([op04_patched_for.encoder(path) is first]), keep=True)(iter(()))) == [True]
    assert list(common.tidy(lambda batches: iter([op04_patched_for.encoder.cache_info().currsize]))(iter(()))) == [0]
