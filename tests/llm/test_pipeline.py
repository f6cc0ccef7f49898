"""The pipeline's stages over a small folder, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BENCHMARK = " ".join(f"bench{i}" for i in range(14))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    vocabulary = {"en": [f"the{a}{b}" for a in "abcdefgh" for b in "aeiou"], "fr": [f"été{a}{b}" for a in "mnpqrstv" for b in "éèàùç"]}
    text = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        rows.append((i, text(lang, rng.randrange(30, 80)), lang, rng.choice(["a", "b", "c", None]), 1))
    rows += [(200 + i, rows[i][1] + (" more" if i % 2 else ""), rows[i][2], "a", 1) for i in range(10)]
    rows += [(300 + i, f"{text('en', 20)} {BENCHMARK} {text('en', 20)}", "en", "b", 1) for i in range(5)]
    rows += [(400, None, "en", "a", None), (401, "", None, "a", 0), (402, "12 34", "fr", "a", 5), rows[3]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCHMARK), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_pipeline_against_brute_force(spark, folder):
    path, rows = folder
    docs = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    sets = []
    for r in docs:
        w = re.findall(r"\w+", r[1].lower())
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    root = list(range(len(docs)))
    for _ in range(5):
        for a in range(len(docs)):
            root[a] = min([root[a], *[root[b] for b in range(len(docs)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]])
    least = {}
    for a, r in enumerate(docs):
        least[root[a]] = min(least.get(root[a], (1 << 60,)), r)
    kept = [(r[0], re.sub(f" {BENCHMARK} ", "  ", r[1]), r[3]) for r in least.values()]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in kept}
    per = Counter()
    for i, _, s in kept:
        per[s] += size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        level = (1.5 * sum(per.values()) - sum(2 * per[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 2 * per[s]}
        if not over:
            break
        full |= over
    rate = {s: 2.0 if s in full else level * weight[s] / per[s] for s in order}
    draw = lambda i, k: int(hashlib.sha256(str(i).encode()).hexdigest()[8 * k : 8 * k + 8], 16) / 2**32
    best = {}
    for s in order:
        whole, part = int(rate[s]), rate[s] - int(rate[s])
        off = [abs(whole * per[s] + sum(size[i] for i, _, x in kept if x == s and draw(i, k) < part) - rate[s] * per[s]) for k in range(8)]
        best[s] = off.index(min(off))
    mixed = sorted((i, t) for i, t, s in kept for _ in range(int(rate[s]) + (draw(i, best[s]) < rate[s] - int(rate[s]))))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for i, text in mixed:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(tuple(r) for r in got) == want


def test_stages_keep_columns_of_any_name(spark, folder):
    path, rows = folder
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "n_words", "rate", "doc", "node", "text_")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(docs.columns) == 11, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count()


def test_stages_of_nothing(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
    assert docs.count() == 0
