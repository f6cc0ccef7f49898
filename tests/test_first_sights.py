"""Identities within a batch, against materials taken one after the other."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

from presswork.operators import ingest as I


def one_by_one(rows, keys, urls):
    """seq -> the article (known id or leading seq) of materials (seq, source, url, key) in order."""
    keys, urls, out = dict(keys), dict(urls), {}
    for seq, source, url, key in rows:
        mark = (source.lower(), key) if key else None
        found = keys.get(mark) if mark else None
        found = urls.get((source, url)) if found is None else found
        if found is None:
            found = urls[source, url] = ("new", seq)
            if mark:
                keys[mark] = found
        out[seq] = found
    return out


def sights(spark, rows):
    table = spark.createDataFrame([(q, s.lower(), k, s, u) for q, s, u, k in rows], "seq int, name string, mark string, source string, source_url string")
    return {r["seq"]: ("new", r["leader"]) for r in I.first_sights(table).collect()}


def test_chains(spark):
    rows = [(1, "s", "u1", "A"), (2, "s", "u1", "B"), (3, "s", "u3", "B"), (4, "s", "u1", "B"), (5, "s", "u3", None), (6, "S", "u9", "A"), (7, "S", "u1", None), (8, "s", "u2", "A"), (9, "s", "u2", None)]
    want = one_by_one(rows, {}, {})
    assert want[5] == want[3] == ("new", 3) and want[2] == ("new", 1) and want[9] == ("new", 9)
    assert sights(spark, rows) == want
    assert sights(spark, []) == {}


def test_random_batches(spark):
    draw = random.Random(13)
    rows = [(i, "s", f"g{g}-{draw.randrange(4)}", draw.choice([None, *(f"g{g}-{k}" for k in range(4))])) for i, g in enumerate(draw.choices(range(12), k=150))]
    assert sights(spark, rows) == one_by_one(rows, {}, {})


def test_upserts(spark):
    """Batches over known articles give as many articles, with the same last titles, as one material after the other."""
    draw = random.Random(17)
    state = [(i, "s", f"u{i}", f"k{i}" if i % 2 else None, "t0", "t", "b", 0, "{}", [1], "B", 0, "RECEIVED", datetime(2024, 1, 1), datetime(2024, 1, 1)) for i in range(4)]
    kinds = "id bigint, source string, source_url string, origin_key string, title_original string, title string, body string, upstream_archive_id bigint, raw string, tab_ids array<bigint>, level string, publish_mode int, status string, updated_at timestamp_ntz, last_seen_at timestamp_ntz"
    rows = [(i, "s", f"u{draw.randrange(9)}", draw.choice([None, *(f"k{k}" for k in range(9))])) for i in range(60)]
    batch = [(q, s, u, k, f"t{q}", "b", 0, "{}", [2], False, datetime(2024, 2, 1)) for q, s, u, k in rows]
    made = "seq bigint, source string, source_url string, origin_key string, title string, body string, upstream_archive_id bigint, raw string, tab_ids array<bigint>, abandoned boolean, seen_at timestamp_ntz"
    got = I.upserted(spark.createDataFrame(state, kinds), spark.createDataFrame(batch, made)).collect()
    want = one_by_one(rows, {("s", f"k{i}"): i for i in (1, 3)}, {("s", f"u{i}"): i for i in range(4)})
    last = {}
    for q, article in want.items():
        last[article] = f"t{q}"
    titles = Counter(last.values()) + Counter("t0" for i in range(4) if i not in last)
    assert Counter(r["title_original"] for r in got) == titles
