"""Ids that are null or no numbers."""

from __future__ import annotations

import time
from collections import Counter

from presswork.llm import op02_chosen_path as paths, op07_suffixes as suffixes


def near(i: int) -> str:
    return " ".join(f"w{i}-{k}" for k in range(40))


def test_many_null_ids(spark):
    """Different texts of null ids: each set meets the text that it comes from, not all of them."""
    rows = [(None, f"{near(i)} {end}") for i in range(500) for end in ("one", "two")]
    began = time.time()
    got = Counter(r["n_links"] for r in paths.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter({1: 1000}) and time.time() - began < 120


def test_ids_that_are_no_numbers(spark):
    rows = [("a", f"{near(1)} one"), ("b", f"{near(1)} two"), ("3", near(2)), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert Counter(r["n_links"] for r in paths.classes(docs).collect()) == Counter({1: 2, 0: 2})
    assert suffixes.digest(suffixes.deduplicated(docs)).count() == 4
