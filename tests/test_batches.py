from __future__ import annotations

import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from presswork.functions import html as H, index as I, text as X
from presswork.plans.report_queries import events_of

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_whole_texts_go_to_python_in_small_batches(spark):
    held = spark.conf.get(ROWS)
    rows = spark.createDataFrame([(1, "<p>a <a href='/x'>b</a></p>")], "page_id bigint, body_html string")
    try:
        for used in (lambda: rows.select(H.text_of("body_html")), lambda: I.part_table(rows, "page_id"), lambda: H.cleaned(rows)):
            spark.conf.set(ROWS, "10000")
            assert used().count() >= 1 and int(spark.conf.get(ROWS)) <= 1024
    finally:
        spark.conf.set(ROWS, held)


def test_plain_text_of_a_stretch_equals_the_decoded_one(monkeypatch):
    draw = random.Random(3)
    pieces = ["<b>", "</b>", "<>", "<", ">", "&amp;", "&amp", "&#65;", "&#x1f;", "&nbsp;", "&no;", "&", "\x1c", "\u3000", "\n", " ", "a", "é", "&a<i>mp;", "&lt;b&gt;"]
    for _ in range(3000):
        source = "".join(draw.choices(pieces, k=draw.randrange(12)))
        assert I.plain(source) == I.decoded(source, 0, len(source))[0]
    monkeypatch.setattr(I, "decoded", None)  # the index has no need of places
    assert [p.text for p in I.parts("<p>a &amp; <b>b</b><br>c</p>")] == ["a & b c", "a & b", "c"]


def test_problems_work_a_text_out_once(spark):
    plan = spark.range(1).select(X.body_problems(F.translate(F.repeat(F.lit("x"), 40), "x", "y"))).select("*")._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") < 4, plan
    assert spark.sql("SELECT '点击购买门票' AS t UNION ALL SELECT NULL").select(X.body_problems(F.col("t")).alias("p")).filter("p IS NOT NULL").first()["p"][0] == "short"


def test_a_window_is_read_in_batches(tmp_path, monkeypatch):
    import pyarrow.dataset as ds

    at = [datetime(2024, 1, 2, i % 6) for i in range(20_000)]
    pq.write_table(pa.table({"ts": at, "event_type": ["view", "click"] * 10_000, "props": ['{"k": "a"}', "{}"] * 10_000}), tmp_path / "e.parquet")
    whole = ds.dataset

    class Batches:
        def __init__(self, path):
            self.to_batches = whole(path).to_batches

    monkeypatch.setattr(ds, "dataset", Batches)
    assert dict(events_of(str(tmp_path / "e.parquet"))(datetime(2024, 1, 2), datetime(2024, 1, 2, 3))) == {"a": 6667}
