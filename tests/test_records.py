"""Quality records, ledgers of periods and tallies of runs by hand-typed cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswork.functions import quality as Q
from presswork.operators import records as K, reports as R, search as S

BODY = "这是一篇足够长的正文，讲述了一场比赛的经过和结果，双方都有机会，最后主队获胜。"
ANSWER = {"title_complete": True, "body_complete": True, "has_dirty": False, "needs_review": False, "reason": "因为", "plans": 0, "keeps_body": False}


def record(spark, body=BODY, title="一个完整的标题", answer=None, channels=(1,), regions=("香港",)):
    rows = spark.createDataFrame([(1, title, body, list(channels) if channels is not None else None)], "id int, title string, body string, channels array<int>")
    kinds = "id int, title_complete boolean, body_complete boolean, has_dirty boolean, needs_review boolean, reason string, plans int, keeps_body boolean"
    answers = spark.createDataFrame([] if answer is None else [(1, *(ANSWER | answer).values())], kinds)
    row = Q.evaluated(rows, answers, list(regions)).first()
    return row["decision"], row["reason"], {k: v for k, v in row["issues"].items() if v}


@pytest.mark.parametrize("how,decision,reason,issues", [
    ({}, "clean", "内容正常", {}), ({"title": "短"}, "manual_review", "标题过短，信息不完整", {"title_problems": ["标题过短，信息不完整"]}), ({"title": None}, "manual_review", "标题为空", {"title_problems": ["标题为空"]}),
    ({"body": None}, "manual_review", "正文为空或少于30字", {"completeness_problems": ["正文为空或少于30字"]}), ({"channels": None}, "manual_review", "channels 缺失", {"channel_problems": ["channels 缺失"]}),
    ({"body": BODY + "\x01"}, "manual_review", "正文包含乱码或控制字符", {"dirty_content": ["正文包含乱码或控制字符"]}),
    ({"body": f"<p>{BODY}</p><iframe src=x></iframe>"}, "manual_review", "正文包含未清理的播放器或采集残留", {"dirty_content": ["正文包含未清理的播放器或采集残留"]}),
    ({"body": f'<p onclick="x()">{BODY}</p>'}, "manual_review", "正文包含未清理的可跳转属性", {"dirty_content": ["正文包含未清理的可跳转属性"]}),
    ({"body": f"<script>香港</script><p>{BODY}</p>", "regions": ("香港",)}, "manual_review", "正文包含未清理的播放器或采集残留", {"dirty_content": ["正文包含未清理的播放器或采集残留"]}),
    ({"body": f"<p>扫码关注我们。{BODY}</p>"}, "manual_review", "疑似广告或脏内容：扫码关注", {"dirty_content": ["疑似广告或脏内容：扫码关注"]}),
    ({"body": f"<p>{BODY}香港</p>"}, None, "文章涉及敏感地域信息「香港」，需人工审核", {"regional_sensitive": ["文章涉及敏感地域信息「香港」，需人工审核"]}), ({"body": "好" * 2500 + "香港"}, "clean", "内容正常", {}), ({"title": "香港队的标题"}, None, "文章涉及敏感地域信息「香港」，需人工审核", {"regional_sensitive": ["文章涉及敏感地域信息「香港」，需人工审核"]}),
    ({"answer": {}}, "clean", "内容正常", {}), ({"answer": {"plans": 1}}, "repairable", "因为", {}), ({"answer": {"plans": 1, "title_complete": False}}, "manual_review", "AI 判断标题可能不完整：因为；AI 修复计划与标题完整性结论矛盾，需要人工确认", None),
    ({"answer": {"plans": 2, "body_complete": False}}, "manual_review", "AI 判断正文可能不完整：因为；AI 修复计划与正文完整性结论矛盾，需要人工确认", None), ({"answer": {"plans": 2, "body_complete": False, "keeps_body": True, "has_dirty": True}}, "repairable", "AI 判断可能含广告或脏内容：因为", {"dirty_content": ["AI 判断可能含广告或脏内容：因为"]}),
    ({"answer": {"has_dirty": None, "needs_review": None}}, "manual_review", "AI 质检返回字段格式错误：has_ad_or_dirty,needs_review，需要人工确认", None), ({"answer": {"needs_review": True}}, "manual_review", "因为", {"semantic_problems": ["因为"]}),
    ({"answer": {"plans": 1}, "body": BODY + "扫码关注"}, "repairable", "疑似广告或脏内容：扫码关注", None),
])
def test_quality_records(spark, how, decision, reason, issues):
    got = record(spark, **how)
    assert got[:2] == (decision, reason) and (issues is None or got[2] == issues)


def at(day, hour=11):
    return datetime(2024, 5, day, hour)


def test_next_periods(spark):
    entries = [
        ("sent", 1, 11, "SENT", 1), ("failed", 1, 11, "PENDING", 1), ("failed", 1, 11, "FAILED", 2), ("failed", 2, 11, "SENT", 2), ("mended", 1, 11, "FAILED", 1), ("mended", 1, 11, "SENT", 2), ("late", 8, 11, "SENT", 1), ("other", 1, 3, "FAILED", 1), ("done", 9, 11, "SENT", 1), ("two", 3, 11, "FAILED", 1), ("two", 2, 11, "PENDING", 1),
    ]
    ledger = spark.createDataFrame([(s, at(d, h).replace(day=max(1, d - 1)), at(d, h), state, n) for s, d, h, state, n in entries], "source string, period_start timestamp_ntz, period_end timestamp_ntz, status string, at int")
    sources = spark.createDataFrame([(s,) for s in ("sent", "failed", "mended", "late", "other", "done", "two", "new")], "source string")
    latest = spark.createDataFrame([(at(8), at(9))], "period_start timestamp_ntz, period_end timestamp_ntz")
    got = {r["source"]: (r["period_start"], r["period_end"]) for r in R.next_periods(ledger, sources, latest).collect()}
    assert got == {"sent": (at(1), at(2)), "failed": (at(1), at(1)), "mended": (at(1), at(2)), "late": (at(8), at(9)), "other": (at(8), at(9)), "done": (at(8), at(9)), "two": (at(1), at(2)), "new": (at(8), at(9))}


def test_run_tally(spark):
    rows = spark.createDataFrame([(1, i, "ERROR" if i % 2 else "PUBLISHED") for i in range(20)] + [(2, 1, "PUBLISH_FAILED")], "run_id int, id int, state string")
    got = {r["run_id"]: tuple(r[1:]) for r in K.run_tally(rows, 3).collect()}
    assert got == {1: (20, 10, [1, 3, 5], "ERROR=10,PUBLISHED=10", "PARTIAL"), 2: (1, 0, [], "PUBLISH_FAILED=1", "SUCCESS")}


def test_tab_predicates(spark):
    rows = spark.createDataFrame([(1, "300", 0, "news"), (2, "58", 1, "all"), (3, "0", 1, "x"), (4, "none", 1, "x"), (5, None, None, "x"), (6, "300", 1, "  "), (7, "300", 1, None)], "id int, backend_tab_id string, enabled int, definition string")
    got = {r["id"]: tuple(r[1:]) for r in S.tab_predicates(rows).collect()}
    assert got == {1: (True, False, True), 2: (True, True, False), 3: (False, True, False), 4: (False, True, False), 5: (False, False, False), 6: (True, True, False), 7: (True, True, False)}


def test_orphans(spark):
    now = datetime(2024, 5, 2)
    rows = spark.createDataFrame([(1, "RECEIVED", at(1)), (2, "NEEDS_REVIEW", at(1)), (3, "RECEIVED", now), (4, "RECEIVED", at(1))], "id int, status string, updated_at timestamp_ntz").withColumn("created_at", F.col("updated_at"))
    assert [r["id"] for r in S.orphans(rows, rows.filter("id = 4"), now).collect()] == [1]


def test_transitions(spark):
    kinds = "id int, status string, published_at timestamp_ntz, updated_at timestamp_ntz, error string, tab_names array<string>"
    state = spark.createDataFrame([(1, "READY", None, at(1), "old", []), (2, "READY", at(1), at(1), "old", ["kept"]), (3, "READY", None, at(1), "old", None), (4, "DONE", None, at(1), "old", ["x"]), (5, "READY", None, at(2), "old", []), (6, "READY", None, at(1), "old", [])], kinds)
    asked = [(i, i, ["READY"], at(1), to, at(3), said, ["a", "b"]) for i, to, said in ((1, "PUBLISHED", "no"), (2, "PUBLISHED", "no"), (3, "ERROR", "new"), (4, "PUBLISHED", "no"), (5, "PUBLISHED", "no"), (6, "PUBLISH_FAILED", ""))]
    requests = spark.createDataFrame([*asked, (1, 0, ["READY"], at(1), "ERROR", at(4), "late", [])], "id int, request_id int, allowed_from array<string>, expected timestamp_ntz, to_status string, at timestamp_ntz, message string, tab_names array<string>")
    from presswork.operators import ingest as I

    got = {r["id"]: tuple(r[1:]) for r in I.transitioned(state, requests).collect()}
    assert got == {
        1: ("PUBLISHED", at(3), at(3), None, ["a", "b"]), 2: ("PUBLISHED", at(1), at(3), None, ["kept"]), 3: ("ERROR", None, at(3), "new", None), 4: ("DONE", None, at(1), "old", ["x"]), 5: ("READY", None, at(2), "old", []),
        6: ("PUBLISH_FAILED", None, at(3), "old", []),
    }


@pytest.mark.parametrize("after,confidence,body,want", [("x（摄影：A）", 0.9, "a x b", True), ("x [照片]=A", 0.85, "a x b", True), ("x（摄影：A）", 0.8, "a x b", False), ("x（摄影：A）", 0.9, "x and x", False), ("x by A", 0.9, "a x b", False), ("x（摄影：A）", None, "a x b", False)])
def test_advice(spark, after, confidence, body, want):
    from presswork.functions import edits as E

    rows = spark.createDataFrame([(1, body, "replace_text", "x", after, confidence)], "id int, body_text string, action string, evidence string, after string, confidence double")
    assert E.plan_kinds(rows).first()["advisory"] == want
