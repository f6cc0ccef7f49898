"""The index of parts, edits at the places that plans name, lines and sentences, and what plans say about themselves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from presswork.functions import evidence as E, index as I, lines as L, repairs as R

LONG = "A long enough first paragraph. " * 3
BODY = f'<p>{LONG}</p><p><img src="/a.png">Caption</p><p>Read more here</p><p>Score was 3-1 today.</p>'
WHY = {"issue_type": "promotion", "reason": "独立的推广"}


def plan(**how):
    return {"action": "remove_block", "block_id": "b3", "evidence": "Read more here", "after": None, "confidence": 0.99, "keep_block_id": None} | how


# the block with an image is counted, not listed: text blocks are b1, b2 and b3
@pytest.mark.parametrize("plans,error", [
    ([plan(block_id="b2")], None), ([plan(block_id="b2", evidence="other")], "evidence differs"), ([plan(block_id="b9")], "unknown block"), ([plan(block_id="b2", confidence=0.9)], "not sure enough"),
    ([plan(block_id="b2", confidence=1.5)], "not sure enough"), ([plan(block_id="b2", confidence=None)], "not sure enough"), ([plan(block_id="b2")] * 2, "edits overlap"), ([plan(block_id="b2")] * 6, "too many edits"),
    ([plan(block_id="b2", keep_block_id="b2")], "what is to be kept is missing"), ([plan(action="replace_text", evidence="3-1", after="3-2")], "replacement changes facts or markup"),
    ([plan(action="replace_text", evidence="was 3-1", after="stood at 3-1", issue_type="minor_text_defect", reason="reads better")], "replacement changes facts or markup"),
    ([plan(action="replace_text", evidence="today", after="<b>")], "replacement changes facts or markup"), ([plan(action="explode", block_id="b2")], "unknown action"), ([plan(action="remove_text_line", block_id="b2.s1")], "the block has no other line"),
    ([plan(action="replace_text", evidence="Score was 3-1 today.", after="Score was 3-1, today.", issue_type="minor_text_defect", reason="a comma")], None),
])
def test_edit_plans(plans, error):
    after, applied, got = R.edited(BODY, plans)
    assert got == error and (after == BODY) == (error is not None) and applied == (0 if error else len(plans))


@pytest.mark.parametrize("body,plans,after", [
    # of equal blocks, the named one
    (f"<p>{LONG}</p><p>same</p><p>same</p>", [plan(block_id="b3", evidence="same", keep_block_id="b2")], f"<p>{LONG}</p><p>same</p>"),
    (f"<p>{LONG}</p><p>same</p><p class='x'>same</p>", [plan(block_id="b2", evidence="same")], f"<p>{LONG}</p><p class='x'>same</p>"),
    # a quote that another block has too
    (f"<p>{LONG} a, b</p><p>a, b</p>", [plan(action="replace_text", block_id="b2", evidence="a, b", after="a b", issue_type="minor_text_defect", reason="a comma")], f"<p>{LONG} a, b</p><p>a b</p>"),
    # references in the source
    (f"<p>{LONG}</p><p>Tom &amp; Jerry &#169;</p>", [plan(block_id="b2", evidence="Tom & Jerry ©")], f"<p>{LONG}</p>"),
    (f"<p>{LONG}</p><p>A &amp; B&nbsp;&nbsp;c, d</p>", [plan(action="replace_text", block_id="b2", evidence="& B c,", after="& B c", issue_type="minor_text_defect", reason="a comma")], f"<p>{LONG}</p><p>A &amp; B c d</p>"),
    # lines with their breaks, the last with the one before it, several at once
    (f"<p>{LONG}<br>ad one<br/>news\nad two</p>", [plan(action="remove_text_line", block_id="b1.s2", evidence="ad one"), plan(action="delete_segment", block_id="b1.s4", evidence="ad two")], f"<p>{LONG}<br>news</p>"),
    (f"<p>{LONG}<br>ad one<br>ad two</p>", [plan(action="remove_text_line", block_id="b1.s2", evidence="ad one"), plan(action="remove_text_line", block_id="b1.s3", evidence="ad two")], f"<p>{LONG}<br></p>"),
    # links keep their images; what becomes empty goes
    (f'<p>{LONG}</p><p><a href="/q">all news</a></p>', [plan(action="remove_link", block_id="l1", evidence="all news")], f"<p>{LONG}</p>"),
    (f'<p>{LONG}</p><a href="/q">all <img src="i"></a>', [plan(action="delete_link", block_id="l1", evidence="all")], f'<p>{LONG}</p><img src="i">'),
    (f"<p>{LONG}</p><div> <b></b></div>", [plan(action="remove_empty_block", block_id="e1", evidence="")], f"<p>{LONG}</p>"),
    # null as a replacement removes; a bad plan is left out; ids that have moved are found by their evidence
    (f"<p>{LONG}</p><p>gone</p>", [plan(action="replace_text", block_id="b2", evidence="gone", after=None)], f"<p>{LONG}</p>"),
    (f"<p>{LONG}</p><p>gone</p><p>stays</p>", [plan(block_id="b2", evidence="gone"), plan(block_id="b3", evidence="other")], f"<p>{LONG}</p><p>stays</p>"),
    (f"<p>{LONG}</p><p>gone</p><p>too</p>", [plan(block_id="b7", evidence="gone"), plan(block_id="b3", evidence="too")], f"<p>{LONG}</p>"),
    # a residue may be cut off a text, anything else with a verdict
    (f"<p>{LONG}（见下方视频）</p>", [plan(action="replace_text", block_id="b1", evidence=f"{LONG}（见下方视频）", after=LONG.strip(), **WHY)], f"<p>{LONG.strip()}</p>"),
    (f"<p>{LONG}他进球了</p>", [plan(action="replace_text", block_id="b1", evidence=f"{LONG}他进球了", after=LONG.strip(), verified=True, **WHY)], f"<p>{LONG.strip()}</p>"),
    # repeated content: the kept one must say as much
    (f"<p>{LONG}</p><p>Opening words</p><p>Opening words, and more</p>", [plan(action="delete_duplicate", block_id="b2", evidence="Opening words", issue_type="重复内容", keep_block_id="b3")], f"<p>{LONG}</p><p>Opening words, and more</p>"),
    (f"<p>{LONG}</p><p>Opening words</p><p>Opening words, and more</p>", [plan(action="delete_duplicate", block_id="b2", evidence="Opening words", issue_type="duplicate_content")], f"<p>{LONG}</p><p>Opening words, and more</p>"),
])
def test_edits_at_their_places(body, plans, after):
    assert R.edited(body, plans)[0] == after


@pytest.mark.parametrize("body,plans,error", [
    (f"<p>{LONG}</p><p>Opening words</p><p>Opening words, and more</p>", [plan(action="delete_duplicate", block_id="b3", evidence="Opening words, and more", issue_type="duplicate_content")], "what is to be kept is missing"),
    (f"<p>{LONG}</p><p>same</p><p>same</p>", [plan(action="delete_duplicate", block_id=b, evidence="same", issue_type="duplicate_content", keep_block_id=k) for b, k in (("b2", "b3"), ("b3", "b2"))], "what is to be kept is missing"),
    (f"<p>{LONG}他进球了</p>", [plan(action="replace_text", block_id="b1", evidence=f"{LONG}他进球了", after=LONG.strip(), **WHY)], "replacement changes facts or markup"),
    ("<p>short</p><p>gone now</p>", [plan(block_id="b2", evidence="gone now")], "too little is left"), (f"<p>{'x' * 601}</p><p>{LONG}</p>", [plan(block_id="b1", evidence="x" * 601)], "too much is removed"),
    (f"<p>{LONG}<b>bo, ld</b></p>", [plan(action="replace_text", block_id="b1", evidence=f"{LONG}bo, ld", after=f"{LONG}bo ld", issue_type="minor_text_defect", reason="a comma")], None),
    (f"<p>{LONG}<b>bo, ld</b></p>", [plan(action="replace_text", block_id="b1", evidence="paragraph. bo,", after="paragraph bo,", issue_type="minor_text_defect", reason="a comma")], "replacement changes facts or markup"),
])
def test_refused_edits(body, plans, error):
    assert R.edited(body, plans)[2] == error


def test_random_removals_against_plain_blocks():
    """Removing blocks by any plan leaves exactly the other blocks, however often their texts repeat."""
    draw = random.Random(7)
    for _ in range(300):
        texts = [LONG.strip(), *(draw.choice(["a", "b &amp; c", "a", "d<br>e", "<b>a</b>"]) for _ in range(draw.randrange(1, 7)))]
        gone = sorted(draw.sample(range(1, len(texts)), draw.randrange(1, min(5, len(texts)))))
        blocks = [f"<p>{t}</p>" for t in texts]
        plain = [t.replace("&amp;", "&").replace("<br>", " ").replace("<b>", "").replace("</b>", "") for t in texts]
        plans = [plan(block_id=f"b{i + 1}", evidence=plain[i]) for i in draw.sample(gone, len(gone))]
        assert R.edited("-".join(blocks), plans)[:2] == ("-".join("" if i in gone else b for i, b in enumerate(blocks)), len(gone))


def test_plans_beside_bodies(spark):
    bodies = spark.createDataFrame([(1, BODY), (2, BODY), (3, None), (4, BODY)], "id bigint, body_html string")
    good = plan(block_id="b2")
    rows = [(1, 1, *good.values()), (2, 1, *good.values()), (2, 2, *plan(evidence="x").values()), (3, 1, *good.values()), *[(4, i, *good.values()) for i in range(40)]]
    plans = spark.createDataFrame(rows, f"id bigint, seq int, {R.PLAN}")
    got = {r["id"]: (r["applied"], r["error"], [o["reason"] for o in r["outcomes"]]) for r in R.applied_plans(bodies, plans, "id").collect()}
    assert got == {1: (1, None, [None]), 2: (1, None, [None, "evidence differs"]), 3: (0, "unknown block", ["unknown block"]), 4: (0, "too many edits", ["too many edits"] * 6)}


PIECES = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "text", " ", "&amp;", "<a href='x'>", "</a>", "<img src=i>", "<!-- c -->", "<script>", "</script>", "<", ">", "\n", "<li>", "</li>"]


def test_every_interval_decodes_to_its_text():
    draw = random.Random(11)
    for _ in range(2000):
        body = "".join(draw.choice(PIECES) for _ in range(draw.randrange(25)))
        for p in I.parts(body):
            assert p.kind == "excluded" or I.plain(body[p.inner_start : p.inner_stop]) == p.text
            assert 0 <= p.cut_start <= p.start <= p.inner_start <= p.inner_stop <= p.stop <= p.cut_stop <= len(body)
            if p.kind in ("block", "empty"):
                assert body[p.start : p.inner_start].startswith(f"<{p.tag}") and body[p.inner_stop : p.stop] == f"</{p.tag}>"


def test_ids_count_what_is_not_listed():
    body = "<p>a</p><!-- <p>b</p> --><p>un<b>closed</p><p>c<br><br>d</p><p></p>"
    got = [(p.part_id, p.text) for p in I.parts(body) if p.kind != "excluded"]
    assert got == [("b1", "a"), ("b1.s1", "a"), ("b4", "c d"), ("b4.s1", "c"), ("b4.s2", ""), ("b4.s3", "d"), ("b5", ""), ("b5.s1", ""), ("e1", "")]
    assert I.parts(None) == [] and I.parts("no markup") == [] and len(I.parts("<p>" * 20000)) == 0


def test_parts_in_sql(spark):
    I.register(spark)
    spark.createDataFrame([(1, "<p>a</p><p>b</p>"), (2, None), (3, "")], "id bigint, body string").createOrReplaceTempView("bodies")
    got = spark.sql("SELECT id, part_id FROM bodies, LATERAL body_parts(body) WHERE kind = 'block' ORDER BY ALL").collect()
    assert [tuple(r) for r in got] == [(1, "b1"), (1, "b2")]


LINED = [
    "<p>正文第一句。<br>摄影：柳濑<br>图片=Getty</p><p>【视频】集锦看这里</p><p>结束了。 编排●Web编辑部</p>", "<p>摄影：a<br>正文<br>照片：b<br>正文</p>", "<p><b>摄影：a</b></p>", "<p>没有标记</p>", None, "",
    "<li>x！/摄影：中地</li><p>y\n\n图片：z</p>", "<p>图片：a<br><br>图片：b</p>", "<h2>摄影：a</h2>", "<p>" + "长" * 300 + "摄影：a</p>", "<p>合作咨询 ad@sport.co.kr</p>", "<p>好。 /rec@osen.co.kr</p>", "<p>[图片]=Getty</p>", "<p>解雇主帅[图片]=Getty Images</p>",
]


def test_lines_as_rows_and_in_one_body(spark):
    rows = spark.createDataFrame(list(enumerate(LINED)), "id int, body_html string")
    table = {r["id"]: r["clean"] for r in L.without_artifact_lines(rows, "id").collect()}
    assert table == {i: L.lines_taken_out(b) for i, b in enumerate(LINED)}
    assert [table[i] for i in (0, 1, 2, 3, 8, 10, 13)] == ["<p>正文第一句。</p><p>结束了。</p>", "<p>正文<br>正文</p>", LINED[2], LINED[3], LINED[8], "", "<p>解雇主帅</p>"]
    found = {(r["id"], r["rule"]) for r in L.artifact_lines(rows, "id").collect()}
    assert {(0, "photo_credit_line"), (0, "media_caption_line"), (0, "editorial_byline_tail"), (11, "editorial_byline_tail"), (13, "photo_credit_tail")} <= found


@pytest.mark.parametrize("text,want", [
    ("【视频】谷口彰悟制胜球！正文继续。", "正文继续。"), ("又有新援离队。 【视频】横滨FM处子球！ 这名右后卫来了。", "又有新援离队。这名右后卫来了。"), ("【视频】比赛中，第43分钟进球。", None), ("官方发布了【图片】的照片。", None), ("【进球者】10分 某某", None), ("", None),
])
def test_caption_sentences(text, want):
    assert L.without_caption_sentences(text) == (text if want is None else want)


@pytest.mark.parametrize("evidence,want", [
    ("请点击链接获取更多", True), ("请点击这里", False), ("他在官网观看比赛", False), ("更多意甲新闻", True), ("请在 ge 观看全部比赛", True), ("请在ge观看全部比赛", False), ("在Kayo上观看每一场，无广告", True), ("Kayo转播了比赛", False), ("【视频】进球集锦在此", True), ("【积分榜】意甲积分榜", True), ("● 节目明天开播", True), ("x" * 300, False), ("", False),
])
def test_promotional_evidence(spark, evidence, want):
    assert E.is_promotional(evidence) == want == spark.createDataFrame([(evidence,)], "e string").select(E.promotional_evidence(F.col("e")).alias("w")).first()["w"]


def test_plan_families(spark):
    unrelated = "该段是独立的推广，与正文无关"
    rows = [
        (1, "请点击链接获取更多", "Call to-Action", unrelated), (2, "请点击链接获取更多", "promotion", "too"), (3, "请点击链接获取更多", "promotion", "<b>推广</b> 独立无关"), (4, "普通一句话", "promotion", unrelated), (5, "【视频】两球集锦", None, None), (6, "普通", None, None),
        (7, "【图片】新球衣", "模板残留", "采集时的残留"), (8, "【图片】新球衣", "模板残留", "not said"), (9, "anything", "duplicate_content", "twice in it"), (10, "https://x.y/z", "format_noise", "外链，占位的残留"), (11, "请点击链接获取更多", "promotion", "x" * 501),
    ]
    got = {r["id"]: (r["promotional"], r["removable_issue"]) for r in E.judged_plans(spark.createDataFrame(rows, "id int, evidence string, issue_type string, reason string")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, False), 7: (False, True), 8: (False, False), 9: (False, True), 10: (False, True), 11: (False, False)}


def test_repeated_parts_against_pairs(spark):
    draw = random.Random(5)
    words = ["Ab", "ab!", "abcd", "ABCD e", "abcdef", "x", "", "ｘ", "abcd"]
    rows = [(d, f"b{i}", draw.choice(words), i) for d in range(60) for i in range(draw.randrange(8))]
    got = {(r["id"], r["part_id"]): r["keep_id"] for r in I.repeated_parts(spark.createDataFrame(rows, "id int, part_id string, text string, start int"), "id").collect()}
    want = {}
    for d, p, text, i in rows:
        others = [r for r in rows if r[0] == d and r[3] != i and R.says_again(text, r[2]) and (not R.says_again(r[2], text) or r[3] < i)]
        if others:
            want[d, p] = {r[1] for r in others}
    assert got.keys() == want.keys() and all(got[k] in want[k] and (k[0], got[k]) not in got for k in got)
