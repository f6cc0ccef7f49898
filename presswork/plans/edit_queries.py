"""The cleaning pass, edit shapes, plans and the replay of recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits as E, html as H, text as X
from ..operators import dedup as D
from .registry import query


def pages(v):
    return v.table("pages").select("page_id", F.col("html").alias("body_html"))


@query()
def f22_precleaned_bodies(v):
    return E.precleaned(pages(v)).select("page_id", "rules", F.sha2("clean", 256).alias("clean_sha256"), F.char_length("clean").alias("n_chars"))


@query("SELECT page_id, sha256(replace(html, '<h1>', '<img src=\"a\" alt=\"b\"><h1>')) AS clean_sha256 FROM pages")
def f43_refused_attributes(v):
    put = F.replace("body_html", F.lit("<h1>"), F.lit('<img src="a" data-permalink="p q" data-orig-size=\'1,2\' alt="b" data-large-file=x><h1>'))
    return pages(v).select("page_id", F.sha2(E.without_attributes(put), 256).alias("clean_sha256"))


@query("SELECT doc_id, ['edge', 'edge', 'sentences', 'infix', 'none', 'none'][doc_id % 6 + 1] AS shape FROM documents")
def f36_edit_shapes(v):
    """How edits of a text come from it by deletion alone, or don't."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    first, second, third = F.concat(F.lit("第"), n, F.lit("篇的第一句话说得很完整。")), F.lit("中间这句是推广内容！"), F.concat(F.lit("最后一句也属于第"), n, F.lit("篇。"))
    before = F.concat(first, second, third)
    after = (
        F.when(k == 0, F.concat(first, second)).when(k == 1, F.concat(second, third)).when(k == 2, F.concat(first, third)).when(k == 3, F.replace(before, F.lit("是推广内容"), F.lit("")))
        .when(k == 4, F.concat(first, F.lit("改写了的一句话。"))).otherwise("短")
    )
    return E.edit_audit(v.table("documents").select("doc_id", before.alias("before"), after.alias("after"))).select("doc_id", "shape")


@query("SELECT doc_id, '<p>about ' || doc_id || ' </p><p>text。</p><p>正文' || doc_id || '。</p><p>shown ' || doc_id || ' </p>' AS clean, ['links', 'ad_sections', 'marker_blocks', 'recommended', 'lines', 'captions', 'residue', 'containers', 'handlers', 'markdown'] AS rules FROM documents")
def f22_cleaned_feeds(v):
    """Bodies with something for each of ten steps, and the steps that found it."""
    n = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit("<p>about "), n, F.lit(' <a href="/q">link</a></p><!-- google_ad_section_start -->advert<!-- google_ad_section_end --><p>前文链接</p><h2>更多新闻</h2><h3>a</h3><p>text。<br>摄影：'), n,
        F.lit("</p><p>【视频】进球集锦！ 正文"), n, F.lit('。</p><script>s()</script><p data-url="u">{{c|shown '), n, F.lit("}} [l](https://x.y/z)</p>"),
    )
    return E.precleaned(v.table("documents").select("doc_id", body.alias("body_html"))).select("doc_id", "clean", "rules")


@query()
def f36_edit_audit(v):
    blocks = H.block_table(pages(v), "page_id")
    pairs = blocks.select("page_id", "pos", F.col("text").alias("before"), F.when(F.col("pos") % 2 == 0, F.regexp_replace("text", r"[^.]*\.$", "")).otherwise(F.upper("text")).alias("after"))
    return E.edit_audit(pairs).select("page_id", "pos", "shape")


_LABEL = "(?i)供图|供图片|摄影|撮影|拍摄|图源|图片来源|视频来源|来源|版权|署名|photo|credit|courtesy"
_VERB = "点击|关注|订阅|下载|扫码|扫描|转播|独播|播出|直播|收看|观看|跟踪|介绍|进入|前往|watch|follow|subscribe|download|click"


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(list_last(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS x FROM documents), m AS (SELECT *, regexp_matches(x, '^[（(\\[【][^）)\\]】]*[）)\\]】][。．.]?$') AS b, regexp_matches(x, '[A-Za-z]{2,}') AS l FROM f) "
       "SELECT doc_id, length(x) BETWEEN 1 AND 60 AND NOT regexp_matches(x, '[“”\"「」『』]') AND NOT regexp_matches(x, '(^|[^A-Za-z0-9])[0-9]([^A-Za-z]|$)') "
       f"AND ((b AND regexp_matches(x, '{_LABEL}')) OR (l AND (b OR regexp_matches(x, '^[A-Za-z]|[A-Za-z][。．.]?$') OR regexp_matches(x, '{_VERB}')))) AS removable FROM m")
def f37_removable_fragments(v):
    rows = v.table("documents").select("doc_id", F.element_at(F.split("text", "\n"), -1).alias("fragment"))
    return rows.select("doc_id", E.removable(F.col("fragment")).alias("removable"))


@query("p AS (SELECT *, id % 3 = 0 OR (id % 3 = 2 AND trim(title_final) <> '') AS d FROM articles) SELECT id, d AS delete_only, d AND length(trim(regexp_replace(body_html, '\\s+', ' ', 'g'))) - length(trim(regexp_replace(title_final, '\\s+', ' ', 'g'))) >= 30 AS keeps_body FROM p", "articles")
def f44_plan_kinds(v):
    k = F.col("id") % 3
    plans = v.articles.select("id", F.col("body_html").alias("body_text"), F.when(k == 0, "remove_block").otherwise("replace_text").alias("action"), F.col("title_final").alias("evidence"), F.when(k == 1, F.concat("title_final", F.lit("!"))).otherwise("").alias("after"))
    return E.plan_kinds(plans).select("id", "delete_only", "keeps_body")


_ADVISED = "regexp_replace(title_final, '[^a-z]+', ' ', 'g')"


@query(f"p AS (SELECT id, 'a ' || {_ADVISED} || ' b' AS t FROM articles) SELECT id, id % 4 <> 3 AND id % 3 <> 1 AND id % 5 <> 0 AS advisory FROM p", "articles")
def f44_advisory_credits(v):
    """Plans that suggest a photo's credit: sure enough, and of a text that the body has once."""
    i, t = F.col("id"), F.concat(F.lit("a "), F.expr(_ADVISED.replace(", 'g')", ")")), F.lit(" b"))
    rows = v.articles.select("id", F.when(i % 4 == 3, F.concat(t, F.lit(" | "), t)).otherwise(t).alias("body_text"), F.lit("replace_text").alias("action"), t.alias("evidence"), F.when(i % 3 == 1, F.lit("no such thing")).otherwise(F.concat(t, F.lit("（图片来源：X）"))).alias("after"), F.when(i % 5 == 0, 0.8).otherwise(0.9).alias("confidence"))
    return E.plan_kinds(rows).select("id", "advisory")


@query("SELECT doc_id, doc_id % 6 <> 5 AS residue FROM documents")
def f37_known_residues(v):
    """Residues of feeds at the edges of texts, by their form."""
    k, name = F.col("doc_id") % 6, F.regexp_replace(F.substring("source", 1, 10), "[^a-z]", "")
    text = F.when(k == 0, F.concat(F.lit("（见下方视频）"), name)).when(k == 1, F.concat(name, F.lit("编辑部"))).when(k == 2, F.concat(F.lit("(C)"), name, F.lit(" Images"))).when(k == 3, F.concat(F.lit("图片："), name, F.lit(" x")))
    return v.table("documents").select("doc_id", E.known_residue(text.when(k == 4, F.concat(F.lit("/"), F.lit("x"), name, F.lit("@mail.org"))).otherwise(F.concat(F.lit("他在下半场再进两球"), name))).alias("residue"))


_LINES = "WITH b AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents)"


@query(f"{_LINES}, t AS (SELECT doc_id, CASE WHEN pos % 2 = 0 THEN text ELSE split_part(text, ' ', 1) END AS evidence FROM b WHERE pos % 3 = 1), "
       "f AS (SELECT b.doc_id, b.pos, b.text, arg_max(evidence, (length(evidence), evidence)) AS evidence FROM b JOIN t ON t.doc_id = b.doc_id AND evidence <> '' AND contains(b.text, evidence) GROUP BY ALL) "
       "SELECT doc_id, pos::INTEGER AS seq, CASE WHEN text = evidence THEN 'remove_block' ELSE 'replace_text' END AS action, 'b' || pos AS block_id, evidence, CASE WHEN text = evidence THEN NULL ELSE '' END AS after FROM f")
def f39_planned_removals(v):
    """Plans for the lines of documents that hold what was found to be dirt."""
    blocks = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("block_id", F.concat(F.lit("b"), F.col("pos").cast("string")))
    targets = blocks.filter("pos % 3 = 1").select("doc_id", F.when(F.col("pos") % 2 == 0, F.col("text")).otherwise(F.split_part("text", F.lit(" "), F.lit(1))).alias("evidence"))
    return E.planned_removals(blocks, targets, "doc_id")


@query()
def a17_recall_replay(v):
    """Recalled pairs of the history, and how many a filter on conflicting numbers would drop, by what matched."""
    titles = v.articles.select("id", X.numbers(F.col("title_final")).alias("n"))
    found = D.candidates(v.articles).join(titles, "id").join(titles.select(F.col("id").alias("older"), F.col("n").alias("m")), "older")
    conflict = (F.size("n") > 0) & (F.size("m") > 0) & (F.array_sort("n") != F.array_sort("m"))
    return found.groupBy("matched_by").agg(F.count("*").alias("recalled"), F.count_if(conflict).alias("dropped"))
