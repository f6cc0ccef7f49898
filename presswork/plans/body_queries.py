"""Bodies: residues, covers, safety of edits, the index of parts, lines and sentences that go, and edit plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bodies as B, evidence as E, html as H, index as I, lines as L, repairs as R
from .registry import query


def pages(v):
    return v.table("pages").select("page_id", F.col("html").alias("body_html"))


_SWEPT = "regexp_replace(regexp_replace(p, '\\{{1,2}[^{}|\\r\\n]*\\|([^{}\\r\\n]*?)\\}?', '\\1', 'g'), '\\{{1,2}|\\}{1,2}', '', 'g')"


@query("WITH t AS (SELECT doc_id, text || ' {{tag|shown}} and {left} <b class=\"{kept}\">' AS x FROM documents) SELECT doc_id, array_to_string(list_transform(regexp_extract_all(x, '<[^>]*>|[^<]+|<'), "
       f"lambda p: CASE WHEN regexp_full_match(p, '<[^>]*>') THEN p ELSE {_SWEPT} END), '') AS clean FROM t")
def f25_template_residue(v):
    return v.table("documents").select("doc_id", B.without_template_residue(F.concat("text", F.lit(' {{tag|shown}} and {left} <b class="{kept}">'))).alias("clean"))


_GOES = "(?:https?://|//|/|#|\\.\\.?/|mailto:|tel:|javascript:|data:)[^)\\s>]+"


@query(f"""WITH t AS (SELECT doc_id, text || ' [a link](https://x.org/a "t") ![kept](/i.png) [b][One] [none][two]' || chr(10) || '[one]: https://x.org/b' AS x FROM documents),
u AS (SELECT doc_id, regexp_replace(x, '(?i)(^|[^!])\\[[^\\]\\r\\n]+\\]\\(\\s*(?:<{_GOES}>|{_GOES})(?:\\s+(?:"[^"\\r\\n]*"|''[^''\\r\\n]*''|\\([^)\\r\\n]*\\)))?\\s*\\)', '\\1', 'g') AS y FROM t)
SELECT doc_id, replace(replace(y, '[b][One]', ''), '[one]: https://x.org/b', '') AS clean FROM u""")
def f26_markdown_links(v):
    more = ' [a link](https://x.org/a "t") ![kept](/i.png) [b][One] [none][two]\n[one]: https://x.org/b'
    return v.table("documents").select("doc_id", B.without_markdown_links(F.concat("text", F.lit(more))).alias("clean"))


#: A text of letters alone, never empty, so that markup can be put around it.
_X = "'about ' || coalesce(doc_id, 0) || regexp_replace(substr(coalesce(text, ''), 1, 60), '[^a-zA-Z]+', ' ', 'g') || ' end'"


def worded(v):
    x = F.concat(F.lit("about "), F.coalesce("doc_id", F.lit(0)).cast("string"), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "[^a-zA-Z]+", " "), F.lit(" end"))
    return v.table("documents").select("doc_id", x.alias("x"))


_HAS_IMAGE = "CASE doc_id % 5 WHEN 0 THEN '<p>' || x || '</p><p>more</p>' WHEN 1 THEN x WHEN 2 THEN '<p>' || x || '</p ><img src=\"/own.png\">' WHEN 3 THEN '<IMG src=\"javascript:x\"><img alt=\"\" src=\"https://x.org/' || doc_id || '.png\">' ELSE '<div>' || x || '</div><P>a</P>' END"


def illustrated(v):
    own = F.when(F.col("doc_id") % 3 == 0, F.lit("/default.png")).when(F.col("doc_id") % 3 == 1, F.lit(" ")).otherwise(F.lit("/own-cover.png"))
    fallback = F.when(F.col("doc_id") % 2 == 0, F.lit("/tab.png"))
    return worded(v).withColumns({"body_html": F.expr(_HAS_IMAGE.replace('\\"', '"')), "own": own, "fallback": fallback})


@query(f"""WITH t AS (SELECT doc_id, {_X} AS x FROM documents), b AS (SELECT doc_id, x, {_HAS_IMAGE} AS body FROM t)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<p>' || x || '</p><p><img src="/c.png"></p><p>more</p>' WHEN 1 THEN '<p><img src="/c.png"></p>' || x WHEN 4 THEN '<div>' || x || '</div><P>a</P><p><img src="/c.png"></p>' ELSE body END AS put FROM b""")
def f40_inserted_images(v):
    """An image goes behind the first paragraph, or before a body without one; a body with an image stays as it is."""
    return illustrated(v).select("doc_id", B.with_image(F.col("body_html"), F.lit("/c.png")).alias("put"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN '/own.png' WHEN doc_id % 5 = 3 THEN 'https://x.org/' || doc_id || '.png' WHEN doc_id % 3 = 2 THEN '/own-cover.png' WHEN doc_id % 2 = 0 THEN '/tab.png' ELSE '/default.png' END AS cover FROM documents")
def f40_covers(v):
    """The first usable image of the body, else the material's own, else the tab's, else the default."""
    return illustrated(v).select("doc_id", B.cover("body_html", "own", F.col("fallback"), "/default.png").alias("cover"))


@query(f"WITH t AS (SELECT doc_id, {_X} AS x FROM documents) SELECT doc_id, '<p>' || x || ' </p><img src=\"i\"><p>' || x || '</p>' AS unlinked, '<p>' || x || ' <a href=\"/q\">' || x || '</a></p><a href=\"/z\">more <img src=\"i\"></a><p>' || x || '</p>' AS compacted FROM t")
def f21_links_and_empty_blocks(v):
    """Links go with their text and leave images; blocks without content go until none is left."""
    linked = F.concat(F.lit("<p>"), "x", F.lit(' <a href="/q">'), "x", F.lit('</a></p><a href="/z">more <img src="i"></a><p>'), "x", F.lit("</p>"))
    empty = F.concat(linked, F.lit("<div><p> </p><p>&nbsp;<br/></p></div><li></li>"))
    return worded(v).select("doc_id", H.unlinked(linked).alias("unlinked"), H.compacted(empty).alias("compacted"))


@query(f"WITH t AS (SELECT doc_id, {_X} AS x FROM documents) SELECT doc_id, '<p>' || x || '（图片来源：' || doc_id || ' Agency）</p><p>摄影：' || x || '。</p>' AS clean FROM t")
def f32_normalized_credits(v):
    """A credit at the end of a block has one form; a sentence that begins like one stays."""
    body = F.concat(F.lit("<p>"), "x", F.lit(" 摄影： "), F.col("doc_id").cast("string"), F.lit("  Agency </p><p>摄影："), "x", F.lit("。</p>"))
    return worded(v).select("doc_id", B.credited_of(body).alias("clean"))


@query(f"""WITH t AS (SELECT doc_id, {_X} AS x FROM documents), b AS (SELECT *, '<p>' || x || '</p><img src="/a/' || doc_id || '.png">' AS body, trim(regexp_replace(x, ' +', ' ', 'g')) AS shown FROM t)
SELECT doc_id, sha256(body) AS sha256, length(body) AS body_length, length(shown) AS visible_length, ['/a/' || doc_id || '.png'] AS images FROM b""")
def f33_illustrated_bodies(v):
    body = F.concat(F.lit("<p>"), "x", F.lit('</p><img src="/a/'), "doc_id", F.lit('.png">'))
    return B.safety(worded(v).select("doc_id", body.alias("body")), "body").drop("body")


@query(f"""WITH t AS (SELECT doc_id, {_X} AS x FROM documents) SELECT doc_id, trim(regexp_replace(x, ' +', ' ', 'g')) || ' & more text end' AS shown FROM t""")
def f8_visible_text(v):
    """Text without scripts, comments and markup, references decoded, white space as one space."""
    body = F.concat(F.lit("<p>"), "x", F.lit(" &amp;</p><script>no()</script><!-- no --><div>more\n\n<b>text</b></div> end"))
    return worded(v).select("doc_id", H.plain_text(body).alias("shown"))


@query()
def f33_body_safety(v):
    return B.safety(pages(v), "body_html").select("page_id", "sha256", "body_length", "visible_length", F.size("images").alias("n_images"))


@query(f"WITH t AS (SELECT doc_id, {_X} AS x FROM documents) SELECT doc_id, doc_id % 4 = 0 AND length(trim(regexp_replace(x, ' +', ' ', 'g'))) >= 30 AS safe FROM t")
def f34_judged_edits(v):
    """Of four edits one is safe: another leaves the body as it is, one takes its image, one leaves too little."""
    rows, k = worded(v), F.col("doc_id") % 4
    before = F.concat(F.lit("<p>"), "x", F.lit('</p><img src="/a.png"><p>gone</p>'))
    after = F.when(k == 0, F.concat(F.lit("<p>"), "x", F.lit('</p><img src="/a.png">'))).when(k == 1, before).when(k == 2, F.concat(F.lit("<p>"), "x", F.lit("</p>"))).otherwise(F.lit('<p>short</p><img src="/a.png">'))
    return B.safe_edits(rows.select("doc_id", before.alias("body_html")), rows.select("doc_id", after.alias("body_html")), "doc_id")


@query()
def f34_safe_edits(v):
    return B.safe_edits(pages(v), H.cleaned(pages(v)).select("page_id", F.col("clean").alias("body_html")), "page_id")


@query()
def f38_applied_plans(v):
    """Every page's last block is to go; one in seven plans quotes it wrongly."""
    blocks = I.part_table(pages(v), "page_id", "body_html", "block").filter("text <> ''")
    last = blocks.groupBy("page_id").agg(F.max_by(F.struct("part_id", "text"), "start").alias("b"))
    evidence = F.when(F.col("page_id") % 7 == 0, "something else").otherwise(F.col("b.text"))
    plans = last.select(
        "page_id", F.lit(1).alias("seq"), F.lit("remove_block").alias("action"), F.col("b.part_id").alias("block_id"), evidence.alias("evidence"),
        F.lit(None).cast("string").alias("after"), F.lit(0.99).alias("confidence"), F.lit(None).cast("string").alias("keep_block_id"),
    )
    return R.applied_plans(pages(v), plans, "page_id").select("page_id", "applied", "error", F.sha2("body_after", 256).alias("after_sha256"))


@query(f"WITH t AS (SELECT doc_id, {_X} AS x FROM documents) SELECT doc_id, '<p>' || x || ' and what is left of it all</p><p>' || x || '</p><p>more &amp; ' || x || '.</p>' AS body_after, 2 AS applied, NULL::VARCHAR AS error, 'evidence differs' AS left_out FROM t")
def f38_named_blocks(v):
    """Of two equal blocks the named one goes, a comma is mended where it is quoted, and a plan with other evidence is left out."""
    rows = worded(v).select("doc_id", "x", F.concat(F.lit("<p>"), "x", F.lit(" and what is left of it all</p><p>"), "x", F.lit("</p><p>"), "x", F.lit("</p><p>more &amp; "), "x", F.lit(",</p>")).alias("body_html"))
    fields = lambda seq, action, block, evidence, after, issue, keep: F.struct(
        F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(block).alias("block_id"), evidence.alias("evidence"), after.alias("after"), F.lit(0.97).alias("confidence"),
        F.lit(keep).cast("string").alias("keep_block_id"), F.lit(issue).alias("issue_type"), F.lit("the same is said twice").alias("reason"),
    )
    none, x = F.lit(None).cast("string"), F.col("x")
    plans = F.array(
        fields(1, "delete_duplicate", "b3", x, none, "duplicate_content", "b2"), fields(2, "remove_block", "b2", F.concat(x, F.lit("?")), none, "promotion", None),
        fields(3, "replace_text", "b4", F.concat(F.lit("more & "), x, F.lit(",")), F.concat(F.lit("more & "), x, F.lit(".")), "minor_text_defect", None),
    )
    done = R.applied_plans(rows, rows.select("doc_id", F.explode(plans).alias("p")).select("doc_id", "p.*"), "doc_id")
    return done.select("doc_id", "body_after", "applied", "error", F.element_at("outcomes", 2)["reason"].alias("left_out"))


@query(f"""WITH t AS (SELECT doc_id, {_X} AS x, length({_X}) AS n FROM documents)
SELECT doc_id, 'block' AS kind, 'b1' AS part_id, trim(regexp_replace(x, ' +', ' ', 'g')) || ' two bold' AS text, 0 AS start, n + 26 AS stop FROM t
UNION ALL SELECT doc_id, 'line', 'b1.s1', trim(regexp_replace(x, ' +', ' ', 'g')), 3, n + 3 FROM t
UNION ALL SELECT doc_id, 'line', 'b1.s2', 'two bold', n + 7, n + 22 FROM t
UNION ALL SELECT doc_id, 'block', 'b2', '', n + 26, n + 38 FROM t
UNION ALL SELECT doc_id, 'blank', 'b2.s1', '', n + 31, n + 32 FROM t
UNION ALL SELECT doc_id, 'block', 'b4', 'li', n + 55, n + 67 FROM t
UNION ALL SELECT doc_id, 'line', 'b4.s1', 'li', n + 59, n + 61 FROM t
UNION ALL SELECT doc_id, 'link', 'l1', trim(regexp_replace(x, ' +', ' ', 'g')), n + 67, 2 * n + 84 FROM t
UNION ALL SELECT doc_id, 'empty', 'e1', '', n + 26, n + 38 FROM t
UNION ALL SELECT doc_id, 'excluded', 'x1', '', n + 38, n + 55 FROM t""")
def f28_body_parts(v):
    """Blocks, lines, links, empty blocks and excluded contexts with their places; what is in a comment is counted, not listed."""
    body = F.concat(F.lit("<p>"), "x", F.lit("<br>two <b>bold</b></p><div> </div><!-- <p>c</p> --><li>li</li >"), F.lit('<a href="/x">'), "x", F.lit("</a>"))
    rows = worded(v).select("doc_id", body.alias("body_html"))
    return I.part_table(rows, "doc_id").select("doc_id", "kind", "part_id", "text", "start", "stop")


@query()
def f29_page_parts(v):
    """Parts of the pages by kind, and how many of their intervals decode to their texts once more."""
    found = I.part_table(pages(v), "page_id").join(pages(v), "page_id")
    again = F.substring(F.col("body_html"), F.col("inner_start") + 1, F.col("inner_stop") - F.col("inner_start"))
    plain = F.btrim(F.regexp_replace(F.regexp_replace(again, "<[^<>]*>", " "), r"(?U)\s+", " "))
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.count_if((plain == F.col("text")) | F.contains(again, F.lit("&")) | (F.col("kind") == "excluded")).alias("found_again"), F.sum("images").alias("images"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents),
k AS (SELECT *, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS w FROM l), p AS (SELECT * FROM k WHERE w <> ''),
m AS (SELECT a.*, EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.pos <> a.pos AND ((b.w = a.w AND b.pos < a.pos) OR (b.w <> a.w AND length(a.w) >= 4 AND starts_with(b.w, a.w)))) AS goes FROM p a),
w AS (SELECT doc_id, string_agg(w, '' ORDER BY pos) AS whole FROM p GROUP BY 1)
SELECT a.doc_id, a.pos::VARCHAR AS part_id, arg_min(b.pos, (b.w, -b.pos))::VARCHAR AS keep_id, ((length(any_value(w.whole)) - length(replace(any_value(w.whole), a.w, ''))) // length(a.w))::INTEGER AS occurrences
FROM m a JOIN m b ON a.doc_id = b.doc_id AND NOT b.goes AND starts_with(b.w, a.w) JOIN w ON w.doc_id = a.doc_id WHERE a.goes GROUP BY a.doc_id, a.pos, a.w""")
def f35_repeated_parts(v):
    """Lines of each document that it says elsewhere, with the one to keep."""
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("start", "text"))
    found = lines.select("doc_id", "text", "start", (F.col("start") + 1).cast("string").alias("part_id"))
    return I.repeated_parts(found, "doc_id").select("doc_id", "part_id", "keep_id", "occurrences")


_LINED = f"WITH t AS (SELECT doc_id, {_X} AS x FROM documents)"


def lined(v):
    body = F.concat(F.lit("<p>"), "x", F.lit("。<br>摄影："), "x", F.lit("<br>图片=Agency</p><p>【视频】"), "x", F.lit("</p><p>"), "x", F.lit("！ 编排●"), F.lit("Web编辑部</p><p><b>摄影：x</b></p>"))
    return worded(v).select("doc_id", body.alias("body_html"))


@query(f"{_LINED} SELECT doc_id, 'photo_credit_line' AS rule, '摄影：' || x AS text FROM t UNION ALL SELECT doc_id, 'photo_credit_line', '图片=Agency' FROM t "
       "UNION ALL SELECT doc_id, 'media_caption_line', '【视频】' || x FROM t UNION ALL SELECT doc_id, 'editorial_byline_tail', '编排●Web编辑部' FROM t")
def f23_artifact_lines(v):
    """The audit: every line and tail that goes, and by which rule."""
    return L.artifact_lines(lined(v), "doc_id").select("doc_id", "rule", "text")


@query(f"{_LINED} SELECT doc_id, '<p>' || x || '。</p><p>' || x || '！</p><p><b>摄影：x</b></p>' AS clean FROM t")
def f23_cleaned_lines(v):
    return L.without_artifact_lines(lined(v), "doc_id")


@query(f"{_LINED} SELECT doc_id, '<p>' || x || '。</p><p>' || x || '。日期：周六。</p>' AS clean FROM t")
def f24_inline_sentences(v):
    """Calls and broadcast lines within paragraphs go, sentences around them stay."""
    body = F.concat(F.lit("<p>"), "x", F.lit("。ge 将实时跟进本场比赛（点击这里）。</p><p>"), "x", F.lit("。转播：ESPN。日期：周六。</p>"))
    return worded(v).select("doc_id", L.unpromoted(body).alias("clean"))


_SHOWN = "CASE id % 6 WHEN 0 THEN '请点击链接获取 ' || t WHEN 1 THEN t || ' 观看直播' WHEN 2 THEN '更多 ' || t || ' 新闻' WHEN 3 THEN '请在官方平台查看 ' || t || ' 最新消息' WHEN 4 THEN '【视频】' || t ELSE '在kayo上观看 ' || t || ' 无广告' END"


@query(f"""a AS (SELECT id, 'about ' || regexp_replace(substr(title_final, 1, 40), '[^a-z]+', ' ', 'g') AS t FROM articles), s AS (SELECT id, {_SHOWN} AS x FROM a)
SELECT id, id % 6 <> 1 AND id % 4 <> 3 AND id % 5 <> 2 AS promotional, id % 4 = 3 AND id % 6 = 4 AND id % 5 <> 2 AS removable_issue FROM s""", "articles")
def f46_promotional_plans(v):
    """Plans by family: promotion needs a type, a reason and the form of a call; other removals the form of an artefact."""
    rows = v.articles.select("id", F.concat(F.lit("about "), F.regexp_replace(F.substring("title_final", 1, 40), "[^a-z]+", " ")).alias("t"))
    i = F.col("id")
    reason = F.when(i % 5 == 2, "no").otherwise("该段是独立的推广入口，与正文无关，模板残留")
    plans = rows.select("id", F.expr(_SHOWN).alias("evidence"), F.when(i % 4 == 3, "模板残留").otherwise("Video-Promotion").alias("issue_type"), reason.alias("reason"))
    return E.judged_plans(plans).select("id", "promotional", "removable_issue")
