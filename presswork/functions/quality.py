"""The quality record without a model, and stable names of competitions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from . import text as X
from .html import _gated, plain_text

#: Texts of a record. Fixed values.
CLEAN, CHANNELS_MISSING, JOINED_BY, MOST_REASON = "内容正常", "channels 缺失", "；", 300
#: Names of competitions: the label of what is none, other spellings, and noise of seasons and stages. Fixed values.
NO_COMPETITION = "非赛事"
ALIASES = {"南美解放者杯": "解放者杯", "libertadores": "解放者杯", "power work cup": "POWER WORK杯"}
NOISE = (
    r"(20\d{2}([-/]\d{2,4})?|\d{2}/\d{2}|赛季|第\s*\d+\s*(轮|比赛日|回合)"
    r"|四分之一决赛|八分之一决赛|\d+\s*/\s*\d+\s*决赛|总决赛|半决赛|决赛"
    r"|小组赛|附加赛|季后赛)"
)
EDGES = " -—·、,，.。"


#: What is said of a title's and a body's problems, of a region, and of answers. Fixed values.
TITLE_SAID = {"empty": "标题为空", "short": "标题过短，信息不完整", "cut": "标题疑似截断", "symbols": "标题只有符号"}
BODY_SAID = {
    "short": "正文为空或少于30字", "cut": "正文疑似截断", "embed": "正文包含未清理的播放器或采集残留", "clickable": "正文包含未清理的可跳转属性", "control": "正文包含乱码或控制字符",
}
DIRTY_SAID, REGION_SAID = "疑似广告或脏内容：", ("文章涉及敏感地域信息「", "」，需人工审核")
TITLE_ANSWER, BODY_ANSWER, DIRT_ANSWER = "AI 判断标题可能不完整：", "AI 判断正文可能不完整：", "AI 判断可能含广告或脏内容："
BAD_FIELDS, ASK_AGAIN = "AI 质检返回字段格式错误：", "，需要人工确认"
TITLE_CONFLICT, BODY_CONFLICT = "AI 修复计划与标题完整性结论矛盾", "AI 修复计划与正文完整性结论矛盾"
WAITING = "发现可验证的局部问题，等待自动修复后再次质检"
#: Names of the fields of an answer, the characters of its reason, and those of the text in which regions are looked for. Fixed values.
FIELDS, MOST_SAID, HEAD = {"title_complete": "title_complete", "body_complete": "body_complete", "has_dirty": "has_ad_or_dirty", "needs_review": "needs_review"}, 200, 2000


def _judged(title: Column, body: Column, text: Column) -> dict[str, Column]:
    """Lists by the rules alone, in sentences: the title's, what the body lacks, and the dirt in it."""
    told = {**BODY_SAID, **{f"dirty:{i}": DIRTY_SAID + p for i, p in enumerate(X.DIRTY)}}
    said = lambda names, of: F.transform(names, lambda x: F.element_at(F.create_map(*[F.lit(v) for pair in of.items() for v in pair]), x))
    found, lacking = X.body_problems(text), F.array(F.lit("short"), F.lit("cut"))
    dirt = F.concat(F.filter(found, lambda x: F.startswith(x, F.lit("dirty"))), X.source_problems(F.coalesce(body, F.lit(""))), F.filter(found, lambda x: x == "control"))
    return {"title_problems": said(X.title_problems(title), TITLE_SAID), "dirty_content": said(dirt, told), "completeness_problems": said(F.filter(found, lambda x: F.array_contains(lacking, x)), told)}


def evaluated(articles: DataFrame, verdicts: DataFrame, regions: list[str]) -> DataFrame:
    """The quality record of each article (id, title, body, channels).

    verdicts: id, title_complete, body_complete, has_dirty, needs_review, reason, plans (number of local repairs) and,
    where plans only take away what the body doesn't need, keeps_body. An article without one is judged by the rules
    alone; a null among its booleans is an invalid answer. A region's word in the title or in the first characters of the
    body's text ends the evaluation. A verdict adds to a list only where the rules found nothing for it. Repairs are
    taken up where there are plans without a conflict and the title is in order, whatever else is found.
    """
    asked = verdicts.withColumn("asked", F.lit(True))
    if "keeps_body" not in verdicts.columns:
        asked = asked.withColumn("keeps_body", F.lit(False))
    rows = articles.join(asked, "id", "left").withColumn("_text", plain_text(F.col("body")))
    head = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring("_text", 1, HEAD))
    rows = rows.withColumn("region", X.first_keyword(head, regions)).withColumns(_judged(F.col("title"), F.col("body"), F.col("_text")))
    asked, none = F.coalesce("asked", F.lit(False)), F.array().cast("array<string>")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    plans = F.coalesce("plans", F.lit(0)) > 0
    said = F.substring(F.coalesce("reason", F.lit("")), 1, MOST_SAID)
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(name)) for c, name in FIELDS.items()]))
    wrong = F.when(plans & ~yes("title_complete"), TITLE_CONFLICT).when(plans & ~yes("body_complete") & ~yes("keeps_body"), BODY_CONFLICT)
    wrong = F.when(asked, F.coalesce(wrong, F.when(F.size(bad) > 0, F.concat(F.lit(BAD_FIELDS), F.array_join(bad, ",")))))
    add = lambda name, when, label: F.when(when & (F.size(name) == 0), F.array(F.concat(F.lit(label), said))).otherwise(F.col(name))
    rows = rows.withColumns({
        "title_problems": add("title_problems", no("title_complete"), TITLE_ANSWER), "dirty_content": add("dirty_content", yes("has_dirty"), DIRT_ANSWER),
        "completeness_problems": add("completeness_problems", no("body_complete") & ~(plans & yes("keeps_body")), BODY_ANSWER),
        "channel_problems": F.when(F.col("channels").isNull(), F.array(F.lit(CHANNELS_MISSING))).otherwise(none), "_wrong": wrong,
    })
    quiet = (F.size("title_problems") == 0) & (F.size("dirty_content") == 0) & (F.size("completeness_problems") == 0)
    unsure = F.concat(F.when(F.col("_wrong").isNotNull(), F.array(F.concat("_wrong", F.lit(ASK_AGAIN)))).otherwise(none), F.when(yes("needs_review") & quiet, F.array(said)).otherwise(none))
    rows = rows.withColumn("semantic_problems", unsure)
    lists = ["title_problems", "dirty_content", "completeness_problems", "channel_problems", "semantic_problems"]
    every = F.concat(*lists)
    repairable = plans & F.col("_wrong").isNull() & (F.size("title_problems") == 0)
    decision = F.when(F.col("region").isNotNull(), F.lit(None)).when(repairable, "repairable").when(F.size(every) > 0, "manual_review").otherwise("clean")
    clean = F.coalesce(decision == "clean", F.lit(False))
    regional = F.concat(F.lit(REGION_SAID[0]), "region", F.lit(REGION_SAID[1]))
    issues = F.create_map(*[x for k in lists for x in (F.lit(k), F.col(k))])
    joined = F.nullif(F.substring(F.array_join(every, JOINED_BY), 1, MOST_REASON), F.lit(""))
    reason = F.when(F.col("region").isNotNull(), regional).when(clean, CLEAN).otherwise(F.coalesce(joined, F.nullif(said, F.lit("")), F.lit(WAITING)))
    return rows.select(
        "id", clean.alias("pass"), (~clean).alias("needs_review"), decision.alias("decision"), F.when(clean, 100).otherwise(50).alias("score"), F.lit("B").alias("level"),
        F.col("region").isNotNull().alias("regional_sensitive"), F.col("region").alias("matched_keyword"), reason.alias("reason"),
        F.when(F.col("region").isNotNull(), F.create_map(F.lit("regional_sensitive"), F.array(regional))).otherwise(issues).alias("issues"),
    )


def _compatible(value: str) -> str:
    return unicodedata.normalize("NFKC", value)


#: NFKC, for texts that aren't ASCII.
compatible = _gated(_compatible, r"[^\x00-\x7F]")


def competition_names(rows: DataFrame, value: str, known: str, out: str = "competition") -> DataFrame:
    """The rows with one spelling of each competition: noise of season and stage goes, other spellings are mapped, and
    if the value has the name of exactly one of the ``known`` (an array) in it, it is that one; empty if nothing is left."""
    rows = rows.withColumn("_raw", F.trim(compatible(F.coalesce(F.col(value), F.lit("")))))
    bare = F.btrim(F.regexp_replace(F.regexp_replace("_raw", NOISE, ""), r"(?U)\s+", " "), F.lit(EDGES))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    rows = rows.withColumn("_bare", bare).withColumn("_name", F.coalesce(F.element_at(alias, F.lower("_bare")), "_bare"))
    inside = F.filter(F.transform(known, lambda k: F.trim(k)), lambda k: (F.char_length(k) >= 2) & F.contains(F.lower("_name"), F.lower(k)))
    named = F.when(F.contains("_raw", F.lit(NO_COMPETITION)), NO_COMPETITION).when(F.col("_bare") == "", "").when(F.size(inside) == 1, F.get(inside, 0)).otherwise(F.col("_name"))
    return rows.withColumn(out, named).drop("_raw", "_bare", "_name")
