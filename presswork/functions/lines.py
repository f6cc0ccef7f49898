"""Lines of text blocks that aren't the article's: captions, bylines, credits and contacts, as rows with the rule that each meets.

A block is its lines with the breaks between them; a rule names a whole line, or the tail of one behind a sentence. What
goes is a table of intervals of the source (``cuts``), so a body is put together again from what is between them, and a
body without a hit is byte for byte what it was. A line goes with the break behind it; lines at a block's end go with
the break before them, back to the last line that stays; a block that loses every line goes as a whole.

Sentences inside a line (broadcasts, calls, captions) are judged one by one, each by what words it has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import index as I
from .html import _gated

#: Names of authors' roles, of pictures, and what is between them and a name. Fixed values.
BYLINE = r"编写|编译|撰文|编撰|编辑|记者|编排|整理|构成|供稿|文|著者"
PICTURE = r"摄影|撮影|攝影|图片|圖片|照片|写真"
BETWEEN = r"[:：=＝]"
ADDRESS = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,3}"
#: The most characters of a line that is judged. Fixed value.
MOST_LINE = 200
#: Rules of whole lines, the first that matches names a line. Fixed values.
LINES = (
    (
        "media_caption_line",
        r"(?:【\s*(?:图片|写真|视频|集锦|实战|直播|积分榜|赛程)[^】\r\n]{0,20}】"
        r"|\[\s*(?:图片|写真|photo|video|视频|集锦|直播|积分榜|赛程)[^\]\r\n]{0,20}\]"
        r")[^<>\r\n。]{0,120}",
    ),
    ("editorial_byline_line", rf"(?:{BYLINE})\s*[●•・·:：]\s*[^<>\r\n。]{{1,80}}"),
    ("ad_contact_line", rf"(?:合作咨询|商务咨询|广告咨询|合作洽谈|商务合作)\s*[:：]?[ \t　]*{ADDRESS}"),
    ("photo_credit_line", rf"[（(\[【]?\s*(?:{PICTURE})\s*{BETWEEN}\s*[^<>\r\n。！？!?]{{1,80}}?\s*[）)\]】]?"),
)
#: Rules of tails of lines, the first that is found. Fixed values.
TAILS = (
    ("editorial_byline_tail", rf"(?<=[。！？!?])[ \t　]*(?:{BYLINE})\s*[●•・·]\s*[^<>\r\n。！？!?]{{1,40}}[ \t　]*$"),
    ("editorial_byline_tail", r"(?<=[。！？!?])[ \t　]*[^<>\r\n。！？!?]{0,30}(?:编辑部|編集部)[ \t　]*[●•・·:：/／\-—][^<>\r\n。！？!?]{0,40}[ \t　]*$"),
    ("editorial_byline_tail", rf"(?<=[。！？!?])[ \t　]*[/／|｜·・\-—]?[ \t　]*(?:(?:{BYLINE})\s*[:：]?[ \t　]*)?{ADDRESS}[ \t　]*$"),
    (
        "photo_credit_tail",
        r"[ \t　]*(?:\[\s*(?:照片|写真|图片|photo)\s*\]\s*[=＝]\s*[^<>\[\]\r\n。！？!?]{1,60}"
        r"|\(\s*[Cc]\s*\)\s*[^<>\[\]\r\n。！？!?]{1,60})[ \t　]*$",
    ),
    ("photo_credit_tail", rf"[ \t　]*[/／|｜·・\-—]?[ \t　]*[（(\[【]\s*(?:{PICTURE})\s*{BETWEEN}\s*[^<>\r\n。！？!?]{{1,60}}?\s*[）)\]】][ \t　]*$"),
    ("photo_credit_tail", rf"(?<=[。！？!?])[ \t　]*[/／|｜·・\-—]?[ \t　]*(?:{PICTURE})\s*{BETWEEN}\s*[^<>\r\n。！？!?]{{1,60}}[ \t　]*$"),
)
#: What a body has if a line or a tail of it may go. Fixed values.
PROBE_LINES = (
    r"(?i)(【\s*(?:图片|写真|视频|集锦|实战|直播|积分榜|赛程)"
    r"|\[\s*(?:图片|照片|写真|photo|video|视频|集锦|直播|积分榜|赛程)"
    rf"|(?:{BYLINE})\s*[●•・·:：]"
    rf"|(?:{PICTURE})\s*{BETWEEN}"
    r"|编辑部|編集部|\(\s*c\s*\)|[A-Za-z0-9._%+\-]@[A-Za-z0-9\-])"
)
#: Names of platforms, calls, labels and verbs of broadcasts, facts that protect a sentence, and the most characters of
#: one that goes. Fixed values.
PLATFORM = (
    r"(?:ge|直播平台|转播|播出|流媒体|频道|客户端|"
    r"disney\+?|espn|hulu|paramount\+?|dazn|amazon|prime\s*video|youtube|twitch|"
    r"premiere|sportv|globoplay|globo|cazetv|"
    r"咪咕|优酷|腾讯体育|爱奇艺|抖音|快手|b站|哔哩哔哩|微博|视频号|公众号|app)"
)
CALL = (
    r"(?:点击(?:这里|查看|进入|观看|了解)?|扫码|扫描二维码|关注|订阅|下载|"
    r"访问|前往|登录|实时(?:跟进|直播|文字直播|更新)|跟进本场|观看直播|收看|"
    r"抢先看|尽在|敬请关注|更多(?:内容|资讯|新闻))"
)
TAIL_LABEL = r"(?:转播|直播平台|播出平台|播出|观看方式|收看方式)\s*[:：]"
LABEL = r"(?:转播|直播|播出|收看|观看方式|收看方式|观看)\s*[:：]"
BROADCAST = r"(?:现场直播|直播|转播|播出|放送|带来.{0,6}(?:直播|转播)|独家(?:直播|转播))"
PROTECTED = (
    r"(?:日期|时间|地点|球场|开球|预计首发|首发|缺阵|停赛|伤病|黄牌|红牌|裁判|"
    r"主裁|助理裁判|第四官员|var|积分|排名|名单|回归)"
)
MOST_SENTENCE, MOST_GAP = 80, 12
#: Labels of media that begin a caption sentence, the most characters behind one, and match data which protects it. Fixed values.
CAPTION = (
    r"(?:【\s*(?:图片|写真|视频|集锦|实战|直播|进球(?!者)|录像|回放|锦集)[^】\r\n]{0,20}】"
    r"|\[\s*(?:图片|写真|photo|video|视频|集锦|直播|进球(?!者)|录像|回放)[^\]\r\n]{0,20}\])"
)
MOST_CAPTION = 80
MATCH_DATA = r"\d+\s*[-－]\s*\d+|\d+\s*分钟|\d+\s*分\b|发布公告|官方宣布|正式宣布"

_MARKS = "。！？!?"
_BLANKS = " \t　"
_LINES = [(name, re.compile(pattern, re.I)) for name, pattern in LINES]
_TAILS = [(name, re.compile(pattern, re.I)) for name, pattern in TAILS]


# lines as rows


def line_rules(text: Column) -> tuple[Column, Column, Column]:
    """(rule of the whole line, rule of its tail, the tail) of a line of source; null where none holds."""
    value = F.regexp_replace(text, r"(?U)^[\s　]+|[\s　]+$", "")
    short = (F.char_length(value) <= MOST_LINE) & (value != "")
    whole = F.when(short, F.coalesce(*[F.when(value.rlike(f"(?iu)^(?:{p})$"), F.lit(name)) for name, p in LINES]))
    found = [F.when(text.rlike(f"(?iu){p}"), F.struct(F.lit(name).alias("rule"), F.regexp_extract(text, f"(?iu){p}", 0).alias("tail"))) for name, p in TAILS]
    tail = F.when(whole.isNull() & (F.char_length(text) <= MOST_LINE), F.coalesce(*found))
    stays = F.btrim(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(tail["tail"])), F.lit(_BLANKS)) != ""
    return whole, F.when(stays, tail["rule"]), F.when(stays, tail["tail"])


def artifact_lines(bodies: DataFrame, key: str, body: str = "body_html") -> DataFrame:
    """key, part_id, rule, text, start, stop: what goes from each body, and why."""
    held = bodies.select(key, F.col(body).alias("_body")).filter(F.col("_body").rlike(PROBE_LINES))
    rows = held.lateralJoin(I.table_function()(F.col("_body").outer())).filter(F.col("kind").isin("line", "blank") & F.col("tag").isin(*I.EMPTIES))
    rows = rows.select(key, "part_id", "parent_id", "start", "stop", F.substring(F.col("_body"), F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"), "block_start", "block_stop")
    block = W.partitionBy(key, "parent_id")
    rows = rows.withColumn("_plain", F.min((~F.contains("text", F.lit("<"))).cast("int")).over(block)).filter("_plain = 1")
    whole, tail_rule, tail = line_rules(F.col("text"))
    rows = rows.withColumns({"_whole": whole, "_tail_rule": tail_rule, "_tail": tail})
    own_stop = F.col("stop") - F.coalesce(F.char_length("_tail"), F.lit(0))
    order = block.orderBy("start")
    rows = rows.withColumns({
        "_next": F.lead("start").over(order), "_kept": F.count_if(F.col("_whole").isNull()).over(block),
        "_later": F.count_if(F.col("_whole").isNull()).over(order.rowsBetween(1, W.unboundedFollowing)),
        "_last": F.max(F.when(F.col("_whole").isNull(), own_stop)).over(block),
    })
    rule = F.coalesce("_whole", "_tail_rule")
    start = F.when(F.col("_whole").isNull(), own_stop).when(F.col("_kept") == 0, F.col("block_start")).when(F.col("_later") > 0, F.col("start")).otherwise(F.col("_last"))
    stop = F.when(F.col("_whole").isNull(), F.col("stop")).when(F.col("_kept") == 0, F.col("block_stop")).when(F.col("_later") > 0, F.col("_next")).otherwise(F.col("stop"))
    gone = F.when(F.col("_whole").isNull(), F.col("_tail")).otherwise(F.col("text"))
    return rows.withColumn("rule", rule).filter("rule is not null").select(key, "part_id", "rule", F.btrim(gone, F.lit(_BLANKS)).alias("text"), start.alias("start"), stop.alias("stop"))


def without_artifact_lines(bodies: DataFrame, key: str, body: str = "body_html") -> DataFrame:
    """key and ``clean``: the bodies without those lines and tails."""
    return I.cut_out(bodies, artifact_lines(bodies, key, body), key, body)


def rule_of_line(text: str) -> str | None:
    value = text.strip()
    return next((name for name, p in _LINES if p.fullmatch(value)), None) if 0 < len(value) <= MOST_LINE else None


def tail_of_line(text: str) -> int:
    """Where a line's tail begins that goes; its length if none does."""
    found = next((m for _, p in _TAILS if (m := p.search(text))), None) if len(text) <= MOST_LINE else None
    return found.start() if found and text[: found.start()].strip() else len(text)


def lines_taken_out(body: str | None) -> str:
    """The same for one body, as a step among others."""
    body = body or ""
    blocks: dict[str, list[I.Part]] = {}
    for p in I.parts(body):
        if p.kind in ("line", "blank") and p.tag in I.EMPTIES:
            blocks.setdefault(p.parent_id, []).append(p)
    cuts = []
    for held in blocks.values():
        texts = [body[p.start : p.stop] for p in held]
        if any("<" in t for t in texts):
            continue
        whole = [rule_of_line(t) is not None for t in texts]
        ends = [p.stop if gone else p.start + tail_of_line(t) for p, t, gone in zip(held, texts, whole, strict=True)]
        if all(whole):
            cuts.append((held[0].block_start, held[0].block_stop))
            continue
        last = max(i for i, gone in enumerate(whole) if not gone)
        cuts += [(held[i].start, held[i + 1].start) if i < last else (ends[last], p.stop) for i, p in enumerate(held) if whole[i]]
        cuts += [(e, p.stop) for e, p, gone in zip(ends, held, whole, strict=True) if not gone and e < p.stop]
    out, at = [], 0
    for start, stop in sorted(cuts):
        out.append(body[at : max(at, start)])
        at = max(at, stop)
    return "".join([*out, body[at:]])


unlined = _gated(lines_taken_out, PROBE_LINES)


# sentences inside text


_SENTENCE = re.compile(rf"[^{_MARKS}\r\n]*(?:[{_MARKS}]|\r\n|\r|\n|$)")
_CLAUSE = re.compile(r"[，,、；;]?[^，,、；;]+")
_HAS = {name: re.compile(value, re.I) for name, value in {"platform": PLATFORM, "call": CALL, "tail": TAIL_LABEL, "label": LABEL, "broadcast": BROADCAST, "protected": PROTECTED}.items()}
_CAPTION, _MATCH_DATA = re.compile(CAPTION, re.I), re.compile(MATCH_DATA)


def _apart(first: re.Match[str] | None, found: list[re.Match[str]]) -> bool:
    """Is one of some matches outside of another?"""
    return first is not None and any(m.end() <= first.start() or m.start() >= first.end() for m in found)


def judged_sentence(sentence: str) -> str:
    """What stays of one sentence: all of it, the facts before a broadcast's label, the clauses before a broadcast, or nothing."""
    words = sentence.rstrip(_MARKS + "\r\n")
    end = sentence[len(words) :]
    if (label := _HAS["tail"].search(words)) and (_HAS["call"].search(words, label.end()) or not words[label.end() :].strip()):
        words = words[: label.start()]  # the label and the call behind it go, facts before it stay
    protected = _HAS["protected"].search(words)
    short = len(words + end) <= MOST_SENTENCE
    if short and end.strip() and not protected and _HAS["label"].search(words):
        return ""
    clauses = _CLAUSE.findall(words)
    if clauses and not _HAS["protected"].search(clauses[-1]) and len(clauses[-1]) <= MOST_SENTENCE and _announces(clauses[-1]):
        words = "".join(clauses[:-1])
    platforms, calls = list(_HAS["platform"].finditer(words)), list(_HAS["call"].finditer(words))
    if short and any(_apart(p, calls) for p in platforms):
        return ""
    return words + end


def _announces(clause: str) -> bool:
    """Does a clause say where something is broadcast: a platform and shortly behind it the verb?"""
    return any(_HAS["broadcast"].search(clause, p.end(), p.end() + MOST_GAP + 8) for p in _HAS["platform"].finditer(clause))


def judged_caption(sentence: str, begins: bool) -> str:
    """A sentence that begins with a medium's label goes, unless match data follow the label."""
    head = sentence.lstrip(_BLANKS)
    label = _CAPTION.match(head) if begins else None
    if label and len(head) - label.end() <= MOST_CAPTION + 1 and not _MATCH_DATA.search(head, label.end()):
        return ""
    return sentence


def _outside_tags(body: str | None, judge) -> str:
    """The body with each text between its tags judged."""
    pieces = re.split(r"(<[^>]*>)", body or "")
    pieces[::2] = [judge(p) if p else p for p in pieces[::2]]
    return "".join(pieces)


def without_promotional_sentences(body: str | None) -> str:
    """Broadcast lines and tails, and short sentences with a platform and a call, go; markup stays."""
    return _outside_tags(body, lambda text: "".join(map(judged_sentence, _SENTENCE.findall(text))))


def without_caption_sentences(body: str | None) -> str:
    """Sentences that are captions of media go, with the blanks around them."""

    def judge(text: str) -> str:
        out, begins, gone = "", True, False
        for s in _SENTENCE.findall(text):
            kept = judged_caption(s, begins)
            out += kept.lstrip(_BLANKS) if gone else kept
            begins, gone = bool(s) and s[-1] in _MARKS + "\r\n", bool(s) and not kept
        return out

    return _outside_tags(body, judge)


PROBE_PROMOTION = f"(?i)({PLATFORM}|{LABEL}|{TAIL_LABEL})"
PROBE_CAPTION = f"(?i){CAPTION}"
unpromoted = _gated(without_promotional_sentences, PROBE_PROMOTION)
uncaptioned = _gated(without_caption_sentences, PROBE_CAPTION)
