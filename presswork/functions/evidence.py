"""What an edit plan says about itself: families of issues, reasons, and whether the quoted text is promotion.

Two factors are asked of promotion in a wording that no rule knows: it begins as a call, and it names where to go and what
there is to gain (or a broadcaster's platform). All of it is columns over a table of plans; nothing here runs in Python
but the compatible forms of texts that aren't ASCII.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from .promotion import MOST as MOST_BLOCK, PATTERNS, rule_of
from .quality import compatible

#: Issue types: of promotion, of other removals, of replacements, and other names of them. Fixed values.
PROMOTION_TYPES = (
    "promotion", "advertisement", "traffic_generation", "call_to_action", "media_promotion", "program_promotion", "channel_promotion",
    "external_promotion", "schedule_promotion", "social_promotion", "sponsorship_promotion", "video_promotion", "引流", "推广", "广告", "广告引流",
    "视频引流", "节目推广", "频道推广", "standalone_program_promotion", "standalone_media_promotion", "standalone_ad_promotion", "standalone_external_promotion",
)
REMOVAL_TYPES = ("extraneous_content", "duplicate_content", "template_artifact", "format_noise", "无关内容", "重复内容", "模板残留", "格式噪声")
REPLACEMENT_TYPES = ("minor_text_defect", "format_noise", "轻微文本缺陷", "格式噪声")
TYPE_NAMES = {"无关内容": "extraneous_content", "重复内容": "duplicate_content", "模板残留": "template_artifact", "格式噪声": "format_noise", "轻微文本缺陷": "minor_text_defect"}
DUPLICATE = "duplicate_content"
#: Least and most characters of a reason, and most of a promotional text and of an issue type. Fixed values.
LEAST_REASON, MOST_REASON, MOST_EVIDENCE, MOST_TYPE = 4, 500, 240, 80
#: Whole texts that are teasers, score boards and programme notes. Fixed values.
VIDEO_TEASER = r"^(?:【视频】|【集锦视频】|【实战视频】|【视频集锦】|\[视频\]|\[集锦视频\]|\[实战视频\]|\[视频集锦\])\s*[^<>\r\n]{2,170}$"
SCOREBOARD = r"^(?:【积分榜】|\[积分榜\])\s*[^<>\r\n]{2,170}$"
PROGRAM = r"^[●•+]\s*.{0,100}(?:节目|播客|podcast).{0,120}(?:开播|播出|上线|观看|收听).{0,100}$"
#: How a call begins. Fixed values.
CALL_PREFIX = (
    r"^[+✅📲➡️🗞️\s]*(?:(?:请|立即|现在|欢迎)\s*"
    r"(?:点击|扫码|扫描二维码|关注|订阅|下载|购买|收听|听听|观看|收看|"
    r"进入|前往|打开|访问|查看|查看更多|查看全部)|"
    r"点击这里|扫码|扫描二维码|查看更多|查看全部)"
)
IN_PREFIX = r"^[+✅📲➡️🗞️\s]*(?:请|立即|现在|欢迎)\s*在"
WATCH_HEADING = r"^[+✅📲➡️🗞️\s]*(?:观看(?:更多)?|收看)\s*[:：]"
MORE_HEADING = r"^(?:更多|查看更多|查看全部).{0,80}(?:新闻|资讯|消息|动态|内容)\s*[:：]?$"
#: Actions, benefits, destinations and platforms. Fixed values.
ACTION = (
    r"(?:点击|扫码|扫描二维码|关注|订阅|下载|购买|收听|听听|观看|收看|"
    r"获取|查看|进入|前往|打开|访问|最新|更多|查看更多|查看全部|全部内容|更多内容|尽在|"
    r"优惠|活动)"
)
BENEFIT = (
    r"(?:获取|接收|领取|最新|全部|更多|查看更多|查看全部|尽在|一切|"
    r"完整(?:内容|信息|资讯|新闻|赛程|视频|节目|回放)|"
    r"观看全部|收看全部)"
)
DESTINATION = (
    r"(?:官网|官方网站|网站|链接|频道|群组|社群|平台|whatsapp|telegram|电报|"
    r"播客|podcast|直播间|二维码|应用|app|客户端|小程序|商店)"
)
IN_DESTINATION = r"(?:官方平台|官方媒体|官方网站|官网|网站|频道|平台|媒体|whatsapp|telegram|电报|群组|社群)"
MEDIA_PLATFORM = r"(?:^|[\s、，,：:;；|/（）()])(?:ge|globo|sportv)(?![a-z])"
PAID_PLATFORM = r"(?<![A-Za-z0-9])(?:kayo|bein\s+sports|fox\s+sports\s+sportmail|sportmail)(?![A-Za-z])"
PAID_BENEFIT = r"(?:无广告|新用户|订阅|开通|收件箱|第一时间|获取最新|观看直播|比赛直播|精彩集锦|集锦和分析)"
#: Words of reasons: promotion, what stands alone, what has nothing to do with the article, what is meant, and artefacts. Fixed values.
SAYS_PROMOTION = (
    r"(?:推广|广告|引流|导流|宣传|引导|号召|节目|视频|频道|关注|点击|直播|外部|链接|促销|商业|"
    r"赞助|营销|接收|获取|"
    r"promotion|advert|traffic|media|program|channel|external|sponsor)"
)
SAYS_ALONE = r"(?:独立|单独|额外|入口)"
SAYS_UNRELATED = r"(?:无关|不属于|不是(?:新闻|正文|事实)|非(?:新闻|正文|事实))"
SAYS_WHAT = (
    r"(?:独立|单独|额外|入口|该段|这段|此段|该块|这块|该内容|这条内容|"
    r"该句|这句|该行|这行|该文字|这部分)"
)
SAYS_ARTIFACT = (
    r"(?:入口|引流|导流|推广|广告|跳转|外链|占位|"
    r"(?:采集|抓取|解析|模板|格式).{0,12}(?:残留|噪声|错误|异常))"
)
#: Artefacts of feeds by their form, media labels alone, bracketed heads, and calls behind them. Fixed values.
STRUCTURAL = (
    r"^(?:"
    r"【\s*(?:图片|写真|视频|集锦|实战|直播|积分榜|赛程|节目|播客|广告|推荐|相关阅读|更多)"
    r"[^】\r\n]{0,20}】"
    r"|\[\s*(?:图片|写真|photo|video|视频|集锦|直播|积分榜|赛程|节目|podcast)"
    r"[^\]\r\n]{0,20}\]"
    r"|(?:https?://|www\.)\S+\s*$"
    r")|(?:\[[^\]]*(?:照片|写真|photo)[^\]]*\]\s*[=＝])"
)
MEDIA_LABEL = (
    r"^(?:"
    r"【\s*(?:图片|写真|视频|集锦|集锦视频|实战视频|视频集锦)\s*】"
    r"|\[\s*(?:图片|写真|photo|video|视频|集锦|集锦视频|实战视频|视频集锦)\s*\]"
    r")\s*[^<>\r\n]{2,170}$"
)
BRACKET_HEAD = r"^(?:【[^】\r\n]{1,24}】|\[[^\]\r\n]{1,24}\])\s*"
CALL_BEHIND = (
    r"^(?:(?:请|立即|现在|欢迎)\s*)?"
    r"(?:点击|查看|查看更多|查看全部|观看|收看|进入|前往|打开|访问|扫码|"
    r"关注|订阅|下载|收听)"
    r"|^(?:更多|完整).{0,30}(?:内容|资讯|新闻|赛程|视频|节目|回放)"
    r"|(?:直播(?:结束后)?还?(?:会|将)?提供?回放|提供回放)"
    r"|(?:只要|仅需|注册(?:即|后)?即?可|登录后即可).{0,20}(?:免费)?(?:观看|收看|回看)"
    r"|(?:免费观看|免费收看|随时回看|随时观看)"
    r"|(?:见|详见|点击|观看|参见)\s*(?:下方|下图|上方|文末|文中|上图|下面|以下|本文)?\s*"
    r"(?:视频|图片|集锦|录像|回放|直播|海报)"
    r"|(?:下方|文末|文中|以下)\s*(?:视频|图片|集锦|录像|回放|直播|海报)"
)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def _flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def issue_type(raw: Column) -> Column:
    """One spelling of each issue type."""
    name = F.regexp_replace(F.lower(F.btrim(F.coalesce(raw, F.lit("")))), r"(?U)[\s-]+", "_")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair]), name), name)


def valid_reason(reason: Column) -> Column:
    """A reason has 4 to 500 characters and no markup."""
    text = _flat(reason)
    return F.char_length(text).between(LEAST_REASON, MOST_REASON) & ~text.rlike("[<>]")


def _promotional(has, no, by_rule):
    """The form of promotion, for a column (``has`` gives columns) or a text (it gives truth values)."""
    known = by_rule | has(VIDEO_TEASER) | has(SCOREBOARD) | has(PROGRAM)
    action, benefit, platform, paid = has(ACTION), has(BENEFIT), has(MEDIA_PLATFORM), has(PAID_PLATFORM)
    in_prefix, more = has(IN_PREFIX), has(MORE_HEADING)
    begins = has(CALL_PREFIX) | in_prefix | has(WATCH_HEADING) | more
    where_to = (in_prefix & benefit & (platform | has(IN_DESTINATION))) | (no(in_prefix) & (more | (benefit & (platform | has(DESTINATION)))))
    return known | (paid & action & has(PAID_BENEFIT)) | (no(paid) & begins & action & where_to)


def promotional_evidence(text: Column) -> Column:
    """Has the text the form of promotion that stands alone?"""
    t = compatible(_flat(text))
    return (t != "") & (F.char_length(t) <= MOST_EVIDENCE) & _promotional(lambda p: _has(t, p), lambda c: ~c, rule_of(t).isNotNull())


def is_promotional(text: str) -> bool:
    """The same for one text."""
    t = " ".join(unicodedata.normalize("NFKC", text).split())
    known = len(t) <= MOST_BLOCK and any(re.search(p, t, re.I) for _, p in PATTERNS)
    return 0 < len(t) <= MOST_EVIDENCE and _promotional(lambda p: re.search(p, t, re.I) is not None, lambda x: not x, known)


def judged_plans(plans: DataFrame) -> DataFrame:
    """plans (evidence, issue_type, reason; optionally fixed_marker) with ``issue``, ``promotional`` and ``removable_issue``.

    promotional: the plan says that a text is promotion, why it stands apart from the article, and the text looks like it.
    A text that a rule knows (fixed_marker) needs no other form. Plans without type and reason go by the rules alone.
    removable_issue: its type is one of removals with a valid reason, and the text is an artefact by its form; for repeated
    content the type is enough, as what is kept is looked at apart.
    """
    text, reason, issue = _flat(F.col("evidence")), _flat(F.col("reason")), issue_type(F.col("issue_type"))
    marker = F.coalesce(F.col("fixed_marker"), F.lit(False)) if "fixed_marker" in plans.columns else F.lit(False)
    silent = F.col("issue_type").isNull() & F.col("reason").isNull()
    told = F.col("issue_type").isNotNull() & F.col("reason").isNotNull()
    apart = _has(reason, SAYS_UNRELATED) & (_has(reason, SAYS_ALONE) | _has(reason, SAYS_WHAT))
    family = told & (F.char_length(issue) <= MOST_TYPE) & issue.isin(*PROMOTION_TYPES) & valid_reason(F.col("reason"))
    said = family & apart & (marker | (_has(reason, SAYS_PROMOTION) & promotional_evidence(F.col("evidence"))))
    by_rule = rule_of(compatible(text)).isNotNull() | _has(text, VIDEO_TEASER)
    tail = F.btrim(F.regexp_replace(text, f"(?iU){BRACKET_HEAD}", ""))
    bracketed = _has(reason, SAYS_ARTIFACT) & (_has(text, MEDIA_LABEL) | (_has(text, BRACKET_HEAD) & _has(tail, CALL_BEHIND)))
    artefact = _has(text, STRUCTURAL) & (~text.rlike(r"^[【\[]") | bracketed)
    removal = issue.isin(*REMOVAL_TYPES) & valid_reason(F.col("reason")) & ((issue == DUPLICATE) | artefact)
    return plans.withColumns({"issue": issue, "promotional": F.coalesce(F.when(silent, by_rule).otherwise(said), F.lit(False)), "removable_issue": F.coalesce(removal, F.lit(False))})
