"""Rule checks of titles and bodies as columns; the HTML functions that need a tokenizer are in ``html``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IDEOGRAPH = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]"
#: Patterns of advertising in bodies. Fixed values.
DIRTY = ("点击购买", "扫码关注", "优惠活动", "立即下载", "加微信", "本文转自", "版权归", "未经许可", "摄影[：:]", r"【\s*图\s*[：:]")
#: Ends that look cut off. Fixed values.
CUT_TITLE, CUT_BODY = r"([，,、:：]|\.{2,}|…)$", r"(未完待续|\.\.\.$|…$|待续$)"
#: Remains of players and feeds, and attributes that lead elsewhere, in the source of a body. Fixed values.
REMAINS = (
    r"<\s*(?:area|embed|iframe|math|noscript|object|script|style|svg|template|video|audio)\b"
    r"|<!--\s*(?:#(?:include|set|exec|echo)|google_ad_section_|(?:start|end)\s+of\s+(?:brightcove|video-js|jwplayer))"
)
CLICKABLE = r"<[^>]+\s+(?:on[a-z][a-z0-9_-]*|data-(?:href|url|link)|xlink:href)\s*="
CONTROL = r"[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f]"


def language_ratio(text: Column) -> tuple[Column, Column, Column]:
    """Ideographs, other letters, and the share of the latter."""
    ideographs = F.regexp_count(text, F.lit(IDEOGRAPH))
    others = F.regexp_count(text, F.lit(r"[\p{L}&&[^" + IDEOGRAPH[1:] + "]"))
    return ideographs, others, F.when(ideographs + others > 0, others / (ideographs + others)).otherwise(0.0)


def title_problems(title: Column) -> Column:
    """empty, or any of short, cut, symbols."""
    value = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    found = F.array_compact(F.array(
        F.when(F.char_length(value) < 5, "short"), F.when(value.rlike(CUT_TITLE), "cut"), F.when(value.rlike(r"(?U)^[\W_]+$"), "symbols")
    ))
    return F.when(value == "", F.array(F.lit("empty"))).otherwise(found)


def body_problems(text: Column) -> Column:
    """short, cut, control, and dirty:n for each pattern that is found in a plain text, which is worked out once for all."""

    def problems(x: Column) -> Column:
        dirty = [F.when(x.rlike(f"(?i){p}"), f"dirty:{i}") for i, p in enumerate(DIRTY)]
        return F.array_compact(F.array(F.when(F.char_length(x) < 30, "short"), F.when(x.rlike(f"(?i){CUT_BODY}"), "cut"), F.when(x.rlike(CONTROL), "control"), *dirty))

    return F.get(F.transform(F.array(text), problems), 0)


def source_problems(body: Column) -> Column:
    """embed and clickable, for what is left in the source of a body."""
    return F.array_compact(F.array(F.when(body.rlike(f"(?i){REMAINS}"), "embed"), F.when(body.rlike(f"(?is){CLICKABLE}"), "clickable")))


def first_keyword(text: Column, keywords: list[str], head: int | None = None) -> Column:
    """The first keyword of the list that the text (or its head) has."""
    seen = F.substring(text, 1, head) if head else text
    return F.get(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(seen, k)), 0)


def all_keywords(text: Column, keywords: list[str], exclusions: list[str] = ()) -> Column:
    """All keywords that the text has once the exclusions are out, in the order of the list."""
    for x in exclusions:
        text = F.replace(text, F.lit(x), F.lit(""))
    return F.filter(F.array(*[F.lit(k) for k in dict.fromkeys(keywords)]), lambda k: F.contains(text, k))


def numbers(text: Column) -> Column:
    """The numeric expressions of a text, in order: digits with separators, signs of scores and per cent."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]+([.,:/-][0-9]+)*%?"), 0)


def cdn_url(path: Column, base: str) -> Column:
    """A relative path under the base; absolute ones stay."""
    value = F.trim(F.coalesce(path, F.lit("")))
    return F.when(value == "", "").when(value.rlike("(?i)^https?://"), value).when(F.startswith(value, F.lit("//")), F.concat(F.lit("https:"), value)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(value, F.lit("/"))))
