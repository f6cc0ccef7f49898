"""Rows of quality records, repairs, runs, verdicts and account tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schemas import ISSUES, QUALITY

#: The tab's name in a reason of the guard. Fixed value.
REJECTED_TAB = "不属于「([^」]+)」"
#: Words of dirt that is advertising. Fixed values.
ADVERTISING = ("广告", "购买")


def decoded(articles: DataFrame) -> DataFrame:
    """The quality column as a struct; malformed JSON is a struct of nulls, never an error."""
    return articles.withColumn("q", F.from_json("quality", QUALITY, {"mode": "PERMISSIVE"}))


def ordered_tabs(article_tabs: DataFrame) -> DataFrame:
    """article_id and its tabs in their order."""
    pairs = F.array_sort(F.collect_list(F.struct("sort_order", "tab_id")))
    return article_tabs.groupBy("article_id").agg(F.transform(pairs, lambda x: x["tab_id"]).alias("tab_ids"))


def canonical_fields(items: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """For every field the first of its columns that isn't empty, or ''."""
    first = lambda cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit(""))
    return items.withColumns({f"c_{field}": first(columns) for field, columns in names.items()})


def lenient_channels(column: str) -> Column:
    """Integers of a JSON array of anything; what isn't one is left out, as is what occurs again."""
    raw = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.filter(raw, lambda x: F.coalesce(F.trim(x).rlike(r"^-*\d{1,18}$") & ~F.trim(x).rlike("^--"), F.lit(False))), lambda x: F.trim(x).cast("bigint")))


def consumed_attempts(repairs: DataFrame, version: int) -> DataFrame:
    """Is an article's repair used up: applied, without a fingerprint, or failed on the same body by no older rule?"""
    same = (F.col("body_sha256") == F.sha2("body_html", 256)) & (F.coalesce("rule_version", F.lit(0)) >= version)
    used = F.when(~F.coalesce("attempted", F.lit(False)), False).when(F.coalesce("applied", F.lit(False)), True).when(F.col("body_sha256").isNull(), True).otherwise(F.coalesce(same, F.lit(False)))
    return repairs.select("id", used.alias("consumed"))


def valid_verdicts(raw: DataFrame, offered: str | None = None) -> DataFrame:
    """id, belongs, confidence, valid of raw answers: JSON with a boolean and a finite number, or invalid; with
    ``offered``, a column of ids, the answer's ``matched_id`` has to be one of them where it has one."""
    answer = F.try_parse_json("answer")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(answer, f"$.{path}", "variant"))
    number = F.try_variant_get(answer, "$.confidence", "double")
    valid = (kind("belongs") == "BOOLEAN") & kind("confidence").rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$") & (F.abs(number) < float("inf"))
    if offered:
        matched = F.try_variant_get(answer, "$.matched_id", "bigint")
        unasked = F.coalesce(kind("matched_id").isin("VOID"), F.lit(True))
        valid = valid & (unasked | F.coalesce(F.array_contains(offered, matched), F.lit(False)))
    valid = F.coalesce(valid, F.lit(False))
    return raw.select("id", F.when(valid, F.try_variant_get(answer, "$.belongs", "boolean")).alias("belongs"), F.when(valid, number).alias("confidence"), valid.alias("valid"))


def run_views(runs: DataFrame) -> DataFrame:
    """Runs with their counts from JSON, the first failure and a label for the status."""
    n = lambda p: F.coalesce(F.get_json_object("details", f"$.{p}").cast("int"), F.lit(0))
    failed = F.get_json_object("details", "$.failed")
    label = F.when(F.col("status") == "success", "done").when(F.col("status") == "partial", "partly done").when(F.col("status") == "error", "failed").otherwise(F.col("status"))
    return runs.select("run_id", n("fetched").alias("fetched"), n("inserted").alias("inserted"), F.when(failed.isNotNull(), F.concat(F.lit("failed: "), failed)).otherwise("done").alias("message"), label.alias("status_label"))


def run_tally(outcomes: DataFrame, most: int = 100) -> DataFrame:
    """run_id, n, failed, failed_ids (the first, ``most`` at most), tally (state=count, ...), status: PARTIAL if any item
    is in ERROR. Ids are ranked before they are gathered, so a run in which everything failed gathers no more of them."""
    bad = F.col("state") == "ERROR"
    counts = outcomes.groupBy("run_id", "state").agg(F.count("*").alias("n"))
    each = counts.groupBy("run_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("failed"), F.sort_array(F.collect_list(F.concat("state", F.lit("="), F.col("n").cast("string")))).alias("each"))
    first = outcomes.filter(bad).withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy("id"))).filter(F.col("_n") <= most)
    listed = first.groupBy("run_id").agg(F.sort_array(F.collect_list("id")).alias("failed_ids"))
    status = F.when(F.col("failed") > 0, "PARTIAL").otherwise("SUCCESS")
    return each.join(listed, "run_id", "left").select("run_id", "n", "failed", F.coalesce("failed_ids", F.array().cast(listed.schema["failed_ids"].dataType)).alias("failed_ids"), F.array_join("each", ",").alias("tally"), status.alias("status"))


def issue_flags(articles: DataFrame) -> DataFrame:
    """Flags from the issue lists of the record: complete title and body, advertising, dirt. A missing list is empty."""
    none = F.array().cast("array<string>")
    q = decoded(articles).select("id", *[F.coalesce(F.col("q.issues")[k], none).alias(k) for k in ISSUES])
    advert = F.exists("dirty_content", lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in ADVERTISING]))
    return q.select("id", (F.size("title_problems") == 0).alias("title_complete"), (F.size("completeness_problems") == 0).alias("body_complete"), advert.alias("has_ad"), (F.size("dirty_content") > 0).alias("has_dirty"))


def accounts(table: DataFrame, enabled_only: bool = True) -> DataFrame:
    return (table.filter("enabled = 1") if enabled_only else table).select("id", "enabled", "assignment_count")


def not_judged(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates without a verdict yet."""
    return candidates.join(done.select("id"), "id", "left_anti")


def keyword_hits(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """How many articles each keyword of a list finds, and how many of them no verdict confirms.

    The list is one row; each article keeps what its text has, and counts are summed by task before they are dealt.
    """
    listed = keywords.agg(F.collect_set("keyword").alias("_keywords"))
    text = F.lower("body_html")
    found = articles.crossJoin(listed).select("belongs", F.explode(F.filter("_keywords", lambda k: F.contains(text, F.lower(k)))).alias("keyword"))
    return found.groupBy("keyword").agg(F.count("*").alias("hits"), F.count_if(~F.coalesce("belongs", F.lit(False))).alias("decoys"))


def backfilled_guard(articles: DataFrame, tabs: DataFrame) -> DataFrame:
    """kind, name and id of the tab that the guard looked at, for articles with a record of it: as recorded; else where
    the article landed unless it moved; else the name in the guard's reason, unless it is where the article went."""
    part = lambda k: F.coalesce(F.get_json_object("quality", f"$.league_guard.{k}"), F.lit(""))
    moved = F.get_json_object("quality", "$.league_guard.reassigned_tab_id").isNotNull() & (part("fallback_tab_name") != "")
    said = F.regexp_extract(part("reason"), REJECTED_TAB, 1)
    found = F.when(part("guard_tab_name") != "", part("guard_tab_name")).when(~moved, part("tab_name")).when(said != part("fallback_tab_name"), said).otherwise("")
    kind = F.when(part("guard_tab_name") != "", "recorded").when(found == "", "unknown").when(~moved, "landed").otherwise("parsed")
    known = articles.filter(F.get_json_object("quality", "$.league_guard").isNotNull()).select("id", kind.alias("kind"), F.nullif(found, F.lit("")).alias("guard_tab"))
    ids = tabs.groupBy(F.col("name").alias("guard_tab")).agg(F.min("id").alias("guard_tab_id"))
    return known.join(ids, "guard_tab", "left").select("id", "kind", "guard_tab", "guard_tab_id")


def whitelist(tags: DataFrame, names: DataFrame, tabs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tab_id, channel_id) for competitions that have a tab of their name, and the names without one."""
    matched = names.join(tabs.select(F.col("id").alias("tab_id"), F.col("name").alias("competition_name")), "competition_name", "left")
    lists = tags.join(matched.filter("tab_id is not null").select("competition_id", "tab_id"), "competition_id").select("tab_id", "channel_id").distinct()
    return lists, matched.filter("tab_id is null").select("competition_id", "competition_name")
