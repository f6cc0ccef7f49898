"""Guards from verdict tables, due confirmations, and the scope of repairs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..schemas import ISSUES

#: Issues that a repair of the body can't mend.
OTHER_ISSUES = tuple(k for k in ISSUES if k not in ("dirty_content", "semantic_problems"))


def guard_asks(articles: DataFrame, article_tabs: DataFrame, tabs: DataFrame, rules: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """id, configured_mode, in_scope, tab_id of the articles to ask about, and the tab to ask for.

    Drafts are asked about where no marker routed them, or where the rule that did asks for it; articles of a league
    in ``scope`` ("all": any) always, published directly or not. The tab is the article's first that has the guard
    on, for those in scope else the first with a definition; without one nothing is asked.
    articles: id, configured_mode, route_league, route_rule_id. rules: id, ai_guard_enabled.
    """
    league = F.lower(F.trim(F.coalesce("route_league", F.lit(""))))
    inside = F.lit("all" in scope) | ((league != "") & league.isin(*scope))
    opted = rules.filter("ai_guard_enabled = 1").select(F.col("id").alias("route_rule_id"), F.lit(True).alias("opted"))
    known = tabs.select(F.col("id").alias("tab_id"), (F.col("guard_enabled") == 1).alias("on"), (F.trim(F.coalesce("definition", F.lit(""))) != "").alias("told"))
    place = F.struct("sort_order", "tab_id")
    first = article_tabs.join(known, "tab_id").groupBy(F.col("article_id").alias("id")).agg(
        F.min_by("tab_id", F.when(F.col("on"), place)).alias("guarded"), F.min_by("tab_id", F.when(F.col("told"), place)).alias("defined")
    )
    rows = articles.withColumn("in_scope", inside).join(opted, "route_rule_id", "left").join(first, "id")
    asked = rows.filter(((F.col("configured_mode") == 0) | F.col("in_scope")) & ((league == "") | F.coalesce("opted", F.lit(False)) | F.col("in_scope")))
    return asked.select("id", "configured_mode", "in_scope", F.coalesce("guarded", F.when(F.col("in_scope"), F.col("defined"))).alias("tab_id")).filter("tab_id is not null")


def league_guard(asked: DataFrame, verdicts: DataFrame, choices: DataFrame, tabs: DataFrame, least: float = 0.9, always_direct: bool = False, upgrade: bool = True) -> DataFrame:
    """id, outcome, effective_mode, final_tab and the record of what the guard makes of the articles of ``guard_asks``.

    verdicts: id, belongs, confidence, for the article's tab. choices: id, tab_id (null: none of all tabs), confidence.
    A sure confirmation upgrades a draft (with ``upgrade``); a draft that belongs, but not surely, stays one. Else the
    choice counts: another tab takes the article over if it is sure, in its own mode or always directly; none at all,
    surely, takes direct publication away. A disabled tab gives a draft; without answers nothing changes.
    """
    own = tabs.select(F.col("id").alias("tab_id"), (F.col("enabled") == 1).alias("active"))
    other = tabs.select(F.col("id").alias("new_tab"), (F.col("enabled") == 1).alias("new_active"), F.col("publish_mode").alias("new_mode"))
    chosen = choices.select("id", F.col("tab_id").alias("new_tab"), F.col("confidence").alias("choice_confidence"))
    joined = asked.join(verdicts, "id", "left").join(chosen, "id", "left").join(own, "tab_id", "left").join(other, "new_tab", "left")
    belongs, draft = F.coalesce("belongs", F.lit(False)), F.col("configured_mode") == 0
    sure, chose = F.coalesce(F.col("confidence") >= least, F.lit(False)), F.coalesce(F.col("choice_confidence") >= least, F.lit(False))
    outcome = (
        F.when(F.col("belongs").isNull(), "unchecked").when(belongs & sure, F.when(draft & F.lit(upgrade), "upgraded").otherwise("kept")).when((belongs & draft) | ~chose, "kept")
        .when(F.col("new_active").isNull(), F.when(draft, "kept").otherwise("downgraded")).when(F.col("new_tab") == F.col("tab_id"), "kept").otherwise("reassigned")
    )
    mode = (
        F.when(outcome == "upgraded", F.when(F.col("active"), 1).otherwise(0))
        .when(outcome == "reassigned", F.when(~F.col("new_active"), 0).when(F.lit(always_direct), 1).otherwise(F.coalesce("new_mode", F.lit(0))))
        .when(outcome == "downgraded", 0).otherwise(F.col("configured_mode"))
    ).cast("int")
    moved = outcome == "reassigned"
    final = F.when(moved, F.col("new_tab")).otherwise(F.col("tab_id"))
    record = F.struct(
        final.alias("tab_id"), F.col("tab_id").alias("guard_tab_id"), F.col("configured_mode").alias("configured_publish_mode"), mode.alias("effective_publish_mode"),
        ((mode == 1) & draft).alias("upgraded_to_publish"), ((outcome == "downgraded") & (mode == 0)).alias("downgraded_from_direct"),
        F.when(moved, F.col("new_tab")).alias("reassigned_tab_id"), F.when(moved, F.col("new_active")).alias("reassigned_tab_active"),
        F.col("choice_confidence").isNotNull().alias("classifier_used"), F.lit(least).alias("min_confidence"),
    )
    return joined.select("id", outcome.alias("outcome"), mode.alias("effective_mode"), final.alias("final_tab"), record.alias("league_guard"))


def due_confirmations(articles: DataFrame, now: datetime, lease: int = 300, limit: int = 100) -> DataFrame:
    """Confirmations whose time has come, unclaimed or with a claim that ran out; the longest due first.

    articles: id, status, backend_archive_id, next_at, claimed_at, uncertain_since, updated_at.
    """
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") <= F.lit(now) - F.expr(f"INTERVAL {lease} SECONDS"))
    due = articles.filter((F.col("status") == "DRAFT_CONFIRMING") & (F.coalesce("backend_archive_id", F.lit(0)) == 0) & (F.col("next_at") <= F.lit(now)) & free)
    return due.orderBy("next_at", F.col("uncertain_since").asc_nulls_first(), F.col("updated_at").asc_nulls_first(), "id").limit(max(1, min(limit, 1000)))


def repair_scope(records: DataFrame, issues: str = "issues") -> DataFrame:
    """dirty_only and plannable of each record; a missing list isn't an empty one for the former."""
    get = lambda k: F.col(issues)[k]
    empty = lambda k: F.coalesce(F.size(get(k)) == 0, F.lit(False))
    some = lambda k: F.coalesce(F.size(get(k)) > 0, F.lit(False))
    dirty_only, clean = some("dirty_content") & empty("semantic_problems"), F.lit(True)
    for k in OTHER_ISSUES:
        dirty_only, clean = dirty_only & empty(k), clean & ~some(k)
    return records.withColumns({"dirty_only": dirty_only, "plannable": clean & (some("dirty_content") | some("semantic_problems"))})


def bounded_context(blocks: DataFrame, key: str, head: int = 40, tail: int = 20) -> DataFrame:
    """The first and the last blocks of each document; all of one that has no more than both together."""
    last = blocks.groupBy(key).agg(F.max("pos").alias("last"))
    joined = blocks.join(last, key)
    return joined.filter((F.col("last") < head + tail) | (F.col("pos") < head) | (F.col("pos") > F.col("last") - tail)).drop("last")
