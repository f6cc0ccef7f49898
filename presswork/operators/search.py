"""Selections over articles, events, rules and ledgers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.quality import NO_COMPETITION
from ..schemas import ISSUES

#: The tab that every article keeps. Fixed value.
GENERIC_TAB = 58


def article_search(articles: DataFrame, article_tabs: DataFrame, *, status=None, source=None, tab_id=None, query=None, limit=50, offset=0) -> DataFrame:
    """A page of articles, newest first; the query is a literal substring of title, URL or source, ASCII case folded."""
    found = articles
    for column, value in (("status", status), ("source", source)):
        found = found.filter(F.col(column) == value) if value is not None else found
    if query:
        low = F.lit(query.lower())
        found = found.filter(F.contains(F.lower("title_final"), low) | F.contains(F.lower("source_url"), low) | F.contains(F.lower("source"), low))
    if tab_id is not None:
        found = found.join(article_tabs.filter(F.col("tab_id") == tab_id).select(F.col("article_id").alias("id")), "id", "left_semi")
    return found.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(max(1, min(limit, 500)))


def flag(path: str, column: str = "quality") -> Column:
    return F.get_json_object(column, f"$.{path}")


def flagged(articles: DataFrame) -> DataFrame:
    """Articles by JSON flags: regionally sensitive, or reassigned to an inactive tab (false, not missing)."""
    return articles.select("id", (flag("regional_sensitive") == "true").alias("sensitive"), F.coalesce(flag("league_guard.reassigned_tab_active") == "false", F.lit(False)).alias("reassigned_inactive")).filter("sensitive or reassigned_inactive")


def recent_failures(articles: DataFrame, since: datetime, limit: int = 200) -> DataFrame:
    failed = articles.filter((F.col("status") == "PUBLISH_FAILED") & (F.col("updated_at") >= F.lit(since)))
    return failed.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def dedup_pool(articles: DataFrame, since: datetime) -> DataFrame:
    """Published in the window by publication, in flight by creation."""
    published = (F.col("status") == "PUBLISHED") & (F.col("published_at") >= F.lit(since))
    flying = F.col("status").isin("READY_TO_PUBLISH", "PUBLISHING", "DRAFT_CONFIRMING", "DRAFT_CREATED") & (F.col("created_at") >= F.lit(since))
    return articles.filter(published | flying)


def stale_in_flight(articles: DataFrame, now: datetime, seconds: int = 600, status: str = "PUBLISHING") -> DataFrame:
    """What becomes of articles that are in flight too long."""
    old = articles.filter((F.col("status") == status) & (F.col("updated_at").isNull() | (F.col("updated_at") <= F.lit(now) - F.expr(f"INTERVAL {seconds} SECONDS"))))
    to = F.when(F.coalesce("backend_archive_id", F.lit(0)) > 0, F.when(F.col("publish_mode") == 1, "PUBLISHED").otherwise("DRAFT_CREATED")).otherwise("PUBLISH_FAILED")
    return old.select("id", to.alias("to_status"), (to == "PUBLISH_FAILED").alias("needs_reconcile"))


def orphans(articles: DataFrame, batch: DataFrame, now: datetime, status: str = "RECEIVED", seconds: int = 600, limit: int = 200) -> DataFrame:
    """The newest articles that were received, have been idle for a while, and aren't in the batch."""
    idle = articles.filter((F.col("status") == status) & (F.col("updated_at") <= F.lit(now) - F.expr(f"INTERVAL {seconds} SECONDS")))
    return idle.join(batch.select("id"), "id", "left_anti").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def rechecks(articles: DataFrame, events: DataFrame, reasons: list[str], before: datetime, most: int = 2, limit: int = 100, attempt: str = "error") -> DataFrame:
    """Reviews that failed for a passing reason, idle, and tried fewer than ``most`` times; oldest first."""
    tried = events.filter(F.col("event_type") == attempt).groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("attempts"))
    passing = F.exists(F.array(*map(F.lit, reasons)), lambda r: F.contains(F.coalesce(flag("reason"), F.lit("")), r))
    open_ = articles.filter((F.col("status") == "NEEDS_REVIEW") & F.col("error").isNull() & passing & (F.col("updated_at") <= F.lit(before)))
    found = open_.join(tried, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).filter(F.col("attempts") < most)
    return found.orderBy("updated_at", "id").limit(limit)


def rule_listing(rules: DataFrame, tabs: DataFrame, sources: DataFrame, *, marker_type: str | None = None, pending_only: bool = False, search: str | None = None, source_code: str | None = "*") -> DataFrame:
    """Rules with their tab and source, those without a tab first. ``source_code`` "*" is any scope, null the global
    one; the search is a literal text (100 characters of it, case folded) in any of five columns."""
    joined = rules.join(tabs.select(F.col("id").alias("tab_id"), F.col("name").alias("tab_name")), "tab_id", "left")
    joined = joined.join(sources.select(F.col("code").alias("source_code"), F.col("display_name").alias("source_name")), "source_code", "left")
    if "sample_source" not in joined.columns:
        joined = joined.withColumn("sample_source", F.lit(None).cast("string"))
    found = joined.filter(F.col("marker_type") == marker_type) if marker_type else joined
    found = found.filter("tab_id is null") if pending_only else found
    found = found.filter(F.col("source_code").eqNullSafe(F.lit(source_code))) if source_code != "*" else found
    text = (search or "").strip()[:100].lower()
    if text:
        columns = ("marker_code", "tab_name", "sample_source", "source_code", "source_name")
        found = found.filter(F.exists(F.array(*columns), lambda x: F.coalesce(F.contains(F.lower(x), F.lit(text)), F.lit(False))))
    w = W.orderBy(F.col("tab_id").isNotNull(), "marker_type", "marker_code", F.col("source_code").isNotNull(), "source_code", "id")  # rules are a small table
    return found.select("id", "marker_type", "marker_code", "source_code", "tab_name", F.col("tab_id").isNull().alias("pending"), F.row_number().over(w).alias("place"))


def tab_predicates(tabs: DataFrame, excluded: tuple[int, ...] = (0,)) -> DataFrame:
    """publishable: its backend id is a number that isn't excluded; active: switched on; guard_candidate: it has a
    definition and is neither generic nor excluded, switched on or not."""
    backend = F.col("backend_tab_id").try_cast("bigint")
    defined = F.trim(F.coalesce("definition", F.lit(""))) != ""
    none = F.lit(False)
    return tabs.select("id", F.coalesce(~backend.isin(*excluded), none).alias("publishable"), F.coalesce(F.col("enabled") == 1, none).alias("active"), F.coalesce(defined & ~backend.isin(GENERIC_TAB, *excluded), none).alias("guard_candidate"))


def source_listing(sources: DataFrame, articles: DataFrame, tab_id: int) -> DataFrame:
    """Enabled sources with an article in a tab, by name without case."""
    used = articles.filter(F.col("tab_id") == tab_id).select(F.col("source").alias("code"))
    w = W.orderBy(F.lower("display_name"), "code")
    return sources.filter("enabled = 1").join(used, "code", "left_semi").select("code", "display_name", F.row_number().over(w).alias("place"))


def guard_outcome(articles: DataFrame) -> DataFrame:
    """The state of the league guard for each article, and the competition to show.

    What the guard wished for counts as applied only where the article was published so. The competition is blank
    where the article moved to another tab, where it is none, or where it has the name of the tab that was looked at.
    """
    guard = lambda k: flag(f"league_guard.{k}")
    text = lambda k: F.coalesce(guard(k), F.lit(""))
    moved = guard("reassigned_tab_id").isNotNull() & (text("fallback_tab_name") != "")
    direct = F.when(F.coalesce(F.col("publish_mode") == 1, F.lit(False)), "upgraded").otherwise("stale")
    wished, less = guard("effective_publish_mode") == "1", F.coalesce(guard("downgraded_from_direct") == "true", F.lit(False))
    state = (
        F.when(flag("league_guard").isNull(), "none").when(~moved & less, "downgraded").when(wished, direct)
        .when(moved & (guard("reassigned_tab_active") == "false"), "reassigned_inactive").otherwise("kept")
    )
    looked = F.when((text("guard_tab_name") == "") & ~moved, text("tab_name")).otherwise(text("guard_tab_name"))
    competition = F.trim(text("actual_competition"))
    shown = F.when(moved | (competition == NO_COMPETITION) | (competition == looked), "").otherwise(competition)
    return articles.select("id", state.alias("guard_state"), shown.alias("competition"))


def strictly_passing(articles: DataFrame) -> DataFrame:
    """Articles whose quality record passes without reservations: ``pass`` is the boolean true and ``needs_review`` the
    boolean false, a decision is clean, there are neither plans nor an error of one, and the issues are the five lists,
    all empty. What is missing or of another type doesn't pass."""
    record = F.try_parse_json("quality")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant"))
    is_ = lambda path, value: (kind(path) == "BOOLEAN") & (flag(path) == value)
    lists = F.from_json(flag("issues"), "map<string,string>")
    empty = F.forall(F.map_values(lists), lambda x: F.coalesce(x.rlike(r"^\[\s*\]$"), F.lit(False)))
    decided = flag("decision").isNull() | (flag("decision") == "clean")
    unplanned = F.coalesce(flag("repair_plans").isin("[]", "null", ""), F.lit(True)) & (F.coalesce(flag("repair_plan_error"), F.lit("")) == "")
    good = is_("pass", "true") & is_("needs_review", "false") & decided & unplanned & (F.array_sort(F.map_keys(lists)) == F.array(*map(F.lit, sorted(ISSUES)))) & empty
    return articles.filter(F.coalesce(good, F.lit(False))).select("id")


def retryable(articles: DataFrame, match: str, limit: int | None = None) -> DataFrame:
    """Failed articles that never got an archive, whose error has the text (ASCII case folded), in order of id."""
    found = articles.filter((F.col("status") == "PUBLISH_FAILED") & F.contains(F.lower("error"), F.lit(match.lower())) & (F.coalesce("backend_archive_id", F.lit(0)) == 0)).orderBy("id")
    return found.limit(limit) if limit else found


def reasoned(articles: DataFrame, match: str, since: datetime) -> DataFrame:
    """Articles in review since a time whose record's reason has the text."""
    return articles.filter((F.col("status") == "NEEDS_REVIEW") & (F.col("updated_at") >= F.lit(since)) & F.contains(F.coalesce(flag("reason"), F.lit("")), F.lit(match))).orderBy("id")


def recent_runs(runs: DataFrame, at: str = "created_at", limit: int = 30) -> DataFrame:
    """The newest rows of a run log; at least one, at most 200."""
    return runs.orderBy(F.desc(at), F.desc("id")).limit(max(1, min(limit, 200)))


def newest_first(runs: DataFrame, key: str, at: str) -> DataFrame:
    """Each key's last run, with its place among all: newest first."""
    last = ledger_latest(runs, key, at)
    return last.withColumn("place", F.row_number().over(W.orderBy(F.desc(at), key)))  # a row for each key of the ledger


def latest_event(events: DataFrame) -> DataFrame:
    """The last event of each article, and whether it needs manual reconciliation."""
    last = events.groupBy("article_id").agg(F.max_by(F.struct("id", "to_status"), F.struct("created_at", "id")).alias("e"), F.max("created_at").alias("created_at"))
    return last.select("article_id", F.col("e.id").alias("event_id"), "created_at", F.col("e.to_status").alias("status"), (F.col("e.to_status") == "PUBLISH_FAILED").alias("needs_reconcile"))


def timeline(events: DataFrame) -> DataFrame:
    """Every event with its place, the status before it and the seconds that lasted."""
    w = W.partitionBy("article_id").orderBy("created_at", "id")
    return events.select("article_id", "id", F.row_number().over(w).alias("place"), F.lag("to_status").over(w).alias("from_status"), "to_status", F.timestamp_diff("SECOND", F.lag("created_at").over(w), F.col("created_at")).alias("seconds"))


def ledger_latest(runs: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of every key of an append-only ledger."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(key, "r.*")
