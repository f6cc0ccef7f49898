"""Publication: modes, accounts, dispositions, guards and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def publish_modes(articles: DataFrame, article_tabs: DataFrame, tabs: DataFrame, sources: DataFrame, rules: DataFrame, excluded: tuple[int, ...] = (0,)) -> DataFrame:
    """id, publish_mode, configured_mode, conflict: the rule's override, else the source's, else what all active tabs
    agree on; a mode that was decided before (``decided_mode``, where ``articles`` has it) stays the article's.

    Disabled tabs have no vote, but turn direct publication into a draft; without any tab the mode is 0.
    ``articles`` has id, source and route_rule_id.
    """
    if "decided_mode" not in articles.columns:
        articles = articles.withColumn("decided_mode", F.lit(None).cast("int"))
    usable = tabs.filter(F.col("backend_tab_id").isNotNull() & ~F.col("backend_tab_id").isin(*excluded)).select(F.col("id").alias("tab_id"), "enabled", F.col("publish_mode").alias("mode"))
    votes = article_tabs.join(usable, "tab_id").groupBy(F.col("article_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("enabled") == 1, F.col("mode")))).alias("modes"), F.bool_or(F.col("enabled") == 0).alias("disabled")
    )
    bound = rules.filter("enabled = 1 and tab_id is not null").select(F.col("id").alias("route_rule_id"), F.col("publish_mode_override").alias("rule_mode"))
    own = sources.select(F.col("code").alias("source"), F.col("publish_mode_override").alias("source_mode"))
    joined = articles.join(votes, "id", "left").join(bound, "route_rule_id", "left").join(own, "source", "left")
    modes = F.coalesce("modes", F.array().cast("array<int>"))
    unanimous = F.when(F.size(modes) == 0, 0).when(F.size(modes) == 1, F.get(modes, 0))
    mode = F.coalesce("rule_mode", "source_mode", unanimous)
    mode = F.when((mode == 1) & F.coalesce("disabled", F.lit(False)), 0).otherwise(mode)
    open_ = F.col("decided_mode").isNull() & F.col("rule_mode").isNull() & F.col("source_mode").isNull()
    return joined.select("id", F.coalesce("decided_mode", mode).cast("int").alias("publish_mode"), mode.cast("int").alias("configured_mode"), ((F.size(modes) > 1) & open_).alias("conflict"))


def assigned_accounts(articles: DataFrame, accounts: DataFrame) -> DataFrame:
    """id and account: articles in order of id, each to the enabled account with the fewest assignments so far.

    Water filling in closed form: between two neighbouring counts of accounts the same accounts take turns, so a
    segment begins at a known place, and the place in it gives the turn. Segments and turns depend on the accounts
    alone; places of articles come from the counts of id blocks and small windows in them. Without an enabled account
    no article has one.
    """
    live = accounts.filter("enabled = 1").select(F.col("id").alias("account_id"), F.col("assignment_count").cast("bigint").alias("n"))
    block = F.floor(F.col("id") / 4096)
    counts = articles.groupBy(block.alias("block")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = articles.select("id", block.alias("block")).join(counts.withColumn("before", before), "block")
    placed = placed.select("id", (F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("id")) - 1).alias("place"))
    levels = live.groupBy(F.col("n").alias("level")).agg(F.count("*").alias("own"))
    upto = W.orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    steps = levels.withColumn("turns", F.sum("own").over(upto)).withColumn("up", F.lead("level").over(W.orderBy("level")) - F.col("level"))
    begin = F.coalesce(F.sum(F.col("turns") * F.col("up")).over(W.orderBy("level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    segments = steps.select("level", "turns", begin.alias("begin"))
    turn = F.row_number().over(W.partitionBy("level").orderBy("account_id")) - 1
    takers = segments.join(live, F.col("n") <= F.col("level")).select("level", "account_id").withColumn("turn", turn.cast("bigint"))
    table = segments.agg(F.array_sort(F.collect_list(F.struct("begin", "level", "turns"))).alias("segments"))  # one row
    at = placed.crossJoin(table).select("id", "place", F.element_at(F.filter("segments", lambda x: x["begin"] <= F.col("place")), -1).alias("s"))
    asked = at.select("id", F.col("s.level").alias("level"), F.pmod(F.col("place") - F.col("s.begin"), F.col("s.turns")).alias("turn"))
    return asked.join(takers, ["level", "turn"]).select("id", "account_id")


def dispositions(queued: DataFrame) -> DataFrame:
    """What happens to each queued article, by the first that holds: abandon, duplicates, review, no tab, submit."""
    to = (
        F.when(F.col("publish_mode") == 2, "ABANDONED").when(F.col("source_duplicate"), "SOURCE_DUPLICATE").when(F.col("title_outcome") == "duplicate", "TITLE_DUPLICATE")
        .when(F.col("title_outcome") == "needs_review", "NEEDS_REVIEW").when(F.size("usable_tabs") == 0, "MAPPING_BLOCKED").otherwise("PUBLISHING")
    )
    return queued.select("id", to.alias("to_status"), F.when(to == "MAPPING_BLOCKED", F.array_join(F.array_distinct("dropped_names"), "、")).alias("message"))


def language_guarded(modes: DataFrame, ratios: DataFrame, most: float = 0.60) -> DataFrame:
    """Direct publication becomes a draft where the share of other letters passes the limit."""
    joined = modes.join(ratios, "id")
    down = (F.col("configured_mode") == 1) & (F.col("other_ratio") > most)
    return joined.select("id", F.when(down, 0).otherwise(F.col("configured_mode")).alias("effective_mode"), F.coalesce(down, F.lit(False)).alias("downgraded"))


def reviewed(articles: DataFrame, decisions: DataFrame) -> DataFrame:
    """State after review decisions: they count for articles in review alone."""
    good = F.col("action").isin("pass", "approve", "manual_fix")
    open_ = F.col("status") == "NEEDS_REVIEW"
    to = F.when(open_ & good, F.when(F.coalesce("upstream_archive_id", F.lit(0)) > 0, "ALREADY_PUBLISHED").otherwise("READY_TO_PUBLISH")).when(open_ & (F.col("action") == "reject"), "REJECTED")
    joined = articles.join(decisions, "id")
    return joined.select("id", "action", F.coalesce(to, F.col("status")).alias("status"), to.isNull().alias("refused"))


def outbox(articles: DataFrame, article_tabs: DataFrame, tabs: DataFrame, excluded: tuple[int, ...] = (0,)) -> DataFrame:
    """The fields to post, and why an article can't be: title, body, distinct backend tabs, channels by commas."""
    names = tabs.select(F.col("id").alias("tab_id"), "backend_tab_id").filter(F.col("backend_tab_id").isNotNull() & ~F.col("backend_tab_id").isin(*excluded))
    per = article_tabs.join(names, "tab_id").groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("backend_tab_id")).alias("t"))
    reason = F.when(F.trim("title_final") == "", "no title").when(F.trim("body_html") == "", "no body").when(F.col("t").isNull(), "no tab")
    return articles.join(per, "id", "left").select("id", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("tabs"), F.array_join(F.transform(F.array_distinct("channels"), lambda x: x.cast("string")), ",").alias("channel_list"), reason.alias("reject_reason"))


def fallback_tabs(candidates: DataFrame, verdicts: DataFrame, least: float = 0.9) -> DataFrame:
    """The first candidate tab (by place) that a verdict confirms: candidates (id, tab_ids), verdicts (id, tab_id, belongs, confidence)."""
    rows = candidates.select("id", F.posexplode(F.array_distinct("tab_ids")).alias("pos", "tab_id"))
    good = verdicts.filter(F.col("belongs") & (F.col("confidence") >= least)).select("id", "tab_id")
    return rows.join(good, ["id", "tab_id"]).groupBy("id").agg(F.min_by("tab_id", "pos").alias("tab_id"))


def reassigned(articles_tabs: DataFrame, targets: DataFrame, generic: int) -> DataFrame:
    """Tabs of each article after reassignment: the generic tab if it had it, and the target."""
    kept = articles_tabs.groupBy(F.col("article_id").alias("id")).agg(F.bool_or(F.col("tab_id") == generic).alias("has"))
    return targets.join(kept, "id", "left").select("id", F.when(F.coalesce("has", F.lit(False)), F.array_union(F.array(F.lit(generic).cast("bigint")), F.array("target"))).otherwise(F.array("target")).alias("tab_ids"))
