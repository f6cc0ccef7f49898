"""Reporting operators: periods, counts, comparisons, rankings and matrices.

Every operator takes and gives DataFrames; times are UTC, local days and boundaries those of Asia/Shanghai.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.quality import NO_COMPETITION
from ..schemas import STATUSES

ZONE = "Asia/Shanghai"
#: Thresholds of a day's period. Fixed values.
STOPPED_LEAST, DROP_LEAST, DAY_HOURS = 10, 5, 24.0


def periods(spark: SparkSession, first: date, last: date, boundaries: tuple[str, ...]) -> DataFrame:
    """Half-open periods (start, end) between neighbouring local boundaries of the days; malformed ones are left out."""
    good = []
    for b in boundaries:
        hour, _, minute = b.strip().partition(":")
        if hour.isdigit() and minute.isdigit() and int(hour) < 24 and int(minute) < 60:
            good.append(int(hour) * 60 + int(minute))
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    moments = days.select(F.explode(F.array(*map(F.lit, sorted(set(good))))).alias("m"), "day") if good else days.select(F.lit(0).alias("m"), "day").limit(0)
    local = F.to_timestamp_ntz(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" "), F.format_string("%02d:%02d:00", F.floor(F.col("m") / 60).cast("int"), (F.col("m") % 60).cast("int"))))
    utc = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), local).alias("period_start")
    ends = moments.select(utc)
    # a row for each boundary of the asked days: small, however large the facts are
    return ends.withColumn("period_end", F.lead("period_start").over(W.orderBy("period_start"))).filter("period_end is not null")


def in_periods(rows: DataFrame, at: str, spans: DataFrame) -> DataFrame:
    """The rows with the periods that their time falls in: an equi-join on the UTC day, then the bounds."""
    days = spans.withColumn("_day", F.explode(F.sequence(F.to_date("period_start"), F.to_date("period_end"))))
    found = rows.withColumn("_day", F.to_date(at)).join(days, "_day").drop("_day")
    return found.filter((F.col(at) >= F.col("period_start")) & (F.col(at) < F.col("period_end")))


def hours(start: str = "period_start", end: str = "period_end") -> Column:
    return F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 3600.0


def status_counts(articles: DataFrame) -> DataFrame:
    """status, n for every status, zero or not, and TOTAL over all rows."""
    spark = articles.sparkSession
    dim = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = articles.groupBy("status").agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("TOTAL").alias("status"), "n")
    return dim.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n")).unionByName(total)


def period_stats(articles: DataFrame, sources: DataFrame, spans: DataFrame) -> DataFrame:
    """Counts of each enabled source in each period, sources without articles included.

    Articles go to their period by a join on the few periods and are counted before the sources are joined.
    """
    inside = in_periods(articles, "created_at", spans)
    of = lambda status: F.count_if(F.col("status") == status)
    counted = inside.groupBy("period_start", "period_end", "source").agg(
        F.count("*").alias("total_count"), of("PUBLISHED").alias("published_count"), of("DRAFT_CREATED").alias("draft_count"),
        of("NEEDS_REVIEW").alias("review_count"), of("ABANDONED").alias("abandoned_count"), F.count("duplicate_of_article_id").alias("duplicate_count"),
    )
    every = sources.filter("enabled = 1").crossJoin(spans).select("period_start", "period_end", F.col("code").alias("source"), "display_name")
    joined = every.join(counted, ["period_start", "period_end", "source"], "left")
    counts = [c for c in counted.columns if c.endswith("_count")]
    return joined.select("period_start", "period_end", F.col("source").alias("source_code"), F.col("display_name").alias("source_name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def scaled(base: int, period_hours: Column) -> Column:
    """A day's threshold for a shorter period, at least 1, rounded half to even."""
    whole = (period_hours <= 0) | (period_hours >= DAY_HOURS)
    return F.when(whole, F.lit(max(1, base))).otherwise(F.greatest(F.lit(1), F.bround(F.lit(base) * period_hours / DAY_HOURS, 0).cast("int"))).cast("int")


def change_type(now: Column, before: Column) -> Column:
    rate = (now - before) / before
    moved = (
        F.when(rate > 1.0, "surge").when(rate < -0.8, "critical_drop").when(rate < -0.5, "drop").when(F.abs(rate) < 0.1, "stable").otherwise("normal")
    )
    return F.when(before == 0, F.when(now > 0, "new").otherwise("neutral")).otherwise(moved)


def compared(stats: DataFrame) -> DataFrame:
    """Each period's stats against those that end 24 hours earlier: baseline, change and anomaly level.

    A period without any baseline is no_baseline, a source without one is new.
    """
    earlier = stats.select(
        F.col("source_code"), (F.col("period_end") + F.expr("INTERVAL 1 DAY")).alias("period_end"), F.col("total_count").alias("baseline_count")
    )
    has = earlier.select("period_end").distinct().withColumn("has_baseline", F.lit(True))
    joined = stats.join(earlier, ["source_code", "period_end"], "left").join(has, "period_end", "left")
    now, before = F.col("total_count"), F.col("baseline_count")
    kind = F.when(F.col("has_baseline").isNull(), "no_baseline").when(before.isNull(), "new").otherwise(change_type(now, before))
    joined = joined.withColumn("change", kind).withColumn("rate", F.when(before > 0, (now - before) / before))
    was, h = F.coalesce(before, F.lit(0)), hours()
    stopped, least = scaled(STOPPED_LEAST, h), scaled(DROP_LEAST, h)
    level = (
        F.when((now == 0) & (was >= stopped), "critical").when((was >= stopped) & (now > 0) & (kind == "critical_drop"), "critical")
        .when((was >= least) & (kind == "drop"), "warning").when((was >= least) & (kind == "surge"), "info")
        .when((kind == "new") & (now > 0), "info").otherwise("normal")
    )
    return joined.select("period_start", "period_end", "source_code", "total_count", F.coalesce("baseline_count", F.lit(0)).alias("baseline_count"), "change", "rate", level.alias("level"))


def period_summary(stats: DataFrame) -> DataFrame:
    """A row for each period: totals, what waits, shares in per cent, and the total's change against a day before."""
    now = stats.groupBy("period_start", "period_end").agg(
        F.sum("total_count").alias("total"), F.sum("published_count").alias("published"), F.sum(F.col("draft_count") + F.col("review_count")).alias("pending"), F.count("*").alias("active_sources")
    )
    before = now.select((F.col("period_end") + F.expr("INTERVAL 1 DAY")).alias("period_end"), F.col("total").alias("before"))
    share = lambda x: F.when(F.col("total") > 0, F.bround(F.col(x) / F.col("total") * 100, 0)).otherwise(0.0).alias(f"{x}_rate")
    change = F.when(F.col("before") > 0, F.bround((F.col("total") - F.col("before")) / F.col("before") * 100, 0)).alias("change_rate")
    return now.join(before, "period_end", "left").select("period_start", "period_end", "total", "published", "pending", "active_sources", share("published"), share("pending"), change)


def published_tabs(articles: DataFrame, article_tabs: DataFrame, tabs: DataFrame, tracked: list[str] | None = None, excluded: tuple[int, ...] = (0,)) -> DataFrame:
    """(id, published_at, tab) of direct publications, once for each of their tracked tabs.

    Names are those kept at publication (``published_tab_names``, where ``articles`` has it), else those of the
    publishable tabs, else that of the article's own tab.
    """
    direct = articles.filter((F.col("status") == "PUBLISHED") & (F.col("publish_mode") == 1))
    names = tabs.select(F.col("id").alias("tab_id"), "backend_tab_id", F.trim("name").alias("tab"))
    usable = names.filter(F.col("backend_tab_id").isNotNull() & ~F.col("backend_tab_id").isin(*excluded) & (F.col("tab") != ""))
    pairs = article_tabs.select(F.col("article_id").alias("id"), "tab_id").join(usable, "tab_id").groupBy("id").agg(F.collect_set("tab").alias("tabs_now"))
    kept = F.col("published_tab_names") if "published_tab_names" in articles.columns else F.lit(None).cast("array<string>")
    rows = direct.select("id", "published_at", "tab_id", kept.alias("tabs_then")).join(pairs, "id", "left").join(names.select("tab_id", F.col("tab").alias("own")), "tab_id", "left")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    chosen = F.coalesce(some("tabs_then"), some("tabs_now"), F.array("own"))
    each = rows.select("id", "published_at", F.explode(F.array_distinct(F.transform(chosen, lambda x: F.trim(x)))).alias("tab")).filter("tab <> ''")
    return each.filter(F.col("tab").isin(tracked)) if tracked else each


def publish_report(pairs: DataFrame, spans: DataFrame, tracked: list[str] | None = None) -> DataFrame:
    """Direct publications of each tab and period, and in the row TOTAL the distinct articles; with ``tracked`` every
    one of these tabs has a row for each period, zero where nothing was published."""
    inside = in_periods(pairs, "published_at", spans)
    by = ["period_start", "period_end"]
    each = inside.groupBy(*by, "tab").agg(F.count("*").alias("n"))
    total = inside.select(*by, "id").distinct().groupBy(*by).agg(F.count("*").alias("n")).withColumn("tab", F.lit("TOTAL"))
    found = each.unionByName(total)
    if not tracked:
        return found
    grid = spans.select(*by, F.explode(F.array(*map(F.lit, [*tracked, "TOTAL"]))).alias("tab"))
    return grid.join(found, [*by, "tab"], "left").select(*by, "tab", F.coalesce("n", F.lit(0)).alias("n"))


def weekly_matrix(report: DataFrame, tabs: DataFrame, starts: list) -> DataFrame:
    """tab by day: d1..d7 and row_total, zero for tabs without publications; TOTAL has distinct articles."""
    day = {s: f"d{i + 1}" for i, s in enumerate(starts)}
    cells = [F.coalesce(F.sum(F.when(F.col("period_start") == F.lit(s), F.col("n"))), F.lit(0)).alias(c) for s, c in day.items()]
    wide = report.groupBy("tab").agg(*cells)
    names = tabs.select(F.trim("name").alias("tab")).unionByName(report.sparkSession.createDataFrame([("TOTAL",)], "tab string")).distinct()
    filled = names.join(wide, "tab", "left").select("tab", *[F.coalesce(c, F.lit(0)).alias(c) for c in day.values()])
    return filled.withColumn("row_total", sum((F.col(c) for c in day.values()), F.lit(0)))


def click_counts(clicks: DataFrame) -> DataFrame:
    """(stat_date, league_name, switch_cnt) of each UTC day; blank names are left out."""
    named = clicks.filter(F.trim("league_name") != "")
    return named.groupBy(F.to_date("proc_time").alias("stat_date"), "league_name").agg(F.count("*").alias("switch_cnt"))


def click_ranking(counts: DataFrame) -> DataFrame:
    """Sum, days and share in per cent of each league."""
    each = counts.groupBy("league_name").agg(F.sum("switch_cnt").alias("total_cnt"), F.count_distinct("stat_date").alias("days"))
    whole = F.sum("total_cnt").over(W.partitionBy())
    return each.withColumn("share", F.when(whole > 0, F.bround(F.col("total_cnt") * 100.0 / whole, 2)).otherwise(0.0))


def click_days(counts: DataFrame) -> DataFrame:
    return counts.groupBy("stat_date").agg(F.sum("switch_cnt").alias("total_cnt"), F.count("*").alias("leagues"))


def click_grid(counts: DataFrame) -> DataFrame:
    """Every day with every league, zero where there is no count: both sides are small dimensions."""
    days, leagues = counts.select("stat_date").distinct(), counts.select("league_name").distinct()
    grid = days.crossJoin(leagues)
    return grid.join(counts, ["stat_date", "league_name"], "left").select("stat_date", "league_name", F.coalesce("switch_cnt", F.lit(0)).alias("switch_cnt"))


def uncovered(articles: DataFrame) -> DataFrame:
    """Articles with the competition that they are of, where it is one, the article didn't move to another tab, and the
    tab that was looked at is known and has another name."""
    guard = lambda k: F.get_json_object("quality", f"$.league_guard.{k}")
    looked = F.coalesce(F.nullif(guard("guard_tab_name"), F.lit("")), guard("tab_name"))
    named = articles.withColumn("competition", guard("actual_competition"))
    return named.filter(~F.col("competition").isin("", NO_COMPETITION) & guard("reassigned_tab_id").isNull() & (F.col("competition") != looked))


def competition_demand(articles: DataFrame) -> DataFrame:
    """Articles of each competition by day, and over all days where day is null."""
    named = uncovered(articles).select(F.to_date("created_at").alias("day"), "competition")
    return named.groupingSets([["day", "competition"], ["competition"]], "day", "competition").agg(F.count("*").alias("n"))


def uncovered_competitions(articles: DataFrame, tabs: DataFrame) -> DataFrame:
    """Competitions of articles that no tab took: totals, last seen, outcomes, top source, the state of their own tab."""
    named = uncovered(articles)
    of = lambda s: F.count_if(F.col("status") == s)
    per = named.groupBy("competition", "source").agg(
        F.count("*").alias("n"), F.max("created_at").alias("seen"), of("DRAFT_CREATED").alias("drafts"), of("PUBLISHED").alias("published"), of("ABANDONED").alias("abandoned")
    )
    each = per.groupBy("competition").agg(
        F.sum("n").alias("total"), F.max("seen").alias("last_seen"), F.sum("drafts").alias("drafts"), F.sum("published").alias("published"), F.sum("abandoned").alias("abandoned"),
        F.min_by("source", F.struct((-F.col("n")).alias("m"), "source")).alias("top_source"),
    )
    state = F.when(F.col("enabled").isNull(), "missing").when(F.col("enabled") == 0, "disabled").when(F.col("definition") == "", "undefined").otherwise("ready")
    own = tabs.select(F.col("name").alias("competition"), "enabled", "definition")
    return each.join(own, "competition", "left").withColumn("tab_state", state).drop("enabled", "definition")


def error_groups(failures: DataFrame, top: int = 4, alert: int = 3) -> DataFrame:
    """The top groups of failures by the first 60 characters of their error, and whether they raise an alert."""
    each = failures.groupBy(F.substring("error", 1, 60).alias("error_head")).agg(F.count("*").alias("n"), F.min("updated_at").alias("first_seen"))
    return each.withColumn("alert", F.col("n") >= alert).orderBy(F.desc("n"), "first_seen", "error_head").limit(top)


def error_examples(failures: DataFrame, each: int = 3) -> DataFrame:
    """The first failures of every group."""
    w = W.partitionBy("error_head").orderBy("updated_at", "id")
    return failures.withColumn("error_head", F.substring("error", 1, 60)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each).select("error_head", "rn", "id")


def model_agreement(verdicts: DataFrame, reference: DataFrame) -> DataFrame:
    """How two judges agree, and each with the reference; missing verdicts are errors."""
    joined = verdicts.join(reference, "article_id", "left")
    a, b, r = F.col("belongs"), F.col("second"), F.col("reference")
    return joined.agg(
        F.count_if(a == b).alias("agree"), F.count_if(a != b).alias("disagree"), F.count_if(a.isNull() | b.isNull()).alias("errors"),
        F.avg(F.when(r.isNotNull(), (a == r).cast("int"))).alias("accuracy"), F.avg(F.when(r.isNotNull(), (b == r).cast("int"))).alias("second_accuracy"),
    )


def saturday_due(now: Column, hour: int = 19, minute: int = 0) -> Column:
    """The latest Saturday (local) whose boundary has passed."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), now)
    moved = local - F.expr(f"INTERVAL {hour} HOURS {minute} MINUTES")
    return F.date_sub(F.next_day(F.to_date(moved), "SAT"), 7)


def local_label(ts: Column, pattern: str = "MM-dd HH:mm") -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts), pattern)


def missing_periods(reported: DataFrame, spans: DataFrame) -> DataFrame:
    """Periods that the ledger lacks, oldest first to send."""
    return spans.join(reported, ["period_start", "period_end"], "left_anti")


def missing_source_periods(reported: DataFrame, sources: DataFrame, spans: DataFrame) -> DataFrame:
    """source and the periods that its ledger lacks; ``next`` is the oldest, which is sent first."""
    lacking = sources.crossJoin(spans).join(reported, ["source", "period_start", "period_end"], "left_anti")
    nth = F.row_number().over(W.partitionBy("source").orderBy("period_start"))
    return lacking.withColumn("next", nth == 1)


#: States of a report that is still to be sent. Fixed values.
UNSENT = ("PENDING", "FAILED")


def next_periods(ledger: DataFrame, sources: DataFrame, latest: DataFrame) -> DataFrame:
    """source and the period that is sent next, from an append ledger (source, period_start, period_end, status, at).

    A period's state is its last entry. The oldest period that is pending or has failed comes first, if it ends at the
    same time of the day as the latest one (latest: one row of period_start, period_end). Else the day behind the last
    period of the ledger, under the same condition and up to the latest period; else the latest period itself.
    """
    states = ledger.groupBy("source", "period_start", "period_end").agg(F.max_by("status", "at").alias("status"))
    waiting = F.col("status").isin(*UNSENT)
    each = states.groupBy("source").agg(F.min(F.when(waiting, F.struct("period_end", "period_start"))).alias("unsent"), F.max("period_end").alias("before"))
    rows = sources.join(each, "source", "left").crossJoin(latest.select(F.col("period_start").alias("a"), F.col("period_end").alias("b")))  # one row
    clock = lambda c: F.date_format(c, "HH:mm")
    again = F.coalesce(clock("unsent.period_end") == clock("b"), F.lit(False))
    day = F.col("before") + F.expr("INTERVAL 1 DAY")
    follows = F.coalesce((F.col("before") < F.col("b")) & (clock("before") == clock("b")) & (day <= F.col("b")), F.lit(False))
    start = F.when(again, F.col("unsent.period_start")).when(follows, F.col("before")).otherwise(F.col("a"))
    return rows.select("source", start.alias("period_start"), F.when(again, F.col("unsent.period_end")).when(follows, day).otherwise(F.col("b")).alias("period_end"))


def rendered(comparison: DataFrame) -> DataFrame:
    """One text for each period: a line for each anomaly, by level and source."""
    rank = F.when(F.col("level") == "critical", 1).when(F.col("level") == "warning", 2).otherwise(3)
    line = F.concat_ws(" ", F.upper("level"), "source_code", F.concat(F.col("baseline_count").cast("string"), F.lit(" -> "), F.col("total_count").cast("string")))
    rows = comparison.filter("level <> 'normal'").select("period_start", F.struct(rank.alias("rank"), "source_code", line.alias("line")).alias("x"))
    sorted_lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return rows.groupBy("period_start").agg(F.array_join(sorted_lines, "\n").alias("report"))
