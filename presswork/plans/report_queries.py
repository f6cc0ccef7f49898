"""Reports: periods, comparisons, publications, clicks, competitions, errors."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import backends as B
from .registry import query

FIRST, LAST, BOUNDS = date(2024, 1, 1), date(2024, 2, 1), ("11:00", "19:00")
#: Beijing has had no daylight saving since 1991, so the equivalent may subtract 8 hours.
PERIODS = """moments AS (SELECT d + to_minutes(m) - INTERVAL 8 HOUR AS period_start FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) AS t(d), (VALUES (660), (1140)) AS b(m)),
periods AS (SELECT * FROM (SELECT period_start, lead(period_start) OVER (ORDER BY period_start) AS period_end FROM moments) WHERE period_end IS NOT NULL)"""
STATS = f"""{PERIODS},
inside AS (SELECT p.*, a.* FROM articles a JOIN periods p ON a.created_at >= p.period_start AND a.created_at < p.period_end),
counted AS (SELECT period_start, source, count(*) AS t, count(*) FILTER (status = 'PUBLISHED') AS p, count(*) FILTER (status = 'DRAFT_CREATED') AS d, count(*) FILTER (status = 'NEEDS_REVIEW') AS r,
  count(*) FILTER (status = 'ABANDONED') AS x, count(duplicate_of_article_id) AS u FROM inside GROUP BY ALL),
stats AS (SELECT p.period_start, p.period_end, s.code AS source_code, s.display_name AS source_name, coalesce(t, 0) AS total_count, coalesce(c.p, 0) AS published_count, coalesce(d, 0) AS draft_count, coalesce(r, 0) AS review_count,
  coalesce(x, 0) AS abandoned_count, coalesce(u, 0) AS duplicate_count FROM sources s CROSS JOIN periods p LEFT JOIN counted c ON c.period_start = p.period_start AND c.source = s.code WHERE s.enabled = 1)"""
COMPARED = f"""{STATS},
joined AS (SELECT c.*, b.total_count AS before, EXISTS (SELECT 1 FROM stats z WHERE z.period_end = c.period_end - INTERVAL 1 DAY) AS has FROM stats c LEFT JOIN stats b ON b.source_code = c.source_code AND b.period_end = c.period_end - INTERVAL 1 DAY),
typed AS (SELECT *, (total_count - before) / before AS r, date_diff('second', period_start, period_end) / 3600.0 AS h FROM joined),
changed AS (SELECT *, CASE WHEN NOT has THEN 'no_baseline' WHEN before IS NULL THEN 'new' WHEN before = 0 THEN CASE WHEN total_count > 0 THEN 'new' ELSE 'neutral' END
  WHEN r > 1 THEN 'surge' WHEN r < -0.8 THEN 'critical_drop' WHEN r < -0.5 THEN 'drop' WHEN abs(r) < 0.1 THEN 'stable' ELSE 'normal' END AS change,
  CASE WHEN h >= 24 THEN 10 ELSE greatest(1, round_even(10 * h / 24, 0)) END AS stopped, CASE WHEN h >= 24 THEN 5 ELSE greatest(1, round_even(5 * h / 24, 0)) END AS least FROM typed),
compared AS (SELECT period_start, period_end, source_code, total_count, coalesce(before, 0) AS baseline_count, change, CASE WHEN before > 0 THEN r END AS rate,
  CASE WHEN total_count = 0 AND coalesce(before, 0) >= stopped THEN 'critical' WHEN coalesce(before, 0) >= stopped AND total_count > 0 AND change = 'critical_drop' THEN 'critical'
  WHEN coalesce(before, 0) >= least AND change = 'drop' THEN 'warning' WHEN coalesce(before, 0) >= least AND change = 'surge' THEN 'info' WHEN change = 'new' AND total_count > 0 THEN 'info' ELSE 'normal' END AS level FROM changed)"""


def spans(v):
    return R.periods(v._spark, FIRST, LAST, BOUNDS)


def stats(v):
    return R.period_stats(v.articles, v.sources, spans(v))


@query("SELECT status, count(*) AS n FROM articles GROUP BY status UNION ALL SELECT 'TOTAL', count(*) FROM articles UNION ALL SELECT s, 0 FROM (VALUES ('RECEIVED'), ('QUALITY_CHECKING'), ('READY_TO_PUBLISH'), ('PUBLISHING'), ('DRAFT_CONFIRMING'), ('REJECTED'), ('ALREADY_PUBLISHED'), ('MAPPING_BLOCKED'), ('SOURCE_DUPLICATE'), ('TITLE_DUPLICATE'), ('ERROR')) AS z(s)", "articles")
def a1_status_counts(v):
    return R.status_counts(v.articles)


@query(f"{PERIODS} SELECT p.*, count(a.id) AS n FROM periods p LEFT JOIN articles a ON a.created_at >= period_start AND a.created_at < period_end GROUP BY ALL", "articles")
def st2_uneven_periods(v):
    """Every article falls into one period; periods without articles stay."""
    tiles = spans(v)
    inside = R.in_periods(v.articles, "created_at", tiles)
    counted = inside.groupBy("period_start").agg(F.count("*").alias("n"))
    return tiles.join(counted, "period_start", "left").select("period_start", "period_end", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{STATS} SELECT * FROM stats", "articles", "sources")
def a2_period_stats(v):
    return stats(v)


@query(f"{COMPARED} SELECT * FROM compared", "articles", "sources")
def j9_period_comparison(v):
    return R.compared(stats(v))


@query(f"{STATS}, n AS (SELECT period_start, period_end, sum(total_count)::BIGINT AS total, sum(published_count)::BIGINT AS published, sum(draft_count + review_count)::BIGINT AS pending, count(*) AS active_sources FROM stats GROUP BY ALL) "
       "SELECT n.*, CASE WHEN n.total > 0 THEN round_even(n.published / n.total * 100, 0) ELSE 0 END AS published_rate, CASE WHEN n.total > 0 THEN round_even(n.pending / n.total * 100, 0) ELSE 0 END AS pending_rate, "
       "CASE WHEN b.total > 0 THEN round_even((n.total - b.total) / b.total * 100, 0) END AS change_rate FROM n LEFT JOIN n b ON b.period_end = n.period_end - INTERVAL 1 DAY", "articles", "sources")
def a13_period_summary(v):
    return R.period_summary(stats(v))


@query(f"{COMPARED}, l AS (SELECT period_start, CASE level WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS k, source_code, upper(level) || ' ' || source_code || ' ' || baseline_count || ' -> ' || total_count AS line FROM compared WHERE level <> 'normal') "
       "SELECT period_start, string_agg(line, chr(10) ORDER BY k, source_code) AS report FROM l GROUP BY period_start", "articles", "sources")
def f20_rendered_report(v):
    return R.rendered(R.compared(stats(v)))


DAYS = """days AS (SELECT d + INTERVAL 19 HOUR - INTERVAL 8 HOUR AS period_start, d + INTERVAL 43 HOUR - INTERVAL 8 HOUR AS period_end FROM range(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15', INTERVAL 1 DAY) AS t(d)),
usable AS (SELECT b.article_id AS id, list(DISTINCT trim(t.name)) AS names FROM article_tabs b JOIN tabs t ON t.id = b.tab_id WHERE t.backend_tab_id <> 305 GROUP BY 1),
direct AS (SELECT DISTINCT a.id, a.published_at, trim(unnest(CASE WHEN a.id % 10 = 1 THEN ['NATION_9', ' NATION_9 ', 'old name'] ELSE coalesce(u.names, [t.name]) END)) AS tab FROM articles a LEFT JOIN usable u ON u.id = a.id LEFT JOIN tabs t ON t.id = a.tab_id WHERE a.status = 'PUBLISHED' AND a.publish_mode = 1),
inside AS (SELECT d.*, p.* FROM direct d JOIN days p ON published_at >= period_start AND published_at < period_end),
report AS (SELECT period_start, period_end, tab, count(*) AS n FROM inside GROUP BY ALL UNION ALL SELECT period_start, period_end, 'TOTAL', count(DISTINCT id) FROM inside GROUP BY ALL)"""


def week(v):
    return R.periods(v._spark, date(2024, 1, 8), date(2024, 1, 15), ("19:00",))


def publications(v):
    return R.publish_report(published(v), week(v))


def published(v, tracked=None):
    kept = F.when(F.col("id") % 10 == 1, F.array(F.lit("NATION_9"), F.lit(" NATION_9 "), F.lit("old name")))
    return R.published_tabs(v.articles.withColumn("published_tab_names", kept), v.article_tabs, v.tabs, tracked, excluded=(0, 305))


@query(f"{DAYS} SELECT * FROM report", "articles", "article_tabs", "tabs")
def a3_publish_report(v):
    return publications(v)


_TRACKED = ["NATION_3", "NATION_5", "NATION_9", "NATION_24"]


@query(f"{DAYS}, k AS (SELECT unnest({_TRACKED}) AS tab), c AS (SELECT period_start, tab, count(*) AS n FROM inside WHERE tab IN (SELECT tab FROM k) GROUP BY ALL UNION ALL SELECT period_start, 'TOTAL', count(DISTINCT id) FROM inside WHERE tab IN (SELECT tab FROM k) GROUP BY ALL) "
       "SELECT d.period_start, d.period_end, x.tab, coalesce(c.n, 0) AS n FROM days d CROSS JOIN (SELECT tab FROM k UNION ALL SELECT 'TOTAL') x LEFT JOIN c ON c.period_start = d.period_start AND c.tab = x.tab", "articles", "article_tabs", "tabs")
def a3_tracked_report(v):
    return R.publish_report(published(v, _TRACKED), week(v), _TRACKED)


_CELLS = ", ".join(f"coalesce(sum(n) FILTER (period_start = TIMESTAMP '2024-01-{7 + i:02d} 11:00:00'), 0)::BIGINT AS d{i}" for i in range(1, 8))


@query(f"{DAYS}, names AS (SELECT DISTINCT trim(name) AS tab FROM tabs UNION SELECT 'TOTAL'), w AS (SELECT names.tab, {_CELLS} FROM names LEFT JOIN report r ON r.tab = names.tab GROUP BY names.tab) SELECT *, d1 + d2 + d3 + d4 + d5 + d6 + d7 AS row_total FROM w", "articles", "article_tabs", "tabs")
def a4_weekly_matrix(v):
    return R.weekly_matrix(publications(v), v.tabs, [datetime(2024, 1, 7 + i, 11) for i in range(1, 8)])


def events_of(path: str):
    """A backend over the landed events: clicks of a window by league. It can't take windows of over three hours on every
    third day, and fails at five in the morning of every seventh."""

    def ask(start, stop):
        import json
        from collections import Counter

        import pyarrow.dataset as ds

        if start.day % 3 == 0 and (stop - start).total_seconds() > 3 * 3600:
            raise TimeoutError("too long a window")
        if start.day % 7 == 0 and start.hour <= 5 < start.hour + (stop - start).total_seconds() / 3600:
            raise ConnectionError("no answer")
        at, found = ds.field("ts"), Counter()
        wanted = (at >= start) & (at < stop) & (ds.field("event_type") == "view")
        for batch in ds.dataset(path).to_batches(columns=["props"], filter=wanted, batch_size=8192, batch_readahead=1, fragment_readahead=1, use_threads=False):
            found.update(str(json.loads(x or "{}").get("k", "")) for x in batch.column("props").to_pylist())
        return found.items()

    return ask


_ASKED = "e AS (SELECT * FROM click_events WHERE proc_time >= TIMESTAMP '2024-01-01' AND proc_time < TIMESTAMP '2024-01-11'), d AS (SELECT x::DATE AS stat_date, day(x) % 7 = 0 AS failed FROM range(DATE '2024-01-01', DATE '2024-01-11', INTERVAL 1 DAY) AS r(x))"


def asked(v):
    return B.windows(v._spark, events_of(f"{v._dir}/events.parquet"), date(2024, 1, 1), date(2024, 1, 10))


@query(f"{_ASKED} SELECT proc_time::DATE AS stat_date, league_name, count(*) AS switch_cnt FROM e JOIN d ON d.stat_date = proc_time::DATE WHERE NOT failed AND trim(league_name) <> '' GROUP BY ALL", "click_events")
def s5_windowed_days(v):
    """Days of a warehouse that is asked window by window, halved where it fails; nothing of a day of which an hour failed."""
    return B.complete_days(asked(v))


@query(f"{_ASKED} SELECT stat_date, CASE WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN failed THEN 0 ELSE count(DISTINCT nullif(trim(league_name), '')) END AS row_count, "
       "CASE WHEN failed THEN 0 ELSE count(nullif(trim(league_name), '')) END AS total_cnt, CASE WHEN failed THEN 'ConnectionError: no answer' END AS error FROM d LEFT JOIN e ON proc_time::DATE = stat_date GROUP BY stat_date, failed", "click_events")
def s5_day_ledger(v):
    return B.day_ledger(asked(v))


CLICKS = "counts AS (SELECT proc_time::DATE AS stat_date, league_name, count(*) AS switch_cnt FROM click_events WHERE trim(league_name) <> '' GROUP BY ALL)"


@query(f"{CLICKS} SELECT * FROM counts", "click_events")
def s5_click_counts(v):
    return R.click_counts(v.click_events)


@query(f"{CLICKS} SELECT league_name, sum(switch_cnt)::BIGINT AS total_cnt, count(DISTINCT stat_date) AS days, round_even(sum(switch_cnt) * 100.0 / sum(sum(switch_cnt)) OVER (), 2) AS share FROM counts GROUP BY league_name", "click_events")
def a5_click_ranking(v):
    return R.click_ranking(R.click_counts(v.click_events))


@query(f"{CLICKS} SELECT stat_date, sum(switch_cnt)::BIGINT AS total_cnt, count(*) AS leagues FROM counts GROUP BY stat_date", "click_events")
def a6_click_days(v):
    return R.click_days(R.click_counts(v.click_events))


@query(f"{CLICKS} SELECT d.stat_date, l.league_name, coalesce(c.switch_cnt, 0) AS switch_cnt FROM (SELECT DISTINCT stat_date FROM counts) d CROSS JOIN (SELECT DISTINCT league_name FROM counts) l LEFT JOIN counts c ON c.stat_date = d.stat_date AND c.league_name = l.league_name", "click_events")
def a7_click_grid(v):
    return R.click_grid(R.click_counts(v.click_events))


COMP = (
    "g AS (SELECT *, json_extract(quality, '$.league_guard') AS g FROM articles), named AS (SELECT * EXCLUDE g, g->>'$.actual_competition' AS competition FROM g "
    "WHERE (g->>'$.actual_competition') NOT IN ('', '非赛事') AND g->>'$.reassigned_tab_id' IS NULL AND (g->>'$.actual_competition') <> coalesce(nullif(g->>'$.guard_tab_name', ''), g->>'$.tab_name'))"
)


@query(f"{COMP} SELECT created_at::DATE AS day, competition, count(*) AS n FROM named GROUP BY ALL UNION ALL SELECT NULL, competition, count(*) FROM named GROUP BY competition", "articles")
def a8_competition_demand(v):
    return R.competition_demand(v.articles)


@query(f"{COMP}, per AS (SELECT competition, source, count(*) AS n FROM named GROUP BY ALL), top AS (SELECT competition, source AS top_source FROM (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY n DESC, source) AS k FROM per) WHERE k = 1) "
       "SELECT n.competition, count(*) AS total, max(created_at) AS last_seen, count(*) FILTER (status = 'DRAFT_CREATED') AS drafts, count(*) FILTER (status = 'PUBLISHED') AS published, count(*) FILTER (status = 'ABANDONED') AS abandoned, "
       "any_value(top_source) AS top_source, CASE WHEN any_value(t.enabled) IS NULL THEN 'missing' WHEN any_value(t.enabled) = 0 THEN 'disabled' WHEN any_value(t.definition) = '' THEN 'undefined' ELSE 'ready' END AS tab_state "
       "FROM named n JOIN top USING (competition) LEFT JOIN tabs t ON t.name = n.competition GROUP BY n.competition", "articles", "tabs")
def a9_uncovered_competitions(v):
    return R.uncovered_competitions(v.articles, v.tabs)


FAILED = "failed AS (SELECT *, substr(error, 1, 60) AS error_head FROM articles WHERE status = 'PUBLISH_FAILED')"


@query(f"{FAILED} SELECT error_head, count(*) AS n, min(updated_at) AS first_seen, count(*) >= 3 AS alert FROM failed GROUP BY error_head ORDER BY n DESC, first_seen, error_head LIMIT 4", "articles")
def a11_error_groups(v):
    return R.error_groups(v.articles.filter("status = 'PUBLISH_FAILED'"))


@query(f"{FAILED} SELECT error_head, rn, id FROM (SELECT *, row_number() OVER (PARTITION BY error_head ORDER BY updated_at, id)::INTEGER AS rn FROM failed) WHERE rn <= 3", "articles")
def a11_error_examples(v):
    return R.error_examples(v.articles.filter("status = 'PUBLISH_FAILED'"))


@query("""SELECT id, strftime(created_at + INTERVAL 8 HOUR, '%m-%d %H:%M') AS label, (date_trunc('week', created_at + INTERVAL 8 HOUR - INTERVAL 19 HOUR + INTERVAL 2 DAY) - INTERVAL 2 DAY)::DATE AS due FROM articles""", "articles")
def f47_saturday_due(v):
    return v.articles.select("id", R.local_label(F.col("created_at")).alias("label"), R.saturday_due(F.col("created_at")).alias("due"))


@query("s AS (SELECT v.article_id, v.belongs, (v.article_id % 7 <> 0) AS second, CASE WHEN v.article_id % 5 <> 0 THEN v.toxic = 0 END AS reference FROM verdicts v) "
       "SELECT count(*) FILTER (belongs = second) AS agree, count(*) FILTER (belongs <> second) AS disagree, count(*) FILTER (belongs IS NULL) AS errors, avg(CASE WHEN reference IS NOT NULL THEN (belongs = reference)::INT END) AS accuracy, avg(CASE WHEN reference IS NOT NULL THEN (second = reference)::INT END) AS second_accuracy FROM s", "verdicts")
def a15_model_agreement(v):
    judged = v.verdicts.select("article_id", "belongs", (F.col("article_id") % 7 != 0).alias("second"))
    truth = v.verdicts.select("article_id", F.when(F.col("article_id") % 5 != 0, F.col("toxic") == 0).alias("reference"))
    return R.model_agreement(judged, truth)
