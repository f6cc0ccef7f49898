"""Guards, due confirmations, repair scopes, and sinks that are read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import guards as G, ingest as I, reports as R
from ..schemas import FEED_PAGE
from ..sources import sinks
from .record_queries import shared
from .registry import query
from .report_queries import CLICKS

NOW = datetime(2024, 1, 20, 12)


_ASKED = (
    "r AS (SELECT id, publish_mode AS m, CASE WHEN id % 2 = 0 THEN '' ELSE coalesce(split_part(user_name, '.', 2), '') END AS league, id % 8 + 1 AS rid FROM articles), "
    "f AS (SELECT article_id AS id, arg_min(tab_id, (sort_order, tab_id)) FILTER (guard_enabled = 1) AS guarded, arg_min(tab_id, (sort_order, tab_id)) FILTER (trim(definition) <> '') AS defined FROM article_tabs JOIN tabs ON tabs.id = tab_id GROUP BY 1), "
    "o AS (SELECT id, m, league IN ('fr', 'en') AS in_scope, coalesce(guarded, CASE WHEN league IN ('fr', 'en') THEN defined END) AS tab FROM r JOIN f USING (id) WHERE (m = 0 OR league IN ('fr', 'en')) AND (league IN ('', 'fr', 'en') OR rid % 2 = 0)), "
    "asked AS (SELECT * FROM o WHERE tab IS NOT NULL)"
)


def asked(v):
    league = F.when(F.col("id") % 2 == 0, "").otherwise(F.split_part("user_name", F.lit("."), F.lit(2)))
    articles = v.articles.select("id", F.col("publish_mode").alias("configured_mode"), league.alias("route_league"), (F.col("id") % 8 + 1).alias("route_rule_id"))
    rules = v.event_tab_rules.withColumn("ai_guard_enabled", 1 - F.col("id") % 2)
    return G.guard_asks(articles, v.article_tabs, v.tabs, rules, ("fr", "en"))


@query(f"{_ASKED} SELECT id, m AS configured_mode, in_scope, tab AS tab_id FROM asked", "articles", "article_tabs", "tabs")
def j15_guard_asks(v):
    return asked(v)


@query(f"{_ASKED}, c AS (SELECT id, CASE WHEN id % 5 <> 0 THEN id % 26 + 1 END AS ct, CASE WHEN id % 4 = 1 THEN 0.5 ELSE 0.95 END AS cc FROM articles WHERE id % 3 <> 0), "
       "j AS (SELECT a.*, v.belongs, v.confidence AS p, t.enabled AS e, cc, ct, n.enabled AS fe, n.publish_mode AS fm FROM asked a LEFT JOIN verdicts v ON v.article_id = a.id LEFT JOIN c USING (id) LEFT JOIN tabs t ON t.id = a.tab LEFT JOIN tabs n ON n.id = ct), "
       "k AS (SELECT *, CASE WHEN belongs IS NULL THEN 'unchecked' WHEN belongs AND p >= 0.9 THEN CASE WHEN m = 0 THEN 'upgraded' ELSE 'kept' END WHEN belongs AND m = 0 OR cc IS NULL OR cc < 0.9 THEN 'kept' WHEN fe IS NULL THEN CASE WHEN m = 0 THEN 'kept' ELSE 'downgraded' END WHEN ct = tab THEN 'kept' ELSE 'reassigned' END AS outcome FROM j), "
       "x AS (SELECT *, CASE outcome WHEN 'upgraded' THEN e WHEN 'reassigned' THEN CASE WHEN fe = 0 THEN 0 ELSE fm END WHEN 'downgraded' THEN 0 ELSE m END AS effective_mode FROM k) "
       "SELECT id, outcome, effective_mode, CASE WHEN outcome = 'reassigned' THEN ct ELSE tab END AS final_tab, effective_mode = 1 AND m = 0 AS upgraded_to_publish, outcome = 'downgraded' AS downgraded_from_direct, CASE WHEN outcome = 'reassigned' THEN fe = 1 END AS reassigned_tab_active FROM x", "articles", "article_tabs", "verdicts", "tabs")
def j15_league_guard(v):
    verdicts = v.verdicts.select(F.col("article_id").alias("id"), "belongs", "confidence")
    choices = v.articles.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 26 + 1).alias("tab_id"), F.when(F.col("id") % 4 == 1, 0.5).otherwise(0.95).alias("confidence"))
    found = G.league_guard(asked(v), verdicts, choices, v.tabs)
    return found.select("id", "outcome", "effective_mode", "final_tab", *[F.col(f"league_guard.{c}") for c in ("upgraded_to_publish", "downgraded_from_direct", "reassigned_tab_active")])


@query("d AS (SELECT id, updated_at AS next_at, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-20 11:58:00' WHEN id % 3 = 1 THEN TIMESTAMP '2024-01-20 11:50:00' END AS claimed_at FROM articles WHERE status = 'NEEDS_REVIEW') SELECT id, next_at FROM d WHERE next_at <= TIMESTAMP '2024-01-20 12:00:00' AND (claimed_at IS NULL OR claimed_at <= TIMESTAMP '2024-01-20 11:55:00') ORDER BY next_at, id LIMIT 100", "articles")
def p5_due_confirmations(v):
    claimed = F.when(F.col("id") % 3 == 0, F.lit(datetime(2024, 1, 20, 11, 58))).when(F.col("id") % 3 == 1, F.lit(datetime(2024, 1, 20, 11, 50)))
    rows = v.articles.filter("status = 'NEEDS_REVIEW'").select("id", F.lit("DRAFT_CONFIRMING").alias("status"), F.lit(None).cast("bigint").alias("backend_archive_id"), F.col("updated_at").alias("next_at"), claimed.alias("claimed_at"), F.lit(None).cast("timestamp").alias("uncertain_since"), "updated_at")
    return G.due_confirmations(rows, NOW).select("id", "next_at")


@query("SELECT id, id % 2 = 0 AND id % 3 = 0 AS dirty_only, id % 3 = 0 AS plannable FROM articles", "articles")
def p21_repair_scope(v):
    none = F.array().cast("array<string>")
    rows = v.articles.select("id", F.create_map(
        F.lit("dirty_content"), F.array(F.lit("x")), F.lit("semantic_problems"), F.when(F.col("id") % 2 == 0, none), F.lit("title_problems"), F.when(F.col("id") % 3 == 0, none).otherwise(F.array(F.lit("t"))),
        F.lit("completeness_problems"), none, F.lit("channel_problems"), none,
    ).alias("issues"))
    return G.repair_scope(rows).drop("issues")


@query("WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents), n AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM l) SELECT doc_id, pos::INTEGER AS pos, text FROM n WHERE last < 5 OR pos < 3 OR pos > last - 2")
def l5_bounded_context(v):
    """The first three and the last two lines of each document of more than five."""
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return G.bounded_context(lines, "doc_id", 3, 2)


@query("SELECT source, source_url, trim(title_final) AS title FROM articles WHERE id % 10 <> 0 AND trim(title_final) <> ''", "articles")
def s1_feed_scan(v):
    """Feed pages of ten items are landed as JSON and scanned; the pages that report an error have none."""
    item = F.struct("source", "source_url", F.col("title_final").alias("translate_title"), F.lit("b").alias("translate_body"), F.lit("1").alias("archive_id"), F.lit("[]").alias("channels"))
    pages = v.articles.groupBy((F.col("id") % 10).alias("code10"), (F.col("id") / 100).cast("int").alias("p")).agg(F.collect_list(item).alias("items"))
    landed = pages.select(F.when(F.col("code10") == 0, 500).otherwise(0).alias("code"), F.struct("items", F.lit(True).alias("has_more")).alias("data"))
    path = shared(v, "feed")
    landed.write.json(path)
    return I.normalized(I.feed_items(sinks.feed_pages(v._spark, path, FEED_PAGE)))[0].select("source", "source_url", "title")


@query("SELECT id, article_id, to_status, created_at FROM article_events", "article_events")
def s10_event_append(v):
    path = shared(v, "events")
    half = F.col("id") % 2 == 0
    for part in (half, ~half):
        sinks.append_events(v.article_events.filter(part).select("id", "article_id", "to_status", "created_at"), path)
    return v._spark.read.schema("id bigint, article_id bigint, to_status string, created_at timestamp_ntz, event_date date").parquet(path).drop("event_date")


@query(f"{CLICKS} SELECT league_name, sum(switch_cnt)::BIGINT AS total_cnt FROM counts GROUP BY league_name", "click_events")
def s13_exported_ranking(v):
    path = shared(v, "export")
    sinks.export_csv(R.click_ranking(R.click_counts(v.click_events)).select("league_name", "total_cnt"), path)
    return v._spark.read.schema("league_name string, total_cnt bigint").option("header", True).csv(path)
