"""Sinks, records, upserts, lists and promotion rules."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import html as H, promotion as M, quality as Q, text as X
from ..operators import dedup as D, ingest as I, publish as P, records as K, reports as R, search as S, tags as T
from ..sources import sinks
from .content_queries import _COUNTS, _ROSTER, roster
from .registry import query
from .report_queries import CLICKS, PERIODS, STATS, spans, stats


def shared(v, name: str) -> str:
    return f"{sinks.shared_folder(v._spark)}/presswork/{name}-{uuid.uuid4().hex}"


@query(f"{CLICKS} SELECT stat_date, league_name, CASE WHEN stat_date = DATE '2024-01-05' THEN switch_cnt + 1 ELSE switch_cnt END AS switch_cnt FROM counts WHERE stat_date <> DATE '2024-01-07'", "click_events")
def s6_replaced_day(v):
    """A day is replaced, and a day that fell to nothing is gone by its ledger row."""
    counts, path = R.click_counts(v.click_events), shared(v, "clicks")
    sinks.replace_partitions(counts, path, "stat_date")
    sinks.replace_partitions(counts.filter("stat_date = DATE'2024-01-05'").withColumn("switch_cnt", F.col("switch_cnt") + 1), path, "stat_date")
    ledger = v._spark.sql("SELECT DATE'2024-01-07' AS stat_date, 0 AS row_count")
    table = v._spark.read.schema("league_name string, switch_cnt bigint, stat_date date").parquet(path)
    return sinks.without_empty(table, ledger, "stat_date").select("stat_date", "league_name", "switch_cnt")


@query(f"{_ROSTER}, {_COUNTS}, good AS (SELECT competition_id FROM n WHERE team_count > 0 AND player_count > 0 AND competition_id % 3 <> 1) SELECT * FROM tags WHERE competition_id IN (SELECT * FROM good) UNION ALL SELECT competition_id, channel_id, tag_type FROM tags WHERE competition_id NOT IN (SELECT * FROM good) AND channel_id % 2 = 0", "seasons", "season_teams", "teams", "team_persons", "channels")
def s8_guarded_tags(v):
    new = roster(v)
    counts = T.tag_counts(new)
    was = counts.select("competition_id", F.when(F.col("competition_id") % 3 == 1, F.col("team_count") * 100).otherwise(F.col("team_count")).alias("team_count"), "player_count")
    return T.accepted_tags(new.filter("channel_id % 2 = 0"), new, T.acceptance(counts, was))


@query("SELECT id, name FROM tabs WHERE id <= 20 UNION ALL SELECT n_nationkey + 1, 'new ' || n_name FROM nation WHERE n_nationkey >= 20", "tabs")
def s11_seeded_dimension(v):
    dim = v.tabs.filter("id <= 20").select("id", "name")
    seed = v.tabs.select("id", F.concat(F.lit("new "), "name").alias("name"))
    return I.seeded(dim, seed, ["id", "name"])


@query("SELECT article_id, list(tab_id ORDER BY sort_order, tab_id) AS tab_ids FROM article_tabs GROUP BY article_id", "article_tabs", "articles")
def s12_ordered_tabs(v):
    return K.ordered_tabs(v.article_tabs)


@query("SELECT id, json_extract_string(quality, '$.pass') = 'true' AS pass, json_extract_string(quality, '$.decision') AS decision, json_extract_string(quality, '$.league_guard.configured_publish_mode')::INT AS mode FROM articles", "articles")
def s12_decoded_quality(v):
    return K.decoded(v.articles).select("id", F.col("q.pass").alias("pass"), F.col("q.decision").alias("decision"), F.col("q.league_guard.configured_publish_mode").alias("mode"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'A' || id WHEN id % 3 = 1 THEN 'B' || id ELSE '' END AS title, CASE WHEN id % 2 = 0 THEN [5, 7] ELSE [id] END AS channels FROM articles", "articles")
def s3_canonical_fields(v):
    i = F.col("id").cast("string")
    rows = v.articles.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("A"), i)).otherwise("").alias("translate_title"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("B"), i)).alias("title"), F.when(F.col("id") % 2 == 0, F.lit('[5, "x", "7", 5]')).otherwise(F.concat(F.lit("["), i, F.lit("]"))).alias("ch"))
    return K.canonical_fields(rows, {"title": ["translate_title", "title"]}).select("id", F.col("c_title").alias("title"), K.lenient_channels("ch").alias("channels"))


@query("s AS (SELECT *, CASE WHEN id % 8 = 0 THEN 'RECEIVED' ELSE status END AS now, CASE WHEN id % 9 = 0 THEN 'B' || title_final WHEN id % 4 = 0 THEN 'A' || title_final END AS met FROM articles) "
       "SELECT id, source_url, CASE WHEN now = 'RECEIVED' AND met IS NOT NULL THEN met ELSE title_final END AS title, coalesce(met, title_final) AS title_original, now AS status, publish_mode, [tab_id] AS tab_ids, CASE WHEN now = 'RECEIVED' AND met IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE updated_at END AS updated_at, CASE WHEN met IS NULL THEN updated_at ELSE TIMESTAMP '2024-03-01' END AS last_seen_at FROM s "
       "UNION ALL SELECT NULL, source_url || '/new', CASE WHEN id % 100 = 0 THEN '1' ELSE '3' END || title_final, '3' || title_final, CASE WHEN id % 100 = 0 THEN 'ABANDONED' ELSE 'RECEIVED' END, CASE WHEN id % 100 = 0 THEN 2 END, [1], TIMESTAMP '2024-03-01', TIMESTAMP '2024-03-01' FROM articles WHERE id % 50 = 0", "articles")
def s4_article_upsert(v):
    """Materials that are known by URL or by key, and new ones: the second has the first's key, the third its URL."""
    none, seen = F.lit(None).cast("string"), F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz")
    key = lambda letter: F.concat(F.lit(letter), F.col("id").cast("string"))
    state = v.articles.select(
        "id", "source", "source_url", F.when(F.col("id") % 3 == 0, key("k")).alias("origin_key"), F.col("title_final").alias("title_original"), F.col("title_final").alias("title"), F.lit("b").alias("body"), "upstream_archive_id",
        F.lit("{}").alias("raw"), F.array("tab_id").alias("tab_ids"), F.lit("B").alias("level"), "publish_mode", F.when(F.col("id") % 8 == 0, "RECEIVED").otherwise(F.col("status")).alias("status"), "updated_at", F.col("updated_at").alias("last_seen_at"),
    )
    part = lambda every, n, letter, origin, source="source", url="": v.articles.filter(F.col("id") % every == 0).select(
        (F.col("id") * 10 + n).alias("seq"), F.expr(source).alias("source"), F.concat("source_url", F.lit(url)).alias("source_url"), origin.alias("origin_key"), F.concat(F.lit(letter), "title_final").alias("title"), F.lit("c").alias("body"),
        "upstream_archive_id", F.lit("{}").alias("raw"), F.array(F.lit(n - 2).cast("bigint")).alias("tab_ids"), (F.col("id") % 100 == 0).alias("abandoned"), seen.alias("seen_at"),
    )
    batch = part(4, 1, "A", none).union(part(9, 2, "B", key("k"), "upper(source)", "/moved"))
    batch = batch.union(part(50, 3, "1", key("n"), url="/new")).union(part(50, 4, "2", key("n"), url="/new2")).union(part(50, 5, "3", none, url="/new"))
    return I.upserted(state, batch).select("id", "source_url", "title", "title_original", "status", "publish_mode", "tab_ids", "updated_at", "last_seen_at")


_P17 = "CASE WHEN status = 'DRAFT_CREATED' AND id % 4 <> 1 THEN CASE WHEN id % 4 = 3 THEN 'PUBLISH_FAILED' ELSE 'PUBLISHED' END END"


@query(f"s AS (SELECT id, status, published_at, updated_at, CASE WHEN id % 3 = 0 THEN 'old' END AS error, CASE WHEN id % 8 = 0 THEN ['kept'] ELSE [] END AS tab_names, {_P17} AS to_status FROM articles) "
       "SELECT id, coalesce(to_status, status) AS status, CASE WHEN to_status = 'PUBLISHED' THEN TIMESTAMP '2024-03-01' ELSE published_at END AS published_at, CASE WHEN to_status IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE updated_at END AS updated_at, "
       "CASE WHEN to_status = 'PUBLISH_FAILED' THEN CASE WHEN id % 5 = 0 THEN error ELSE 'refused' END WHEN to_status IS NULL THEN error END AS error, CASE WHEN to_status = 'PUBLISHED' AND len(tab_names) = 0 THEN ['tab ' || (id % 7)] ELSE tab_names END AS tab_names FROM s", "articles")
def p17_guarded_transitions(v):
    """Of three requests for an article the earliest valid one wins; errors and tab names follow where it leads."""
    i, none = F.col("id"), F.array().cast("array<string>")
    at = F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz")
    state = v.articles.select("id", "status", "published_at", "updated_at", F.when(i % 3 == 0, "old").alias("error"), F.when(i % 8 == 0, F.array(F.lit("kept"))).otherwise(none).alias("tab_names"))
    names = F.array(F.concat(F.lit("tab "), (i % 7).cast("string"))).alias("tab_names")
    asked = v.articles.filter(i % 4 != 1).select(
        "id", F.array(F.lit("DRAFT_CREATED")).alias("allowed_from"), F.col("updated_at").alias("expected"), F.when(i % 4 == 3, "PUBLISH_FAILED").otherwise("PUBLISHED").alias("to_status"), at.alias("at"), i.alias("request_id"),
        F.when(i % 5 == 0, "").otherwise("refused").alias("message"), names,
    )
    late = asked.withColumn("to_status", F.lit("REJECTED")).withColumn("request_id", F.col("request_id") + 1)
    stale = v.articles.select("id", F.array(F.lit("PUBLISHED")).alias("allowed_from"), F.col("created_at").alias("expected"), F.lit("ERROR").alias("to_status"), at.alias("at"), i.alias("request_id"), F.lit("stale").alias("message"), names)
    return I.transitioned(state, asked.unionByName(late).unionByName(stale))


@query("SELECT id, CASE WHEN id % 5 = 0 THEN false WHEN id % 3 = 0 THEN true WHEN id % 7 = 0 THEN true ELSE id % 2 = 0 END AS consumed FROM articles", "articles")
def p20_consumed_attempts(v):
    rows = v.articles.select("id", "body_html", (F.col("id") % 5 != 0).alias("attempted"), (F.col("id") % 3 == 0).alias("applied"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 2 == 0, F.sha2("body_html", 256)).otherwise("x").alias("body_sha256"), F.lit(4).alias("rule_version"))
    return K.consumed_attempts(rows, 3)


@query("SELECT id, enabled, assignment_count FROM publish_accounts WHERE enabled = 1", "publish_accounts")
def p22_accounts(v):
    return K.accounts(v.publish_accounts)


@query("WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS mode FROM documents) SELECT doc_id + 1 AS id, CASE WHEN mode = 1 AND regexp_matches(text, '\\p{L}') THEN 0 ELSE mode END AS effective_mode, mode = 1 AND regexp_matches(text, '\\p{L}') AS downgraded FROM m JOIN documents USING (doc_id)")
def p15_language_guard(v):
    docs = v.table("documents")
    modes = docs.select((F.col("doc_id") + 1).alias("id"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("configured_mode"))
    return P.language_guarded(modes, docs.select((F.col("doc_id") + 1).alias("id"), X.language_ratio(F.col("text"))[2].alias("other_ratio")))


@query("r AS (SELECT id AS run_id, id % 100 AS fetched, id % 3 AS k FROM articles) SELECT run_id, fetched, 0 AS inserted, CASE WHEN k = 1 THEN 'failed: bad item' ELSE 'done' END AS message, CASE k WHEN 0 THEN 'done' WHEN 1 THEN 'partly done' ELSE 'running' END AS status_label FROM r", "articles")
def p19_run_views(v):
    k = F.col("id") % 3
    details = F.concat(F.lit('{"fetched":'), (F.col("id") % 100).cast("string"), F.when(k == 1, ',"failed":"bad item"').otherwise(""), F.lit("}"))
    return K.run_views(v.articles.select(F.col("id").alias("run_id"), details.alias("details"), F.when(k == 0, "success").when(k == 1, "partial").otherwise("running").alias("status")))


_STATE = "CASE WHEN status = 'PUBLISH_FAILED' AND id % 3 = 0 THEN 'ERROR' ELSE status END"


@query(f"s AS (SELECT id % 40 AS run_id, id, {_STATE} AS state FROM articles), c AS (SELECT run_id, state, count(*) AS n FROM s GROUP BY ALL) "
       "SELECT run_id, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (state = 'ERROR'), 0)::BIGINT AS failed, coalesce((SELECT list(id ORDER BY id)[1:3] FROM s WHERE s.run_id = c.run_id AND state = 'ERROR'), []) AS failed_ids, "
       "string_agg(state || '=' || n, ',' ORDER BY state) AS tally, CASE WHEN count(*) FILTER (state = 'ERROR') > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM c GROUP BY run_id", "articles")
def a14_run_tally(v):
    return K.run_tally(v.articles.select((F.col("id") % 40).alias("run_id"), "id", F.expr(_STATE).alias("state")), 3)


@query("SELECT a.id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.article_id = a.id)", "articles", "verdicts")
def j17_not_judged(v):
    return K.not_judged(v.articles.select("id"), v.verdicts.select(F.col("article_id").alias("id")))


@query("k AS (SELECT * FROM (VALUES ('the'), ('license'), ('rights'), ('que')) AS x(keyword)) SELECT keyword, count(*) AS hits, count(*) FILTER (NOT coalesce(belongs, false)) AS decoys FROM articles a LEFT JOIN verdicts v ON v.article_id = a.id JOIN k ON contains(lower(body_html), keyword) GROUP BY keyword", "articles", "verdicts")
def a16_keyword_hits(v):
    words = v._spark.sql("SELECT explode(array('the', 'license', 'rights', 'que')) AS keyword")
    rows = v.articles.select("id", "body_html").join(v.verdicts.select(F.col("article_id").alias("id"), "belongs"), "id", "left")
    return K.keyword_hits(rows, words)


@query("g AS (SELECT id, json_extract(quality, '$.league_guard') AS g FROM articles), p AS (SELECT id, coalesce(g->>'$.guard_tab_name', '') AS recorded, g->>'$.reassigned_tab_id' IS NOT NULL AS moved, coalesce(g->>'$.tab_name', '') AS landed, coalesce(g->>'$.fallback_tab_name', '') AS target, regexp_extract(g->>'$.reason', '不属于「([^」]+)」', 1) AS said FROM g), "
       "n AS (SELECT *, CASE WHEN recorded <> '' THEN recorded WHEN NOT moved THEN landed WHEN said <> target THEN said ELSE '' END AS tab FROM p) "
       "SELECT n.id, CASE WHEN recorded <> '' THEN 'recorded' WHEN tab = '' THEN 'unknown' WHEN moved THEN 'parsed' ELSE 'landed' END AS kind, nullif(tab, '') AS guard_tab, t.id AS guard_tab_id FROM n LEFT JOIN tabs t ON t.name = tab", "articles", "tabs")
def j19_guard_backfill(v):
    return K.backfilled_guard(v.articles, v.tabs)


@query(f"{_ROSTER}, c AS (SELECT competition_id, CASE WHEN competition_id < 20 THEN n_name ELSE 'none' END AS competition_name FROM (SELECT DISTINCT competition_id FROM tags) JOIN nation ON n_nationkey = competition_id) SELECT DISTINCT t.id AS tab_id, channel_id FROM tags JOIN c USING (competition_id) JOIN tabs t ON t.name = c.competition_name", "seasons", "season_teams", "teams", "team_persons", "channels", "tabs")
def j12_whitelist(v):
    tags = roster(v)
    named = v.table("nation").select(F.col("n_nationkey").cast("bigint").alias("competition_id"), F.when(F.col("n_nationkey") < 20, F.col("n_name")).otherwise("none").alias("competition_name"))
    return K.whitelist(tags, named, v.tabs)[0]


@query("q AS (SELECT id, json_extract(quality, '$.issues') AS i FROM articles) SELECT id, json_array_length(i, '$.title_problems') = 0 AS title_complete, json_array_length(i, '$.completeness_problems') = 0 AS body_complete, contains(json_extract(i, '$.dirty_content')::VARCHAR, '广告') AS has_ad, json_array_length(i, '$.dirty_content') > 0 AS has_dirty FROM q", "articles")
def f48_issue_flags(v):
    return K.issue_flags(v.articles)


@query("SELECT article_id AS id, CASE WHEN article_id % 6 = 1 THEN belongs END AS belongs, CASE WHEN article_id % 6 = 1 THEN confidence END AS confidence, article_id % 6 = 1 AS valid FROM verdicts", "verdicts")
def x1_valid_verdicts(v):
    k, b, c = F.col("article_id") % 6, F.col("belongs").cast("string"), F.col("confidence").cast("string")
    good = F.concat(F.lit('{"belongs": '), b, F.lit(', "confidence": '), c, F.lit("}"))
    text = F.concat(F.lit('{"belongs": "'), b, F.lit('", "confidence": '), c, F.lit("}"))
    number = F.concat(F.lit('{"belongs": '), b, F.lit(', "confidence": "'), c, F.lit('"}'))
    answer = F.when(k == 0, "not json").when(k == 1, good).when(k == 2, text).when(k == 3, '{"belongs": true}').when(k == 4, F.concat(F.lit("junk "), good)).otherwise(number)
    return K.valid_verdicts(v.verdicts.select(F.col("article_id").alias("id"), answer.alias("answer")))


_LANDED = f"{STATS}, s AS (SELECT strftime(period_end, '%Y%m%d%H%M') AS period, source_code, total_count, published_count FROM stats)"


@query(f"{_LANDED} SELECT period, source_code, CASE WHEN substr(period, 7, 2)::INT % 2 = 0 THEN total_count + 1 ELSE total_count END AS total_count, published_count FROM s", "articles", "sources")
def s7_period_snapshots(v):
    """Every period's snapshot is saved, and those of even days again with other counts; blank sources are skipped."""
    rows = stats(v).select(F.date_format("period_end", "yyyyMMddHHmm").alias("period"), "source_code", "total_count", "published_count")
    blank = rows.withColumn("source_code", F.lit(" "))
    path = shared(v, "periods")
    sinks.replace_periods(rows.unionByName(blank), path)
    even = F.substring("period", 7, 2).cast("int") % 2 == 0
    sinks.replace_periods(rows.filter(even).withColumn("total_count", F.col("total_count") + 1), path)
    return v._spark.read.schema("source_code string, total_count bigint, published_count bigint, period string").parquet(path)


@query("SELECT id FROM articles WHERE status = 'PUBLISH_FAILED' AND contains(lower(error), 'timeout') AND coalesce(backend_archive_id, 0) = 0", "articles")
def p9_retryable_articles(v):
    return S.retryable(v.articles, "Timeout").select("id")


@query("SELECT id FROM articles WHERE status = 'NEEDS_REVIEW' AND updated_at >= TIMESTAMP '2024-01-10' AND contains(json_extract_string(quality, '$.reason'), 'model timeout')", "articles")
def p9_reviews_by_reason(v):
    return S.reasoned(v.articles, "model timeout", datetime(2024, 1, 10)).select("id")


@query("SELECT id, to_status, created_at FROM article_events ORDER BY created_at DESC, id DESC LIMIT 200", "article_events")
def l2_recent_runs(v):
    return S.recent_runs(v.article_events, limit=1000).select("id", "to_status", "created_at")


@query("l AS (SELECT article_id % 25 AS competition_id, arg_max(id, (created_at, id)) AS id, max(created_at) AS seen FROM article_events GROUP BY 1) SELECT competition_id, id, row_number() OVER (ORDER BY seen DESC, id DESC)::INTEGER AS place FROM l", "article_events")
def l3_refresh_runs(v):
    runs = v.article_events.select((F.col("article_id") % 25).alias("competition_id"), "id", F.struct("created_at", "id").alias("at"))
    return S.newest_first(runs, "competition_id", "at").select("competition_id", "id", "place")


_NOISE = r"(20\d{2}([-/]\d{2,4})?|\d{2}/\d{2}|赛季|第\s*\d+\s*(轮|比赛日|回合)|四分之一决赛|八分之一决赛|\d+\s*/\s*\d+\s*决赛|总决赛|半决赛|决赛|小组赛|附加赛|季后赛)"
_NAMED = "CASE id % 6 WHEN 0 THEN '非赛事（转会）' WHEN 1 THEN '2024/25赛季 ' || name || ' 第' || (id % 38) || '轮' WHEN 2 THEN '  C' || (id % 31) || ' 1/8决赛 ' WHEN 3 THEN 'Power Work Cup 小组赛' WHEN 4 THEN name || ' - FRANCE 决赛' ELSE '总决赛。' END"


@query(f"n AS (SELECT a.id, {_NAMED} AS x FROM articles a JOIN (SELECT id AS tab, name FROM tabs) t ON t.tab = a.tab_id), b AS (SELECT id, x, trim(trim(regexp_replace(regexp_replace(x, '{_NOISE}', '', 'g'), '\\s+', ' ', 'g')), ' -—·、,，.。') AS y FROM n), "
       "c AS (SELECT id, x, CASE lower(y) WHEN 'power work cup' THEN 'POWER WORK杯' ELSE y END AS y FROM b), k AS (SELECT list(name) AS names FROM tabs) "
       "SELECT id, CASE WHEN contains(x, '非赛事') THEN '非赛事' WHEN y = '' THEN '' WHEN len(list_filter(names, lambda t: contains(lower(y), lower(t)))) = 1 THEN list_filter(names, lambda t: contains(lower(y), lower(t)))[1] ELSE y END AS competition FROM c, k", "articles", "tabs")
def f15_competition_names(v):
    known = v.tabs.agg(F.collect_list("name").alias("names"))
    rows = v.articles.join(v.tabs.select(F.col("id").alias("tab_id"), "name"), "tab_id").withColumn("x", F.expr(_NAMED)).crossJoin(known)
    return Q.competition_names(rows, "x", "names").select("id", "competition")


_BODY = "regexp_replace(body_html, '[<&]', ' ', 'g') || CASE WHEN id % 19 = 0 THEN '<iframe src=x>' WHEN id % 23 = 0 THEN '<b onclick=\"x\">' WHEN id % 29 = 0 THEN chr(1) WHEN id % 31 = 0 THEN repeat('x ', 1250) || 'Foundation' ELSE '' END"
_FLAT = "trim(regexp_replace(regexp_replace(body_html, '[<&]', ' ', 'g') || CASE WHEN id % 29 = 0 AND id % 19 <> 0 AND id % 23 <> 0 THEN chr(1) WHEN id % 31 = 0 AND id % 19 <> 0 AND id % 23 <> 0 THEN repeat('x ', 1250) || 'Foundation' ELSE '' END, '\\s+', ' ', 'g'))"
_TITLES = "CASE WHEN t = '' THEN ['标题为空'] ELSE list_filter([CASE WHEN length(t) < 5 THEN '标题过短，信息不完整' END, CASE WHEN regexp_matches(t, '([,:]|\\.{2,}|…)$') THEN '标题疑似截断' END, CASE WHEN regexp_full_match(t, '[^\\p{L}\\p{N}]+') THEN '标题只有符号' END], lambda y: y IS NOT NULL) END"
_LACKS = "list_filter([CASE WHEN length(x) < 30 THEN '正文为空或少于30字' END, CASE WHEN regexp_matches(x, '(\\.\\.\\.$|…$)') THEN '正文疑似截断' END], lambda y: y IS NOT NULL)"
_DIRT = "list_filter([CASE WHEN id % 19 = 0 THEN '正文包含未清理的播放器或采集残留' END, CASE WHEN id % 23 = 0 AND id % 19 <> 0 THEN '正文包含未清理的可跳转属性' END, CASE WHEN regexp_matches(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN '正文包含乱码或控制字符' END], lambda y: y IS NOT NULL)"


@query(f"r AS (SELECT a.id, trim(regexp_replace(title_final, '\\s+', ' ', 'g')) AS t, {_FLAT} AS x, CASE WHEN a.id % 17 = 0 THEN NULL ELSE channels END AS ch, contains(title_final || ' ' || substr({_FLAT}, 1, 2000), 'Foundation') AS region, v.article_id IS NOT NULL AS asked, "
       "a.id % 4 <> 1 AS tc, v.belongs AS bc, CASE WHEN a.id % 11 = 0 THEN NULL ELSE v.toxic = 1 END AS hd, a.id % 5 = 0 AS nr, v.article_id IS NOT NULL AND a.id % 2 = 0 AS pl, a.id % 6 = 0 AS kb FROM articles a LEFT JOIN verdicts v ON v.article_id = a.id), "
       f"l AS (SELECT *, {_TITLES} AS t1, {_LACKS} AS c1, {_DIRT} AS d1 FROM r), "
       "y AS (SELECT *, CASE WHEN asked AND NOT tc AND len(t1) = 0 THEN ['AI 判断标题可能不完整：said'] ELSE t1 END AS tp, CASE WHEN asked AND coalesce(hd, false) AND len(d1) = 0 THEN ['AI 判断可能含广告或脏内容：said'] ELSE d1 END AS dc, "
       "CASE WHEN asked AND NOT coalesce(bc, true) AND NOT (pl AND kb) AND len(c1) = 0 THEN ['AI 判断正文可能不完整：said'] ELSE c1 END AS cp, CASE WHEN ch IS NULL THEN ['channels 缺失'] ELSE [] END AS hp, "
       "CASE WHEN NOT asked THEN NULL WHEN pl AND NOT tc THEN 'AI 修复计划与标题完整性结论矛盾' WHEN pl AND NOT coalesce(bc, false) AND NOT kb THEN 'AI 修复计划与正文完整性结论矛盾' WHEN bc IS NULL OR hd IS NULL THEN 'AI 质检返回字段格式错误：' || array_to_string(list_filter([CASE WHEN bc IS NULL THEN 'body_complete' END, CASE WHEN hd IS NULL THEN 'has_ad_or_dirty' END], lambda y: y IS NOT NULL), ',') END AS wrong FROM l), "
       "z AS (SELECT *, list_concat(CASE WHEN wrong IS NOT NULL THEN [wrong || '，需要人工确认'] ELSE [] END, CASE WHEN asked AND nr AND len(tp) + len(dc) + len(cp) = 0 THEN ['said'] ELSE [] END) AS sp FROM y), "
       "w AS (SELECT *, list_concat(list_concat(list_concat(list_concat(tp, dc), cp), hp), sp) AS every, pl AND wrong IS NULL AND len(tp) = 0 AS fix FROM z) "
       "SELECT id, NOT region AND NOT fix AND len(every) = 0 AS pass, CASE WHEN region THEN NULL WHEN fix THEN 'repairable' WHEN len(every) > 0 THEN 'manual_review' ELSE 'clean' END AS decision, CASE WHEN NOT region AND NOT fix AND len(every) = 0 THEN 100 ELSE 50 END AS score, "
       "CASE WHEN region THEN '文章涉及敏感地域信息「Foundation」，需人工审核' WHEN NOT fix AND len(every) = 0 THEN '内容正常' WHEN len(every) = 0 THEN 'said' ELSE substr(array_to_string(every, '；'), 1, 300) END AS reason, "
       "CASE WHEN region THEN ['文章涉及敏感地域信息「Foundation」，需人工审核'] ELSE every END AS every_issue FROM w", "articles", "verdicts")
def f14_quality_records(v):
    """Records with their lists: plans of 0 and 1, remains of players, handlers, control characters, and a region far down."""
    bodies = v.articles.withColumn("body", F.expr(_BODY.replace(", 'g')", ")").replace("\\\"", '"')))
    rows = bodies.select("id", F.col("title_final").alias("title"), "body", F.when(F.col("id") % 17 != 0, F.col("channels")).alias("channels"))
    i = F.col("article_id")
    answers = v.verdicts.select(
        i.alias("id"), (i % 4 != 1).alias("title_complete"), F.col("belongs").alias("body_complete"), F.when(i % 11 != 0, F.col("toxic") == 1).alias("has_dirty"), (i % 5 == 0).alias("needs_review"),
        F.lit("said").alias("reason"), F.when(i % 2 == 0, 1).otherwise(0).alias("plans"), (i % 6 == 0).alias("keeps_body"),
    )
    found = Q.evaluated(rows, answers, ["Foundation"])
    lists = ["title_problems", "dirty_content", "completeness_problems", "channel_problems", "semantic_problems", "regional_sensitive"]
    none = F.array().cast("array<string>")
    return found.select("id", "pass", "decision", "score", "reason", F.concat(*[F.coalesce(F.element_at("issues", k), none) for k in lists]).alias("every_issue"))


@query(f"{PERIODS}, m AS (SELECT s.code AS source, p.* FROM sources s, periods p WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.source = s.code AND a.created_at >= p.period_start AND a.created_at < p.period_end)) SELECT *, row_number() OVER (PARTITION BY source ORDER BY period_start) = 1 AS next FROM m", "articles", "sources")
def w7_missing_periods(v):
    """The periods in which each source has published nothing, as a ledger of reports would lack them, and the next to send."""
    tiles = spans(v)
    sources = v.sources.select(F.col("code").alias("source"))
    seen = R.in_periods(v.articles.select("source", "created_at"), "created_at", tiles)
    return R.missing_source_periods(seen.select("source", "period_start", "period_end").distinct(), sources, tiles)


_LEDGER = f"{PERIODS}, l AS (SELECT DISTINCT a.source, p.* FROM articles a JOIN periods p ON a.created_at >= p.period_start AND a.created_at < p.period_end WHERE p.period_end < TIMESTAMP '2024-01-25' AND ascii(substr(a.source, length(a.source), 1)) % 5 <> 3), "


@query(_LEDGER + "st AS (SELECT *, CASE WHEN day(period_end) % 9 = 4 AND ascii(substr(source, length(source), 1)) % 2 = 0 THEN 'FAILED' ELSE 'SENT' END AS status FROM l), last AS (SELECT * FROM periods ORDER BY period_end DESC LIMIT 1), "
       "k AS (SELECT s.code AS source, (SELECT arg_min({'a': st.period_start, 'b': st.period_end}, st.period_end) FROM st WHERE st.source = s.code AND status = 'FAILED') AS bad, (SELECT max(period_end) FROM st WHERE st.source = s.code) AS prev, last.period_start AS a, last.period_end AS b FROM sources s, last), "
       "d AS (SELECT *, bad IS NOT NULL AND bad.b::TIME = b::TIME AS again, prev IS NOT NULL AND prev < b AND prev::TIME = b::TIME AND prev + INTERVAL 1 DAY <= b AS follows FROM k) "
       "SELECT source, CASE WHEN again THEN bad.a WHEN follows THEN prev ELSE a END AS period_start, CASE WHEN again THEN bad.b WHEN follows THEN prev + INTERVAL 1 DAY ELSE b END AS period_end FROM d", "articles", "sources")
def w7_next_periods(v):
    """The period that each source's report is next sent for, folded from a ledger with failures and second attempts."""
    tiles = spans(v)
    seen = R.in_periods(v.articles.select("source", "created_at"), "created_at", tiles).select("source", "period_start", "period_end").distinct()
    mark = F.ascii(F.substring("source", -1, 1))
    seen = seen.filter((F.col("period_end") < F.lit(datetime(2024, 1, 25))) & (mark % 5 != 3))
    failed = (F.dayofmonth("period_end") % 9 == 4) & (mark % 2 == 0)
    first = seen.select("*", F.lit("PENDING").alias("status"), F.col("period_end").alias("at"))
    then = seen.select("*", F.when(failed, "FAILED").otherwise("SENT").alias("status"), (F.col("period_end") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    latest = tiles.orderBy(F.desc("period_end")).limit(1)
    return R.next_periods(first.unionByName(then), v.sources.select(F.col("code").alias("source")), latest)


@query("SELECT id, created_at FROM articles ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100", "articles", "article_tabs")
def l1_recent_articles(v):
    return S.article_search(v.articles, v.article_tabs, limit=50, offset=100).select("id", "created_at")


@query("SELECT x.id, y.id AS older, list_sort(list_intersect(x.channels, y.channels)) AS shared FROM articles x JOIN articles y ON y.id = x.id - 1 WHERE len(list_intersect(x.channels, y.channels)) > 0", "articles")
def u3_shared_channels(v):
    older = v.articles.select((F.col("id") + 1).alias("id"), F.col("id").alias("older"), F.col("channels").alias("other"))
    both = v.articles.join(older, "id").select("id", "older", F.array_sort(F.array_intersect("channels", "other")).alias("shared"))
    return both.filter("size(shared) > 0")


@query("SELECT competition_id, min(p) AS place FROM (SELECT o_custkey % 25 AS competition_id, 1 AS p FROM orders UNION ALL SELECT o_custkey % 31, 2 FROM orders) GROUP BY 1")
def u5_all_competitions(v):
    first = v.seasons.select("competition_id", F.lit(1).alias("p"))
    second = v.table("orders").select((F.col("o_custkey") % 31).alias("competition_id"), F.lit(2).alias("p"))
    return first.unionByName(second).groupBy("competition_id").agg(F.min("p").alias("place"))


@query("SELECT id, list_filter([CASE WHEN length(body_html) < 30 THEN 'short' END, CASE WHEN regexp_matches(body_html, '(\\.\\.\\.$|…$)') THEN 'cut' END, CASE WHEN regexp_matches(body_html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'control' END], lambda x: x IS NOT NULL) AS problems FROM articles", "articles")
def f11_body_problems(v):
    return v.articles.select("id", X.body_problems(F.col("body_html")).alias("problems"))


@query("b AS (SELECT id, substr(trim(regexp_replace(regexp_replace(body_html, '[<&]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 420) AS t FROM articles) SELECT x.id, y.id AS matched, length(x.t) >= 60 AND length(y.t) >= 60 AS checked, "
       "length(x.t) >= 60 AND length(y.t) >= 60 AND x.id % 2 = 1 AND x.id % 3 <> 0 AS overturned FROM b x JOIN b y ON y.id = x.id - 1", "articles")
def j8_judged_bodies(v):
    """Title duplicates whose bodies are compared: a verdict of different bodies overturns, a missing one doesn't."""
    i = F.col("id")
    bodies = v.articles.select("id", F.concat(F.lit("<p>"), F.regexp_replace("body_html", "[<&]", " "), F.lit("</p><script>x</script>")).alias("body_html"))
    pairs = v.articles.select("id", (i - 1).alias("matched"))
    return D.confirmed(pairs, bodies, pairs.filter(i % 3 != 0).select("id", "matched", (i % 2 == 0).alias("same")))


@query()
def j8_confirmed_duplicates(v):
    found = D.candidates(v.articles).filter("rank = 1").select("id", F.col("older").alias("matched"))
    verdicts = found.select("id", "matched", (F.col("id") % 2 == 0).alias("same"))
    return D.confirmed(found, v.articles.select("id", "body_html"), verdicts)


#: A body with calls in its midst and at its end: those that count at the end alone do so in an unbroken run.
_CALLS = "'<p>about ' || doc_id || '</p><p>更多意甲新闻</p><p>and ' || doc_id || ' went on</p><p>请点击查看更多详情</p>' || CASE WHEN doc_id % 2 = 0 THEN '<p>the last of ' || doc_id || '</p>' ELSE '' END || '<p>更多中超消息</p><p>合作咨询：ad@mail.org</p>'"


def called(v):
    return v.table("documents").select("doc_id", F.expr(_CALLS).alias("body_html"))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS k FROM documents) SELECT doc_id, 3 AS pos, '请点击查看更多详情' AS text, 'standalone_call_to_action' AS rule FROM d "
       "UNION ALL SELECT doc_id, 4 + k, '更多中超消息', 'standalone_more_news_cta' FROM d UNION ALL SELECT doc_id, 5 + k, '合作咨询：ad@mail.org', 'standalone_cooperation_contact' FROM d")
def f30_calls_and_tails(v):
    return M.promotional_blocks(called(v), "doc_id")


@query("SELECT doc_id, '<p>about ' || doc_id || '</p><p>更多意甲新闻</p><p>and ' || doc_id || ' went on</p>' || CASE WHEN doc_id % 2 = 0 THEN '<p>the last of ' || doc_id || '</p>' ELSE '' END AS clean FROM documents")
def f31_bodies_without_calls(v):
    """The bodies without their promotional blocks, byte for byte what is between them."""
    return M.without_promotional_blocks(called(v), "doc_id")


@query()
def f30_promotional_blocks(v):
    return M.promotional_blocks(v.table("pages").select("page_id", F.col("html").alias("body_html")), "page_id")


@query()
def f31_without_promotion(v):
    pages = v.table("pages").select("page_id", F.col("html").alias("body_html"))
    gone = M.promotional_blocks(pages, "page_id").select("page_id", "pos")
    kept = H.block_table(pages, "page_id").join(gone, ["page_id", "pos"], "left_anti")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return kept.groupBy("page_id").agg(F.array_join(lines, "\n").alias("text"))
