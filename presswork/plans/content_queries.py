"""Ingest, routing, tags, deduplication, selections, publication and text rules."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import html as H, text as X
from ..operators import dedup as D, ingest as I, publish as P, search as S, tags as T
from .registry import query

NOW = datetime(2024, 1, 20, 12)
PARSED = "parsed AS (SELECT id, source, created_at, string_split(string_split(user_name, ':')[2], '.') AS p FROM articles), marks AS (SELECT id, source, created_at, CASE WHEN p[2] IN ('', '_', 'xxx', 'null', 'none') THEN '' ELSE p[2] END AS league, CASE WHEN p[3] IN ('', '_', 'xxx', 'null', 'none') THEN '' ELSE p[3] END AS team FROM parsed)"


def marks(v):
    return v.articles.select("id", "source", "created_at", I.parsed_user_name().alias("p")).select("id", "source", "created_at", "p.league", "p.team")


@query(f"{PARSED} SELECT id, league, team FROM marks", "articles")
def f2_user_name_markers(v):
    return marks(v).select("id", "league", "team")


@query("s AS (SELECT id, 'kbs' AS source, 'https://news.kbs.co.kr/news/view.do?ncd=' || CASE WHEN id % 5 = 0 THEN '' WHEN id % 7 = 0 THEN 'x' ELSE '00' END || id AS source_url FROM articles) "
       "SELECT id, CASE WHEN id % 5 <> 0 AND id % 7 = 0 THEN NULL ELSE 'kbs:ncd:' || id END AS origin_key FROM s", "articles")
def f1_origin_key(v):
    prefix = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 == 0, "x").otherwise("00")
    rows = v.articles.select("id", F.lit("KBS").alias("source"), F.concat(F.lit("https://news.kbs.co.kr/news/view.do?ncd="), prefix, F.col("id").cast("string")).alias("source_url"))
    return rows.select("id", I.origin_key().alias("origin_key"))


_FEED = "f AS (SELECT id, source, CASE WHEN id % 11 = 0 THEN ' ' ELSE source_url END AS source_url, CASE WHEN id % 13 = 0 THEN '' ELSE '  ' || title_final END AS translate_title, CASE WHEN id % 17 = 0 THEN 'x1' WHEN id % 3 = 0 THEN NULL ELSE id::VARCHAR END AS archive_id, id % 19 = 0 AS bad_channels FROM articles)"


def feed(v):
    return v.articles.select(
        "source", F.when(F.col("id") % 11 == 0, " ").otherwise(F.col("source_url")).alias("source_url"), F.when(F.col("id") % 13 == 0, "").otherwise(F.concat(F.lit("  "), "title_final")).alias("translate_title"),
        F.lit("body").alias("translate_body"), F.when(F.col("id") % 17 == 0, "x1").when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("string")).alias("archive_id"),
        F.lit("").alias("user_name"), F.lit("m:fb.x.y").alias("username"), F.lit("").alias("dqd_litpic"), F.when(F.col("id") % 19 == 0, '["a"]').otherwise("[1,2,1]").alias("channels"),
    )


@query(f"{_FEED} SELECT source, source_url, trim(translate_title) AS title, 'body' AS body, 'm:fb.x.y' AS user_name, coalesce(archive_id, '0')::BIGINT AS archive_id, [1, 2]::BIGINT[] AS channels FROM f WHERE trim(source_url) <> '' AND trim(translate_title) <> '' AND coalesce(archive_id, '0') NOT LIKE 'x%' AND NOT bad_channels", "articles")
def s2_normalized_items(v):
    return I.normalized(feed(v))[0]


@query(f"{_FEED} SELECT CASE WHEN trim(source_url) = '' OR trim(translate_title) = '' THEN 'missing mandatory field' WHEN archive_id LIKE 'x%' THEN 'archive_id is no integer' ELSE 'channel is no integer' END AS reason, count(*) AS n FROM f WHERE trim(source_url) = '' OR trim(translate_title) = '' OR archive_id LIKE 'x%' OR bad_channels GROUP BY 1", "articles")
def s2_rejected_items(v):
    return I.normalized(feed(v))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("k AS (SELECT *, md5(body_html) AS identity FROM articles), r AS (SELECT id, identity, first_value(id) OVER (PARTITION BY identity ORDER BY duplicate_of_article_id IS NOT NULL, backend_archive_id IS NULL, coalesce(upstream_archive_id, 0) <= 0, CASE status WHEN 'PUBLISHED' THEN 0 WHEN 'DRAFT_CREATED' THEN 1 ELSE 2 END, id) AS canonical_id FROM k) "
       "SELECT *, id <> canonical_id AS is_duplicate FROM r", "articles")
def j1_canonical_articles(v):
    return I.canonical(v.articles.withColumn("identity", F.md5("body_html")))


def source_tabs(v):
    """Two tabs for each source: the generic one and one by its number."""
    own = v.sources.filter("code <> 'src_dead'").select(F.col("code").alias("source"), (F.expr("try_cast(regexp_extract(code, '[0-9]+', 0) AS INT)") % 12 + 2).alias("tab_id"), F.lit(1).alias("sort_order"))
    return own.unionByName(own.select("source", F.lit(1).alias("tab_id"), F.lit(0).alias("sort_order")))


@query(f"{PARSED}, usable AS (SELECT r.*, t.id AS bound FROM event_tab_rules r LEFT JOIN tabs t ON t.id = r.tab_id AND t.enabled = 1 WHERE r.enabled = 1 AND (t.id IS NOT NULL OR r.publish_mode_override = 2)), "
       "m AS (SELECT a.id, u.id AS rule_id, u.marker_type, u.tab_id, u.publish_mode_override, row_number() OVER (PARTITION BY a.id ORDER BY u.marker_type <> 'team', u.source_code IS NULL, u.id) AS k FROM marks a JOIN usable u ON ((u.marker_type = 'team' AND u.marker_code = a.team) OR (u.marker_type = 'league' AND u.marker_code = a.league)) AND (u.source_code IS NULL OR u.source_code = a.source)), "
       "own AS (SELECT DISTINCT source, 1 AS generic, regexp_extract(source, '[0-9]+')::INT % 12 + 2 AS own_tab FROM articles) "
       "SELECT a.id, coalesce(m.marker_type, 'source') AS match_type, m.rule_id, CASE WHEN m.rule_id IS NULL OR m.publish_mode_override = 2 THEN [1, own_tab] WHEN m.tab_id = 1 THEN [1] ELSE [1, m.tab_id] END AS tab_ids, coalesce(m.publish_mode_override = 2, false) AS abandoned "
       "FROM marks a JOIN own USING (source) LEFT JOIN m ON m.id = a.id AND m.k = 1", "articles", "event_tab_rules", "tabs")
def j2_rule_routing(v):
    return I.routed(marks(v), v.event_tab_rules, v.tabs, source_tabs(v))


@query(f"{PARSED}, g AS (SELECT league, min(created_at) AS first_seen, max(created_at) AS last_seen, arg_min(source, (created_at, id)) AS sample_source FROM marks WHERE league <> '' GROUP BY league) "
       "SELECT 'league' AS marker_type, league AS marker_code, r.id AS rule_id, r.id IS NULL AS pending, first_seen, last_seen, sample_source FROM g LEFT JOIN event_tab_rules r ON r.marker_type = 'league' AND r.marker_code = g.league AND r.source_code IS NULL", "articles", "event_tab_rules")
def j3_marker_observation(v):
    return I.observed(v.event_tab_rules, marks(v))


_ROSTER = """latest AS (SELECT id AS season_id, competition_id FROM (SELECT *, row_number() OVER (PARTITION BY competition_id ORDER BY start_date DESC, id DESC) AS k FROM seasons WHERE start_date <= DATE '1999-01-01') WHERE k <= 2),
pairs AS (SELECT DISTINCT competition_id, s.team_id FROM latest l JOIN season_teams s USING (season_id) JOIN teams t ON t.id = s.team_id WHERE NOT deleted AND team_type = 'default'),
tags AS (SELECT competition_id, channel_id, max(tag_type) AS tag_type FROM (SELECT competition_id, c.id AS channel_id, 'Team' AS tag_type FROM pairs p JOIN channels c ON c.relate_type = 'Team' AND c.backend_id = p.team_id
  UNION ALL SELECT DISTINCT competition_id, c.id, 'Player' FROM pairs p JOIN team_persons q USING (team_id) JOIN channels c ON c.relate_type = 'Player' AND c.backend_id = q.person_id) GROUP BY ALL)"""


def roster(v, as_of=date(1999, 1, 1)):
    return T.roster_tags(T.latest_seasons(v.seasons, as_of), v.season_teams, v.teams, v.team_persons, v.channels)


@query(f"{_ROSTER} SELECT * FROM tags", "seasons", "season_teams", "teams", "team_persons", "channels")
def j4_roster_tags(v):
    return roster(v)


@query("n AS (SELECT id AS team_id FROM teams WHERE NOT deleted AND type = 'national') SELECT channel_id, max(tag_type) AS tag_type FROM (SELECT c.id AS channel_id, 'Team' AS tag_type FROM n JOIN channels c ON c.relate_type = 'Team' AND c.backend_id = n.team_id "
       "UNION ALL SELECT c.id, 'Player' FROM n JOIN team_persons q USING (team_id) JOIN channels c ON c.relate_type = 'Player' AND c.backend_id = q.person_id) GROUP BY channel_id", "teams", "team_persons", "channels")
def j5_national_tags(v):
    return T.national_tags(v.teams, v.team_persons, v.channels)


_COUNTS = "n AS (SELECT competition_id, count(*) FILTER (tag_type = 'Team') AS team_count, count(*) FILTER (tag_type = 'Player') AS player_count FROM tags GROUP BY ALL)"


@query(f"{_ROSTER}, {_COUNTS} SELECT * FROM n", "seasons", "season_teams", "teams", "team_persons", "channels")
def a10_tag_counts(v):
    return T.tag_counts(roster(v))


@query(f"{_ROSTER}, {_COUNTS}, o AS (SELECT competition_id, team_count * (1 + competition_id % 3) AS ot, player_count AS op FROM n WHERE competition_id % 4 <> 0), "
       "r AS (SELECT n.*, CASE WHEN team_count = 0 OR player_count = 0 THEN 'empty' WHEN coalesce(ot, 0) > 0 AND (team_count < floor(ot * 0.5) OR player_count < floor(op * 0.5)) THEN 'dropped' ELSE '' END AS reason FROM n LEFT JOIN o USING (competition_id)) "
       "SELECT competition_id, team_count, player_count, reason = '' AS accepted, reason FROM r", "seasons", "season_teams", "teams", "team_persons", "channels")
def a12_refresh_acceptance(v):
    new = T.tag_counts(roster(v))
    old = new.filter("competition_id % 4 <> 0").select("competition_id", (F.col("team_count") * (1 + F.col("competition_id") % 3)).alias("team_count"), "player_count")
    return T.acceptance(new, old)


@query("l AS (SELECT id AS tab_id FROM tabs WHERE id % 2 = 0), ok AS (SELECT l.tab_id, c.c AS channel_id FROM l, (VALUES (0), (1), (2), (3), (8)) AS c(c)), x AS (SELECT id, unnest(channels) AS channel_id, generate_subscripts(channels, 1) AS pos FROM articles), y AS (SELECT id, channel_id, min(pos) AS pos FROM x WHERE channel_id <> 3 GROUP BY ALL), "
       "k AS (SELECT y.* FROM y WHERE NOT EXISTS (SELECT 1 FROM article_tabs t JOIN l ON l.tab_id = t.tab_id WHERE t.article_id = y.id) OR EXISTS (SELECT 1 FROM article_tabs t JOIN ok ON ok.tab_id = t.tab_id WHERE t.article_id = y.id AND ok.channel_id = y.channel_id)) "
       "SELECT a.id, coalesce(list(k.channel_id ORDER BY k.pos) FILTER (k.channel_id IS NOT NULL), []) AS channels FROM articles a LEFT JOIN k ON k.id = a.id GROUP BY a.id", "articles", "article_tabs", "tabs")
def j13_filtered_channels(v):
    allowed = v.tabs.filter("id % 2 = 0").select(F.col("id").alias("tab_id"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in (0, 1, 2, 3, 8)])).alias("channel_id"))
    return T.filtered_channels(v.articles, v.article_tabs, allowed, v._spark.range(3, 4).toDF("channel_id"))


#: The titles are ASCII and of Latin letters; without NFKC's work the fragment that SQL has too is the same.
_TITLE = "regexp_replace(lower(title_final), '[^0-9a-z]+', '', 'g')"
RECALL = f"""t AS (SELECT id, created_at, tab_id, list_distinct(channels) AS ch, {_TITLE} AS a FROM articles WHERE length({_TITLE}) >= 8),
p AS (SELECT x.id, y.id AS older, x.a, y.a AS b, len(list_intersect(x.ch, y.ch)) > 0 AS shared FROM t x JOIN t y ON y.id < x.id AND y.created_at >= x.created_at - INTERVAL 3 DAY AND y.created_at::DATE <= x.created_at::DATE AND (x.tab_id = y.tab_id OR len(list_intersect(x.ch, y.ch)) > 0))"""


@query(f"{RECALL} SELECT id, older, shared AS shared_channel FROM p", "articles")
def j6_recall_pairs(v):
    plain = F.length(D.normalized_title("title_final")) >= D.TITLE_LEAST
    return D.recall_pairs(v.articles.filter(plain))


@query()
def j6_title_candidates(v):
    return D.candidates(v.articles)


@query()
def j7_settled_duplicates(v):
    verdicts = v.verdicts.select(F.col("article_id").alias("candidate_id"), (~F.col("belongs")).alias("duplicate"), F.lit(None).cast("bigint").alias("matched_id"))
    return D.settled(v.articles, D.candidates(v.articles), verdicts)


@query("f AS (SELECT id, id - 1 AS older, 1 AS rank, id % 7 = 0 AS exact FROM articles WHERE id > 2 AND id % 4 <> 3 UNION ALL SELECT id, id - 2, 2, id % 5 = 0 FROM articles WHERE id > 2 AND id % 4 <> 3), "
       "v AS (SELECT id, CASE WHEN id % 11 <> 0 THEN id % 3 = 0 END AS dup, CASE WHEN id % 2 = 0 THEN id - 1 ELSE id - 9 END AS matched_id FROM articles WHERE id % 13 <> 0), "
       "p AS (SELECT id, arg_min(older, rank) FILTER (exact) AS first_exact, list(older) AS offered FROM f GROUP BY id), "
       "j AS (SELECT a.id, p.first_exact, p.offered, v.dup, v.matched_id, CASE WHEN offered IS NULL THEN 'not_duplicate' WHEN first_exact IS NOT NULL THEN 'duplicate' WHEN dup IS NULL OR (dup AND NOT list_contains(offered, v.matched_id)) THEN 'needs_review' WHEN dup THEN 'duplicate' ELSE 'not_duplicate' END AS outcome "
       "FROM articles a LEFT JOIN p ON p.id = a.id LEFT JOIN v ON v.id = a.id WHERE publish_mode = 1 AND a.id % 9 <> 0) "
       "SELECT id, outcome, CASE WHEN first_exact IS NOT NULL THEN first_exact WHEN outcome = 'duplicate' THEN matched_id END AS matched FROM j", "articles")
def j7_settled_verdicts(v):
    """Candidates settled by exact titles and verdicts: missing, invalid and foreign answers go to review."""
    i = F.col("id")
    rows = v.articles.filter("id > 2 and id % 4 <> 3")
    found = rows.select("id", (i - 1).alias("older"), F.lit(1).alias("rank"), (i % 7 == 0).alias("exact")).unionByName(rows.select("id", (i - 2).alias("older"), F.lit(2).alias("rank"), (i % 5 == 0).alias("exact")))
    verdicts = v.articles.filter("id % 13 <> 0").select(i.alias("candidate_id"), F.when(i % 11 != 0, i % 3 == 0).alias("duplicate"), F.when(i % 2 == 0, i - 1).otherwise(i - 9).alias("matched_id"))
    return D.settled(v.articles.withColumn("manually_reviewed", i % 9 == 0), found, verdicts)


@query("SELECT id, title_final FROM articles WHERE status = 'PUBLISHED' AND source = 'src2' AND contains(lower(title_final), 'the') AND id IN (SELECT article_id FROM article_tabs WHERE tab_id = 3) ORDER BY created_at DESC, id DESC LIMIT 50", "articles", "article_tabs")
def p1_article_search(v):
    return S.article_search(v.articles, v.article_tabs, status="PUBLISHED", source="src2", tab_id=3, query="The").select("id", "title_final")


@query("SELECT * FROM (SELECT id, json_extract_string(quality, '$.regional_sensitive') = 'true' AS sensitive, coalesce(json_extract_string(quality, '$.league_guard.reassigned_tab_active') = 'false', false) AS reassigned_inactive FROM articles) WHERE sensitive OR reassigned_inactive", "articles")
def p2_flagged_articles(v):
    return S.flagged(v.articles)


@query("SELECT id, error, updated_at FROM articles WHERE status = 'PUBLISH_FAILED' AND updated_at >= TIMESTAMP '2024-01-10' ORDER BY updated_at DESC, id DESC LIMIT 200", "articles")
def p3_recent_failures(v):
    return S.recent_failures(v.articles, datetime(2024, 1, 10)).select("id", "error", "updated_at")


@query("SELECT id, status FROM articles WHERE (status = 'PUBLISHED' AND published_at >= TIMESTAMP '2024-01-15') OR (status IN ('READY_TO_PUBLISH', 'PUBLISHING', 'DRAFT_CONFIRMING', 'DRAFT_CREATED') AND created_at >= TIMESTAMP '2024-01-15')", "articles")
def p4_dedup_pool(v):
    return S.dedup_pool(v.articles, datetime(2024, 1, 15)).select("id", "status")


@query("SELECT id, CASE WHEN coalesce(backend_archive_id, 0) > 0 THEN CASE WHEN publish_mode = 1 THEN 'PUBLISHED' ELSE 'DRAFT_CREATED' END ELSE 'PUBLISH_FAILED' END AS to_status, coalesce(backend_archive_id, 0) <= 0 AS needs_reconcile FROM articles WHERE status IN ('NEEDS_REVIEW', 'DRAFT_CREATED') AND updated_at <= TIMESTAMP '2024-01-20 11:50:00'", "articles")
def p6_stale_in_flight(v):
    flying = v.articles.withColumn("status", F.when(F.col("status").isin("NEEDS_REVIEW", "DRAFT_CREATED"), "PUBLISHING").otherwise(F.col("status")))
    return S.stale_in_flight(flying, NOW)


@query("SELECT id FROM articles WHERE status = 'NEEDS_REVIEW' AND updated_at <= TIMESTAMP '2024-01-20 11:50:00' AND id % 5 <> 0 ORDER BY created_at DESC, id DESC LIMIT 200", "articles")
def p7_orphans(v):
    received = v.articles.withColumn("status", F.when(F.col("status") == "NEEDS_REVIEW", "RECEIVED").when(F.col("status") == "ABANDONED", "NEEDS_REVIEW").otherwise(F.col("status")))
    return S.orphans(received, v.articles.filter("id % 5 = 0"), NOW).select("id")


@query("t AS (SELECT article_id, count(*) AS n FROM article_events WHERE event_type = 'error' GROUP BY ALL) SELECT a.id, coalesce(n, 0) AS attempts FROM articles a LEFT JOIN t ON t.article_id = a.id WHERE status = 'NEEDS_REVIEW' AND error IS NULL AND contains(json_extract_string(quality, '$.reason'), 'timeout') AND updated_at <= TIMESTAMP '2024-01-20 12:00:00' AND coalesce(n, 0) < 2 ORDER BY updated_at, id LIMIT 100", "articles", "article_events")
def p8_recheck_list(v):
    return S.rechecks(v.articles, v.article_events, ["timeout", "unavailable"], NOW).select("id", "attempts")


_LISTED = "SELECT r.id, marker_type, marker_code, source_code, t.name AS tab_name, r.tab_id IS NULL AS pending, row_number() OVER (ORDER BY r.tab_id IS NOT NULL, marker_type, marker_code, source_code IS NOT NULL, source_code, r.id)::INTEGER AS place FROM event_tab_rules r LEFT JOIN tabs t ON t.id = r.tab_id LEFT JOIN sources s ON s.code = r.source_code"


@query(_LISTED, "event_tab_rules", "tabs", "sources")
def p10_rule_listing(v):
    return S.rule_listing(v.event_tab_rules, v.tabs, v.sources)


@query(_LISTED + " WHERE marker_type = 'league' AND r.source_code IS NULL AND (contains(lower(marker_code), 'e') OR contains(lower(coalesce(t.name, '')), 'e'))", "event_tab_rules", "tabs", "sources")
def p10_rule_search(v):
    return S.rule_listing(v.event_tab_rules, v.tabs, v.sources, marker_type="league", search=" E ", source_code=None)


@query(_LISTED + " WHERE r.tab_id IS NULL", "event_tab_rules", "tabs", "sources")
def p10_pending_rules(v):
    return S.rule_listing(v.event_tab_rules, v.tabs, v.sources, pending_only=True)


@query("SELECT id, backend_tab_id NOT IN (0) AS publishable, enabled = 1 AS active, trim(coalesce(definition, '')) <> '' AND backend_tab_id NOT IN (58, 0) AS guard_candidate FROM tabs", "tabs")
def p11_tab_predicates(v):
    return S.tab_predicates(v.tabs)


@query("SELECT code, display_name, row_number() OVER (ORDER BY lower(display_name), code)::INTEGER AS place FROM sources WHERE enabled = 1 AND code IN (SELECT source FROM articles WHERE tab_id = 4)", "sources", "articles")
def p12_source_listing(v):
    return S.source_listing(v.sources, v.articles, 4)


@query("q AS (SELECT id, quality::JSON AS q FROM articles), k AS (SELECT *, json_keys(q, '$.issues') AS keys FROM q) SELECT id FROM k WHERE json_type(q, '$.pass') = 'BOOLEAN' AND json_extract_string(q, '$.pass') = 'true' AND json_extract_string(q, '$.decision') = 'clean' AND json_type(q, '$.needs_review') = 'BOOLEAN' AND json_extract_string(q, '$.needs_review') = 'false' AND json_extract_string(q, '$.repair_plan_error') IS NULL "
       "AND list_sort(keys) = ['channel_problems', 'completeness_problems', 'dirty_content', 'semantic_problems', 'title_problems'] AND len(list_filter(keys, lambda x: json_array_length(q, '$.issues.' || x) > 0)) = 0", "articles")
def p13_strict_pass(v):
    return S.strictly_passing(v.articles)


@query("g AS (SELECT id, publish_mode, json_extract(quality, '$.league_guard') AS g FROM articles), p AS (SELECT *, g->>'$.reassigned_tab_id' IS NOT NULL AS moved, coalesce(g->>'$.downgraded_from_direct', '') = 'true' AS less, (g->>'$.effective_publish_mode') = '1' AS wished, trim(g->>'$.actual_competition') AS c, coalesce(g->>'$.guard_tab_name', '') AS looked, g->>'$.tab_name' AS landed FROM g) "
       "SELECT id, CASE WHEN NOT moved AND less THEN 'downgraded' WHEN wished THEN CASE WHEN publish_mode = 1 THEN 'upgraded' ELSE 'stale' END WHEN moved AND (g->>'$.reassigned_tab_active') = 'false' THEN 'reassigned_inactive' ELSE 'kept' END AS guard_state, "
       "CASE WHEN moved OR c = '非赛事' OR c = CASE WHEN looked = '' AND NOT moved THEN landed ELSE looked END THEN '' ELSE c END AS competition FROM p", "articles")
def p18_guard_outcome(v):
    return S.guard_outcome(v.articles)


@query("SELECT article_id, id AS event_id, created_at, to_status AS status, to_status = 'PUBLISH_FAILED' AS needs_reconcile FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS k FROM article_events) WHERE k = 1", "article_events")
def w1_latest_event(v):
    return S.latest_event(v.article_events)


@query("SELECT article_id, id, row_number() OVER w::INTEGER AS place, lag(to_status) OVER w AS from_status, to_status, (epoch_us(created_at) - lag(epoch_us(created_at)) OVER w) // 1000000 AS seconds FROM article_events WINDOW w AS (PARTITION BY article_id ORDER BY created_at, id)", "article_events")
def w2_timeline(v):
    return S.timeline(v.article_events)


@query("l AS (SELECT article_id % 50 AS run, id, to_status, created_at FROM article_events) SELECT run, arg_max(id, (created_at, id)) AS id, arg_max(to_status, (created_at, id)) AS to_status FROM l GROUP BY run", "article_events")
def s9_ledger_latest(v):
    runs = v.article_events.select((F.col("article_id") % 50).alias("run"), "id", "to_status", F.struct("created_at", "id").alias("at"))
    return S.ledger_latest(runs, "run", "at").drop("at")



def routes(v):
    decided = F.when(F.col("id") % 13 == 0, F.col("publish_mode"))
    return v.articles.select("id", "source", F.when(F.col("id") % 3 == 0, F.col("id") % 8 + 1).alias("route_rule_id"), decided.alias("decided_mode"))


@query("u AS (SELECT id AS tab_id, enabled, publish_mode AS mode FROM tabs), vote AS (SELECT article_id AS id, count(DISTINCT mode) FILTER (enabled = 1) AS k, min(mode) FILTER (enabled = 1) AS m, bool_or(enabled = 0) AS off FROM article_tabs JOIN u USING (tab_id) GROUP BY 1), "
       "j AS (SELECT a.id, coalesce(k, 0) AS k, m, off, r.publish_mode_override AS rm, s.publish_mode_override AS sm, snap FROM (SELECT id, source, CASE WHEN id % 3 = 0 THEN id % 8 + 1 END AS rid, CASE WHEN id % 13 = 0 THEN publish_mode END AS snap FROM articles) a LEFT JOIN vote USING (id) LEFT JOIN event_tab_rules r ON r.id = rid AND r.enabled = 1 AND r.tab_id IS NOT NULL LEFT JOIN sources s ON s.code = a.source), "
       "c AS (SELECT *, coalesce(rm, sm, CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN m END) AS mode FROM j) SELECT id, coalesce(snap, CASE WHEN mode = 1 AND off THEN 0 ELSE mode END) AS publish_mode, CASE WHEN mode = 1 AND off THEN 0 ELSE mode END AS configured_mode, k > 1 AND rm IS NULL AND sm IS NULL AND snap IS NULL AS conflict FROM c", "articles", "article_tabs", "tabs", "sources", "event_tab_rules")
def j11_publish_modes(v):
    return P.publish_modes(routes(v), v.article_tabs, v.tabs, v.sources, v.event_tab_rules)


@query("n AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM articles), slots AS (SELECT id AS account_id, unnest(range(assignment_count, assignment_count + 20000)) AS level FROM publish_accounts WHERE enabled = 1), o AS (SELECT account_id, row_number() OVER (ORDER BY level, account_id) AS place FROM slots) SELECT n.id, o.account_id FROM n JOIN o USING (place)", "articles", "publish_accounts")
def j18_balanced_accounts(v):
    return P.assigned_accounts(v.articles, v.publish_accounts)


_OUTBOX = "t AS (SELECT article_id AS id, string_agg(b::VARCHAR, ',' ORDER BY b) AS tabs FROM (SELECT DISTINCT article_id, backend_tab_id AS b FROM article_tabs a JOIN tabs t ON t.id = a.tab_id) GROUP BY 1)"


@query(f"{_OUTBOX} SELECT a.id, t.tabs, channels[1]::VARCHAR || CASE WHEN channels[2] <> channels[1] THEN ',' || channels[2] ELSE '' END AS channel_list, CASE WHEN trim(title_final) = '' THEN 'no title' WHEN trim(body_html) = '' THEN 'no body' WHEN t.tabs IS NULL THEN 'no tab' END AS reject_reason FROM articles a LEFT JOIN t USING (id)", "articles", "article_tabs", "tabs")
def f42_outbox(v):
    return P.outbox(v.articles, v.article_tabs, v.tabs)


@query("d AS (SELECT id, status, upstream_archive_id, CASE id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'reject' ELSE 'other' END AS action FROM articles), o AS (SELECT *, CASE WHEN status <> 'NEEDS_REVIEW' THEN NULL WHEN action = 'pass' THEN CASE WHEN upstream_archive_id > 0 THEN 'ALREADY_PUBLISHED' ELSE 'READY_TO_PUBLISH' END WHEN action = 'reject' THEN 'REJECTED' END AS t FROM d) SELECT id, action, coalesce(t, status) AS status, t IS NULL AS refused FROM o", "articles")
def p16_reviewed(v):
    decisions = v.articles.select("id", F.when(F.col("id") % 3 == 0, "pass").when(F.col("id") % 3 == 1, "reject").otherwise("other").alias("action"))
    return P.reviewed(v.articles, decisions)


@query("q AS (SELECT a.id, a.publish_mode, a.duplicate_of_article_id IS NOT NULL AS dup, EXISTS (SELECT 1 FROM article_tabs b JOIN tabs t ON t.id = b.tab_id AND t.enabled = 1 WHERE b.article_id = a.id) AS ok, (SELECT string_agg(DISTINCT t.name, '、' ORDER BY t.name) FROM article_tabs b JOIN tabs t ON t.id = b.tab_id AND t.enabled = 0 WHERE b.article_id = a.id) AS names FROM articles a) "
       "SELECT id, CASE WHEN dup THEN 'SOURCE_DUPLICATE' WHEN NOT ok THEN 'MAPPING_BLOCKED' ELSE 'PUBLISHING' END AS to_status, CASE WHEN NOT dup AND NOT ok THEN coalesce(names, '') END AS message FROM q", "articles", "article_tabs", "tabs")
def p14_dispositions(v):
    named = v.article_tabs.join(v.tabs.select(F.col("id").alias("tab_id"), "name", "enabled"), "tab_id").groupBy(F.col("article_id").alias("id"))
    per = named.agg(F.collect_set(F.when(F.col("enabled") == 1, F.col("tab_id"))).alias("usable_tabs"), F.array_sort(F.collect_set(F.when(F.col("enabled") == 0, F.col("name")))).alias("dropped_names"))
    queued = v.articles.join(per, "id", "left").select("id", "publish_mode", F.col("duplicate_of_article_id").isNotNull().alias("source_duplicate"), F.lit(None).cast("string").alias("title_outcome"), "usable_tabs", "dropped_names")
    return P.dispositions(queued)


@query("c AS (SELECT id AS cid, unnest([id % 4, id % 7, id % 4]) AS tab_id, generate_subscripts([id % 4, id % 7, id % 4], 1) AS pos FROM articles), d AS (SELECT cid, tab_id, min(pos) AS pos FROM c GROUP BY ALL) "
       "SELECT cid AS id, arg_min(d.tab_id, pos) AS tab_id FROM d JOIN verdicts v ON v.article_id = cid AND d.tab_id % 2 = 0 WHERE belongs AND confidence >= 0.9 GROUP BY cid", "articles", "verdicts")
def j14_fallback_tabs(v):
    offered = v.articles.select("id", F.array(F.col("id") % 4, F.col("id") % 7, F.col("id") % 4).alias("tab_ids"))
    judged = v.verdicts.select(F.col("article_id").alias("id"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in (0, 2, 4, 6)])).alias("tab_id"), "belongs", "confidence")
    return P.fallback_tabs(offered, judged)


@query("SELECT a.id, CASE WHEN bool_or(b.tab_id = 3) THEN CASE WHEN a.tab_id = 3 THEN [3] ELSE [3, a.tab_id] END ELSE [a.tab_id] END AS tab_ids FROM articles a LEFT JOIN article_tabs b ON b.article_id = a.id GROUP BY a.id, a.tab_id", "articles", "article_tabs")
def j16_reassigned_tabs(v):
    return P.reassigned(v.article_tabs, v.articles.select("id", F.col("tab_id").alias("target")), 3)


@query("SELECT doc_id, 0 AS ideographs, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS others, CASE WHEN regexp_matches(text, '\\p{L}') THEN 1.0 ELSE 0.0 END::DOUBLE AS other_ratio FROM documents")
def f9_language_ratio(v):
    ideographs, others, ratio = X.language_ratio(F.col("text"))
    return v.table("documents").select("doc_id", ideographs.alias("ideographs"), others.alias("others"), ratio.cast("double").alias("other_ratio"))


@query("t AS (SELECT id, trim(regexp_replace(title_final, '\\s+', ' ', 'g')) AS x FROM articles) SELECT id, CASE WHEN x = '' THEN ['empty'] ELSE list_filter([CASE WHEN length(x) < 5 THEN 'short' END, CASE WHEN regexp_matches(x, '([,:]|\\.{2,}|…)$') THEN 'cut' END, CASE WHEN regexp_full_match(x, '[^\\p{L}\\p{N}]+') THEN 'symbols' END], lambda y: y IS NOT NULL) END AS problems FROM t", "articles")
def f10_title_problems(v):
    return v.articles.select("id", X.title_problems(F.col("title_final")).alias("problems"))


@query("SELECT id, len(regexp_extract_all(body_html, '[0-9]+([.,:/-][0-9]+)*%?')) AS n_numbers, array_to_string(regexp_extract_all(body_html, '[0-9]+([.,:/-][0-9]+)*%?'), ' ') AS numbers FROM articles", "articles")
def f45_numeric_expressions(v):
    found = X.numbers(F.col("body_html"))
    return v.articles.select("id", F.size(found).alias("n_numbers"), F.array_join(found, " ").alias("numbers"))


@query("k AS (SELECT id, title_final || chr(10) || body_html AS x FROM articles) SELECT id, CASE WHEN contains(x, 'License') THEN 'License' WHEN contains(x, 'rights') THEN 'rights' END AS first_hit, list_filter(['rights', 'License', 'Public'], lambda w: contains(replace(x, 'General Public', ''), w)) AS hits FROM k WHERE contains(x, 'License') OR contains(x, 'rights')", "articles")
def f13_keyword_gates(v):
    text = F.concat_ws("\n", "title_final", "body_html")
    rows = v.articles.select("id", X.first_keyword(text, ["License", "rights"]).alias("first_hit"), X.all_keywords(text, ["rights", "License", "Public"], ["General Public"]).alias("hits"))
    return rows.filter("first_hit is not null")


#: The given texts have no ideographs: fifteen of their letters become some.
_LETTERS, _IDEOGRAPHS = "abcdefghijklmno", "的一是了我不在人们有来他这上着"
_HAN = f"translate(lower({{}}), '{_LETTERS}', '{_IDEOGRAPHS}')"


def han(column: str):
    return F.translate(F.lower(column), _LETTERS, _IDEOGRAPHS)


@query(f"t AS (SELECT id, {_HAN.format('body_html')} AS x FROM articles), n AS (SELECT id, length(regexp_replace(x, '[^一-鿿]', '', 'g')) AS ideographs, length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) AS letters FROM t) "
       "SELECT id, ideographs, letters - ideographs AS others, CASE WHEN letters > 0 THEN (letters - ideographs) / letters ELSE 0 END::DOUBLE AS other_ratio FROM n", "articles")
def f9_ideograph_ratio(v):
    ideographs, others, ratio = X.language_ratio(han("body_html"))
    return v.articles.select("id", ideographs.alias("ideographs"), others.alias("others"), ratio.cast("double").alias("other_ratio"))


_ENDS = "CASE id % 7 WHEN 0 THEN '，' WHEN 1 THEN '…' WHEN 2 THEN '、 ' WHEN 3 THEN ' ：' ELSE '。' END"


@query(f"t AS (SELECT id, trim(regexp_replace(left({_HAN.format('title_final')}, CAST(id % 9 AS INTEGER)) || {_ENDS}, '\\s+', ' ', 'g')) AS x FROM articles) "
       "SELECT id, list_filter([CASE WHEN length(x) < 5 THEN 'short' END, CASE WHEN id % 7 <= 3 THEN 'cut' END, CASE WHEN NOT regexp_matches(x, '[\\p{L}\\p{N}]') THEN 'symbols' END], lambda y: y IS NOT NULL) AS problems FROM t", "articles")
def f10_ideograph_titles(v):
    title = F.concat(F.left(han("title_final"), (F.col("id") % 9).cast("int")), F.expr(_ENDS))
    return v.articles.select("id", X.title_problems(title).alias("problems"))


_DIRT = "CASE id % 12 WHEN 0 THEN '点击购买门票' WHEN 1 THEN '扫码关注' WHEN 2 THEN '优惠活动' WHEN 3 THEN '立即下载' WHEN 4 THEN '加微信' WHEN 5 THEN '本文转自报纸' WHEN 6 THEN '版权归作者' WHEN 7 THEN '未经许可' WHEN 8 THEN '摄影：记者' WHEN 9 THEN '【 图 ：球场】' WHEN 10 THEN '未完待续' ELSE '点击' END"


@query(f"t AS (SELECT id, {_HAN.format('body_html')} || {_DIRT} AS x FROM articles) SELECT id, list_filter([CASE WHEN length(x) < 30 THEN 'short' END, CASE WHEN id % 12 = 10 THEN 'cut' END, CASE WHEN regexp_matches(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'control' END, CASE WHEN id % 12 <= 9 THEN 'dirty:' || (id % 12) END], lambda y: y IS NOT NULL) AS problems FROM t", "articles")
def f11_dirty_bodies(v):
    return v.articles.select("id", X.body_problems(F.concat(han("body_html"), F.expr(_DIRT))).alias("problems"))


@query(f"t AS (SELECT id, {_HAN.format('title_final')} AS x, {_HAN.format('body_html')} AS y FROM articles) SELECT id, CASE WHEN contains(left(y, 40), '在有') THEN '在有' WHEN contains(left(y, 40), '们我') THEN '们我' END AS head_hit, list_filter(['着r', '的', '们我'], lambda w: contains(replace(x, '着r', ''), w)) AS hits FROM t", "articles")
def f12_ideograph_keywords(v):
    hits = X.all_keywords(han("title_final"), ["着r", "的", "们我", "的"], ["着r"])
    return v.articles.select("id", X.first_keyword(han("body_html"), ["在有", "们我"], 40).alias("head_hit"), hits.alias("hits"))


@query("SELECT page_id, CASE WHEN url ~ '^https?://' THEN url ELSE '' END AS absolute, 'https://cdn.example.com/' || ltrim(regexp_replace(url, '^https?://', ''), '/') AS expanded FROM pages")
def f41_cdn_paths(v):
    pages = v.table("pages")
    return pages.select("page_id", X.cdn_url(F.col("url"), "https://cdn.example.com").alias("absolute"), X.cdn_url(F.regexp_replace("url", "^https?://", ""), "https://cdn.example.com/").alias("expanded"))


def bodies(v):
    return v.table("pages").select("page_id", F.col("html").alias("body_html"))


@query()
def f8_plain_text(v):
    return bodies(v).select("page_id", H.text_of("body_html").alias("text"))


@query()
def f21_cleaned_bodies(v):
    return H.cleaned(bodies(v)).select("page_id", "had_links", "had_empty", F.sha2("clean", 256).alias("clean_sha256"), F.char_length("clean").alias("n_chars"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a[\\s>]')) AS n_links FROM pages WHERE regexp_matches(html, '<a[\\s>]')")
def f29_link_counts(v):
    return H.link_table(bodies(v), "page_id").groupBy("page_id").agg(F.count("*").alias("n_links"))


@query()
def f28_block_table(v):
    return H.block_table(bodies(v), "page_id")


@query()
def f35_repeated_blocks(v):
    return H.repeated_blocks(H.block_table(bodies(v), "page_id"), "page_id")
