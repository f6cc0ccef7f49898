"""The content-operations tables as views over the given ones, for the registered queries.

Each view is defined once as SQL that Spark and DuckDB both run, so a query and its equivalent start from the same
rows. ``{...}`` marks where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What differs between the dialects.
SPARK = {
    "plus": lambda t, s: f"timestampadd(SECOND, CAST({s} AS INT), {t})",
    "ts": lambda x: f"TIMESTAMP_NTZ '{x}'",
    "json": lambda c, k: f"get_json_object({c}, '$.{k}')",
    "array": lambda *x: f"array({', '.join(x)})",
    "str": lambda x: f"CAST({x} AS STRING)",
    "line": lambda x: f"split_part({x}, '\\n', 1)",
}
DUCK = {
    "plus": lambda t, s: f"({t} + to_seconds({s}))",
    "ts": lambda x: f"TIMESTAMP '{x}'",
    "json": lambda c, k: f"json_extract_string({c}, '$.{k}')",
    "array": lambda *x: f"[{', '.join(x)}]",
    "str": lambda x: f"CAST({x} AS VARCHAR)",
    "line": lambda x: f"split_part({x}, chr(10), 1)",
}


def definitions(d: dict) -> dict[str, str]:
    """View name -> SELECT in the dialect, in an order in which each uses earlier ones alone."""
    created = d["plus"](d["ts"]("2024-01-01 00:00:00"), "(doc_id * 7919) % 2592000")
    status = (
        "CASE WHEN doc_id % 10 <= 3 THEN 'PUBLISHED' WHEN doc_id % 10 <= 5 THEN 'DRAFT_CREATED' WHEN doc_id % 10 <= 7 THEN 'NEEDS_REVIEW' "
        "WHEN doc_id % 10 = 8 THEN 'ABANDONED' ELSE 'PUBLISH_FAILED' END"
    )
    quality = (
        "'{\"pass\":' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || ',\"regional_sensitive\":' || CASE WHEN doc_id % 13 = 0 THEN 'true' ELSE 'false' END "
        "|| ',\"decision\":\"' || CASE WHEN doc_id % 3 = 0 THEN 'clean' WHEN doc_id % 3 = 1 THEN 'repairable' ELSE 'manual_review' END "
        "|| '\"' || CASE WHEN doc_id % 21 = 0 THEN '' WHEN doc_id % 3 = 0 THEN ',\"needs_review\":false' ELSE ',\"needs_review\":true' END || CASE WHEN doc_id % 33 = 0 THEN ',\"repair_plan_error\":\"bad plan\"' ELSE '' END "
        "|| ',\"issues\":{\"title_problems\":[' || CASE WHEN doc_id % 12 = 4 THEN '\"cut\"' ELSE '' END || '],\"dirty_content\":[' || CASE WHEN doc_id % 12 = 7 THEN '\"广告\"' WHEN doc_id % 12 = 10 THEN '\"residue\"' ELSE '' END "
        "|| '],\"completeness_problems\":[' || CASE WHEN doc_id % 15 = 8 THEN '\"short\"' ELSE '' END || '],\"channel_problems\":[' || CASE WHEN doc_id % 45 = 9 THEN '\"missing\"' ELSE '' END || ']' "
        "|| CASE WHEN doc_id % 27 = 0 THEN '' WHEN doc_id % 3 = 2 THEN ',\"semantic_problems\":[\"unsure\"]' ELSE ',\"semantic_problems\":[]' END || '}' "
        f"|| ',\"reason\":\"' || CASE WHEN doc_id % 5 = 0 THEN 'model timeout' ELSE 'rules' END || '\",\"league_guard\":{{\"actual_competition\":\"' || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 23 = 5 THEN '非赛事' WHEN doc_id % 31 < 9 THEN 'NATION_' || {d['str']('doc_id % 31')} ELSE 'C' || {d['str']('doc_id % 31')} END "
        "|| '\",\"configured_publish_mode\":' || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '0' END || ',\"effective_publish_mode\":' || CASE WHEN doc_id % 6 = 0 THEN '1' ELSE '0' END "
        "|| CASE WHEN doc_id % 7 = 0 THEN ',\"reassigned_tab_active\":false' WHEN doc_id % 7 = 1 THEN ',\"reassigned_tab_active\":true' ELSE '' END "
        f"|| CASE WHEN doc_id % 7 <= 1 THEN ',\"reassigned_tab_id\":4,\"tab_name\":\"NATION_3\",\"fallback_tab_name\":\"NATION_3\"' ELSE ',\"tab_name\":\"NATION_' || {d['str']('doc_id % 8')} || '\"' END "
        f"|| CASE WHEN doc_id % 7 = 0 THEN ',\"reason\":\"AI 判断本篇不属于「NATION_' || {d['str']('doc_id % 5')} || '」，已改挂\"' ELSE ',\"reason\":\"kept\"' END "
        "|| CASE WHEN doc_id % 19 = 0 THEN ',\"guard_tab_name\":\"NATION_5\"' ELSE '' END || CASE WHEN doc_id % 8 = 3 THEN ',\"downgraded_from_direct\":true' ELSE '' END || '}}'"
    ).replace("{{", "{").replace("}}", "}}")
    return {
        "articles": f"""
            SELECT doc_id + 1 AS id, source, 'https://' || source || '.example.com/a/' || {d['str']('doc_id')} AS source_url,
                   {d['line']('text')} AS title_final, text AS body_html, {status} AS status,
                   CASE WHEN doc_id % 10 <= 3 THEN 1 ELSE 0 END AS publish_mode,
                   CASE WHEN doc_id % 17 = 0 AND doc_id > 0 THEN doc_id END AS duplicate_of_article_id,
                   (doc_id + 1) % 12 + 1 AS tab_id, {created} AS created_at,
                   CASE WHEN doc_id % 10 <= 3 THEN {d['plus'](created, '3600')} END AS published_at,
                   {d['plus'](created, '7200')} AS updated_at,
                   {d['array']('doc_id % 7', 'doc_id % 11', 'doc_id % 7')} AS channels,
                   'm:fb.' || lang || '.t' || {d['str']('doc_id % 9')} AS user_name,
                   CASE WHEN doc_id % 10 = 9 THEN CASE doc_id % 3 WHEN 0 THEN 'upstream timeout while posting the article to the backend service' WHEN 1 THEN 'login expired' ELSE 'bad image' END END AS error,
                   {quality} AS quality, CASE WHEN doc_id % 29 = 0 THEN doc_id % 50 ELSE 0 END AS upstream_archive_id,
                   CASE WHEN doc_id % 10 <= 5 THEN doc_id + 100000 END AS backend_archive_id
            FROM documents""",
        "sources": "SELECT DISTINCT source AS code, upper(source) AS display_name, CASE WHEN source = 'src3' THEN 0 ELSE 1 END AS enabled, CASE WHEN source = 'src5' THEN 1 WHEN source = 'src6' THEN 0 END AS publish_mode_override FROM documents UNION ALL SELECT 'src_dead', 'SRC_DEAD', 1, NULL",
        "tabs": "SELECT n_nationkey + 1 AS id, CASE WHEN n_nationkey = 0 THEN 58 ELSE n_nationkey + 300 END AS backend_tab_id, n_name AS name, CASE WHEN n_nationkey % 5 <> 4 THEN 1 ELSE 0 END AS enabled, n_nationkey % 2 AS publish_mode, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS guard_enabled, CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE 'news about ' || n_name END AS definition FROM nation",
        "article_tabs": "SELECT id AS article_id, id % 12 + 1 AS tab_id, 0 AS sort_order FROM articles UNION ALL SELECT id, id % 5 + 13, 1 FROM articles WHERE id % 3 = 0",
        "event_tab_rules": """SELECT * FROM (VALUES (1, CAST(NULL AS {S}), 'league', 'en', 3, CAST(NULL AS INT), 1), (2, NULL, 'league', 'fr', 4, 1, 1), (3, NULL, 'league', 'de', NULL, 2, 1),
            (4, NULL, 'team', 't1', 5, NULL, 1), (5, 'src1', 'league', 'en', 7, 0, 1), (6, NULL, 'team', 't2', 6, NULL, 0), (7, NULL, 'team', 't4', NULL, NULL, 1), (8, 'src2', 'team', 't1', 1, NULL, 1))
            AS r(id, source_code, marker_type, marker_code, tab_id, publish_mode_override, enabled)""".replace("{S}", "STRING" if d is SPARK else "VARCHAR"),
        "article_events": "SELECT event_id AS id, user_id + 1 AS article_id, CASE event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'QUALITY_CHECKING' WHEN 'click' THEN 'READY_TO_PUBLISH' WHEN 'purchase' THEN 'PUBLISHED' ELSE 'PUBLISH_FAILED' END AS to_status, event_type, ts AS created_at FROM events",
        "click_events": f"SELECT event_id, ts AS proc_time, coalesce({d['json']('props', 'k')}, '') AS league_name FROM events WHERE event_type = 'view'",
        "seasons": "SELECT o_orderkey AS id, o_custkey % 25 AS competition_id, o_orderdate AS start_date FROM orders",
        "season_teams": "SELECT DISTINCT l_orderkey AS season_id, l_suppkey AS team_id FROM lineitem",
        "teams": "SELECT s_suppkey AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'national' ELSE 'club' END AS type, CASE WHEN s_nationkey % 7 = 0 THEN 'youth' ELSE 'default' END AS team_type, s_suppkey % 11 = 0 AS deleted FROM supplier",
        "team_persons": "SELECT DISTINCT l_suppkey AS team_id, l_partkey AS person_id FROM lineitem",
        "channels": "SELECT p_partkey + 1000000 AS id, p_partkey AS backend_id, 'Player' AS relate_type FROM part UNION ALL SELECT s_suppkey, s_suppkey, 'Team' FROM supplier",
        "publish_accounts": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 1 ELSE 0 END AS enabled, s_nationkey AS assignment_count FROM supplier",
        "verdicts": "SELECT doc_id + 1 AS article_id, quality = 1 AS belongs, CAST(CASE WHEN doc_id % 4 = 0 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS confidence, toxic FROM labels",
    }


#: The given tables that each view reads.
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
VIEWS = tuple(definitions(SPARK))


class Views:
    """The views of one folder of tables, as DataFrames: ``Views(spark, sf_dir).articles``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._sql = spark, sf_dir, definitions(SPARK)

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._sql:
            raise AttributeError(name)
        sql = self._sql[name]
        words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
        inner = {t: self.table(t) for t in TABLES if t in words and t not in self._sql}
        inner |= {v: getattr(self, v) for v in self._sql if v in words and v != name and f"FROM {v}" in sql}
        for t in inner:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        if not inner:
            return self._spark.sql(sql)
        return self._spark.sql(_escape(sql, inner), **inner)


def _escape(sql: str, inner: dict) -> str:
    """Braces of JSON texts doubled, those of table names not."""
    out = sql.replace("{", "{{").replace("}", "}}")
    for t in inner:
        out = out.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    return out


def duck(body: str, *names: str) -> str:
    """``body`` with the named views (and those that they use) in front."""
    sql = definitions(DUCK)
    need = set(names)
    for v in reversed(sql):
        if v in need:
            need |= {u for u in sql if u != v and f"FROM {u}" in sql[v]}
    return "WITH " + ",\n".join(f"{v} AS ({sql[v]})" for v in sql if v in need) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body
