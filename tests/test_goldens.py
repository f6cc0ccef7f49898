"""Hand-typed cases of the content-operations semantics, and edge cases of the operators."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswork.functions import html as H, promotion as M, quality as Q, text as X
from presswork.operators import dedup as D, guards as G, ingest as I, publish as P, records as K, reports as R, search as S, tags as T
from presswork.streaming import streams as Z


def column(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_uneven_periods(spark):
    got = [(r[0], r[1]) for r in R.periods(spark, date(2026, 9, 17), date(2026, 9, 18), ("11:00", "abc", "25:00", "19:61", "19:00")).orderBy("period_start").collect()]
    assert got == [
        (datetime(2026, 9, 17, 3), datetime(2026, 9, 17, 11)), (datetime(2026, 9, 17, 11), datetime(2026, 9, 18, 3)), (datetime(2026, 9, 18, 3), datetime(2026, 9, 18, 11)),
    ]
    assert R.periods(spark, date(2026, 9, 17), date(2026, 9, 18), ()).count() == 0


@pytest.mark.parametrize("base,hours,want", [(10, 24, 10), (10, 16, 7), (10, 8, 3), (5, 1, 1)])
def test_scaled_thresholds(spark, base, hours, want):
    assert column(spark, float(hours), lambda c: R.scaled(base, c), "double") == want


ARTICLE = "id bigint, source string, status string, created_at timestamp_ntz, duplicate_of_article_id bigint"


def test_sources_without_articles_stay(spark):
    times = [datetime(2026, 9, 17, 11, 30), datetime(2026, 9, 17, 20), datetime(2026, 9, 18, 3, 30)]
    articles = spark.createDataFrame([(i, "a", "PUBLISHED", t, None) for i, t in enumerate(times)], ARTICLE)
    sources = spark.createDataFrame([("a", "A", 1), ("b", "B", 1), ("c", "C", 0)], "code string, display_name string, enabled int")
    spans = spark.createDataFrame([(datetime(2026, 9, 17, 11), datetime(2026, 9, 18, 3))], "period_start timestamp_ntz, period_end timestamp_ntz")
    got = {r["source_code"]: r["total_count"] for r in R.period_stats(articles, sources, spans).collect()}
    assert got == {"a": 2, "b": 0}


@pytest.mark.parametrize("now,before,want", [(5, 0, "new"), (0, 0, "neutral"), (21, 10, "surge"), (1, 10, "critical_drop"), (4, 10, "drop"), (10, 10, "stable"), (7, 10, "normal")])
def test_change_types(spark, now, before, want):
    row = spark.createDataFrame([(now, before)], "a int, b int").select(R.change_type(F.col("a"), F.col("b")).alias("y"))
    assert row.first()["y"] == want


@pytest.mark.parametrize("local,want", [("2026-09-26 19:00", "2026-09-26"), ("2026-09-26 18:59", "2026-09-19"), ("2026-09-27 00:01", "2026-09-26"), ("2026-10-02 23:00", "2026-09-26")])
def test_saturday(spark, local, want):
    utc = f"CAST(TIMESTAMP_NTZ'{local}' - INTERVAL 8 HOURS AS TIMESTAMP_NTZ)"
    assert str(spark.range(1).select(R.saturday_due(F.expr(utc)).alias("y")).first()["y"]) == want


def test_publish_report_counts_distinct_articles(spark):
    at = datetime(2026, 9, 1)
    pairs = spark.createDataFrame([(1, at, "x"), (1, at, "y"), (2, at, "y")], "id bigint, published_at timestamp_ntz, tab string")
    spans = spark.createDataFrame([(at, datetime(2026, 9, 2))], "period_start timestamp_ntz, period_end timestamp_ntz")
    assert {r["tab"]: r["n"] for r in R.publish_report(pairs, spans).collect()} == {"x": 1, "y": 2, "TOTAL": 2}


KBS = "https://news.kbs.co.kr/news/view.do?ncd="


@pytest.mark.parametrize("source,url,want", [
    ("kbs", KBS + "8635111", "kbs:ncd:8635111"), ("KBS", KBS + "008635111&x=1#ncd=2", "kbs:ncd:8635111"), ("nikkan", KBS + "8635111", None), ("kbs", "https://example.com/?ncd=1", None),
    ("kbs", KBS.split("?")[0], None), ("kbs", KBS + "abc", None), ("kbs", KBS + "1&ncd=2", None), ("kbs", KBS + "0", None), (None, None, None),
])
def test_origin_key(spark, source, url, want):
    rows = spark.createDataFrame([(source, url)], "source string, source_url string")
    assert rows.select(I.origin_key().alias("y")).first()["y"] == want


@pytest.mark.parametrize("name,valid,league,team", [("nikkan:fb.jleague.marinos", True, "jleague", "marinos"), ("m:fb._._", True, "", ""), ("m:fb.x", False, "", ""), ("m:fb.l.bad team", True, "l", ""), (None, False, "", ""), ("fb._._", False, "", "")])
def test_markers(spark, name, valid, league, team):
    rows = spark.createDataFrame([(name,)], "user_name string")
    got = rows.select(I.parsed_user_name().alias("y")).first()["y"]
    assert (got["valid"], got["league"], got["team"]) == (valid, league, team)


def test_channel_lists(spark):
    articles = spark.createDataFrame([(1, [111, 999, 999]), (2, [999, 111, 222, 111]), (3, None)], "id bigint, channels array<bigint>")
    tabs = spark.createDataFrame([(1, 1), (2, 348)], "article_id bigint, tab_id bigint")
    allowed = spark.createDataFrame([(348, 111), (348, 222)], "tab_id bigint, channel_id bigint")
    none = spark.createDataFrame([], "channel_id bigint")
    got = {r["id"]: r["channels"] for r in T.filtered_channels(articles, tabs, allowed, none).collect()}
    assert got == {1: [111, 999], 2: [111, 222], 3: []}
    blocked = spark.createDataFrame([(111,)], "channel_id bigint")
    assert {r["id"]: r["channels"] for r in T.filtered_channels(articles, tabs, allowed.limit(0), blocked).collect()} == {1: [999], 2: [999, 222], 3: []}


@pytest.mark.parametrize("old,new,accepted", [((20, 500), (8, 100), False), ((20, 500), (18, 480), True), ((20, 500), (0, 10), False), (None, (5, 5), True)])
def test_acceptance(spark, old, new, accepted):
    schema = "competition_id bigint, team_count bigint, player_count bigint"
    got = T.acceptance(spark.createDataFrame([(1, *new)], schema), spark.createDataFrame([(1, *old)] if old else [], schema)).first()
    assert got["accepted"] == accepted


def test_titles():
    assert D.plain_title("柏4-2町田") == D.plain_title("柏2-4町田") and D.strict_plain_title("柏4-2町田") != D.strict_plain_title("柏2-4町田")
    assert D.plain_title("2026-09-20 赛果") == "20260920赛果" and D.plain_title(None) == "" and D.plain_title("ＡＢ１！") == "ab1"
    a, b = map(D.plain_title, ("日媒：柏4-2逆转町田，町田首败失榜首", "日媒：町田2-4不敌柏，开季8场不败终结"))
    lcs, bigram, char = D.scores(a, b)
    assert char >= D.CHAR_DICE_LEAST and bigram < D.DICE_LEAST and lcs < D.LCS_LEAST
    assert D.common_run("abcde", "xbcdy") == 3 and D.scores("", "a") == (0, 0.0, 0.0)


def test_candidates_and_settlement(spark):
    at = datetime(2026, 9, 1, 12)
    rows = [
        (1, "Alpha wins the final game", [1], 1, at, 1), (2, "Alpha wins the final game!", [1], 2, at, 1), (3, "Something else entirely here", [1], 1, at, 1), (4, "alpha WINS the final match", [], 1, at, 1),
        (5, "Alpha wins the final game", [9], 9, at, 0), (6, "short", [1], 1, at, 1),
    ]
    articles = spark.createDataFrame(rows, "id bigint, title_final string, channels array<bigint>, tab_id bigint, created_at timestamp_ntz, publish_mode int")
    found = D.candidates(articles).cache()
    pairs = {(r["id"], r["older"]): r for r in found.collect()}
    assert pairs[2, 1]["exact"] and pairs[2, 1]["matched_by"] == "channels" and pairs[4, 1]["matched_by"] == "tab"
    assert not any(i in (5, 6) for i, _ in pairs)
    verdicts = spark.createDataFrame([(4, True, 1), (3, False, None)], "candidate_id bigint, duplicate boolean, matched_id bigint")
    got = {r["id"]: (r["outcome"], r["matched"]) for r in D.settled(articles, found, verdicts).collect()}
    assert got[2] == ("duplicate", 1) and got[4] == ("duplicate", 1) and got[1] == ("not_duplicate", None) and got[6] == ("not_duplicate", None) and 5 not in got


def test_candidates_equal_all_pairs(spark):
    """Against every pair, with blocks of two titles, ties, repeated titles, null channels and tabs."""
    words = ["alpha", "beta", "gamma", "delta", "wins", "final", "game"]
    rows = [(i, " ".join(words[(i * k + k) % 7] for k in range(1, 5)), None if i % 11 == 0 else [i % 3, i % 4], None if i % 5 == 0 else i % 2, datetime(2026, 9, 1 + i % 6, i % 24)) for i in range(40)]
    articles = spark.createDataFrame(rows, "id bigint, title_final string, channels array<bigint>, tab_id bigint, created_at timestamp_ntz")
    keys = lambda r: {f"c{c}" for c in r[2] or []} | ({f"t{r[3]}"} if r[3] is not None else set())
    want = set()
    for x in rows:
        found = []
        for y in rows:
            if y[0] < x[0] and y[4].date() <= x[4].date() and (x[4] - y[4]).total_seconds() <= 3 * 86400 and keys(x) & keys(y):
                a, b = D.plain_title(x[1]), D.plain_title(y[1])
                lcs, bigram, char = D.scores(a, b)
                shared = bool(set(x[2] or []) & set(y[2] or []))
                hit = D.strict_plain_title(x[1]) == D.strict_plain_title(y[1]) or bigram >= D.DICE_LEAST or lcs >= D.LCS_LEAST or char >= D.CHAR_DICE_LEAST
                if hit and (shared or not (x[2] and y[2]) or bigram >= D.TAB_DICE_LEAST):
                    short, long = sorted((len(a), len(b)))
                    found.append((-D.lexical_score(lcs / short, lcs / long, bigram, char), y[0], "channels" if shared else "tab"))
        want |= {(x[0], older, by, k) for k, (_, older, by) in enumerate(sorted(found)[: D.TOP], 1)}
    for block in (2, 256):
        assert {(r["id"], r["older"], r["matched_by"], r["rank"]) for r in D.candidates(articles, block=block).collect()} == want
    assert len(want) > 40 and D.candidates(articles.limit(0)).count() == 0


def test_candidates_look_at_few_runs(monkeypatch):
    """Of all pairs of two blocks of titles, runs are looked for in those alone that can be among the best."""
    import random

    import pyarrow as pa

    draw, at = random.Random(5), datetime(2026, 9, 1)
    texts = ["".join(draw.choices("abcdefghijkl", k=draw.choice((9, 60, 350)))) for _ in range(300)]
    texts[250:] = [t[:-3] + "xyz" for t in texts[:30]] + texts[30:50]
    table = lambda ids: pa.table([pa.array(ids), pa.array([at] * len(ids), pa.timestamp("us")), pa.array([["c1"]] * len(ids)), *[pa.array([texts[i] for i in ids])] * 2], ["id", "created_at", "keys", "plain", "strict"])
    places, asked, whole = {i: i for i in range(300)}, [], D.common_run
    monkeypatch.setattr(D, "common_run", lambda *pair: asked.append(pair) or whole(*pair))
    kept = [[] for _ in range(100)]
    D._keep_best(kept, D._Titles(table(range(200, 300)), "c1", places), D._Titles(table(range(200)), "c1", places), True, timedelta(days=3), D.TOP)
    assert len(asked) < 0.2 * 100 * 200
    for i, own in zip(range(200, 300), kept, strict=True):
        want = []
        for j in range(200):
            lcs, bigram, char = D.scores(texts[i], texts[j])
            if texts[i] == texts[j] or bigram >= D.DICE_LEAST or lcs >= D.LCS_LEAST or char >= D.CHAR_DICE_LEAST:
                short, long = sorted((len(texts[i]), len(texts[j])))
                want.append((-D.lexical_score(lcs / short, lcs / long, bigram, char), j))
        assert [x[:2] for x in own] == sorted(want)[: D.TOP]


def test_candidates_compare_earlier_titles_alone(monkeypatch):
    """Titles with a later id are no part of what is compared; long titles are taken few at once."""
    import random

    import pyarrow as pa

    draw, at = random.Random(7), datetime(2026, 9, 1)
    texts = ["".join(draw.choices("abcdefgh", k=20 + i % 40)) for i in range(400)]
    table = lambda ids: pa.table([pa.array(ids), pa.array([at] * len(ids), pa.timestamp("us")), pa.array([["c1"]] * len(ids)), *[pa.array([texts[i] for i in ids])] * 2], ["id", "created_at", "keys", "plain", "strict"])
    places, shapes, whole = {i: i for i in range(400)}, [], D._shared
    monkeypatch.setattr(D, "_shared", lambda mine, theirs, shape: shapes.append(shape) or whole(mine, theirs, shape))
    kept = [[] for _ in range(40)]
    D._keep_best(kept, D._Titles(table(range(60, 100)), "c1", places), D._Titles(table(range(400)), "c1", places), True, timedelta(days=3), D.TOP)
    assert shapes and all(shape == (40, 99) for shape in shapes)
    for i, own in zip(range(60, 100), kept, strict=True):
        all_ = [(D.scores(texts[i], texts[j]), j) for j in range(i)]
        short = lambda j: sorted((len(texts[i]), len(texts[j])))
        assert [x[:2] for x in own] == sorted((-D.lexical_score(s[0] / short(j)[0], s[0] / short(j)[1], *s[1:]), j) for s, j in all_)[: D.TOP]
    monkeypatch.setattr(D, "CHARS_AT_ONCE", 100)
    cut = [t.column("id").to_pylist() for t in D._slices(table(range(50)), 3)]
    assert sum(cut, []) == list(range(50)) and all(len(x) == 1 or (len(x) <= 3 and sum(len(texts[i]) for i in x) <= 100) for x in cut)


def test_runs_under_the_least_are_none():
    """Runs of short, long and repetitive texts, asked for with and without the least that counts."""
    import random

    draw = random.Random(3)
    text = lambda n, k: "".join(draw.choices(["th", "e", "tion", "an", "is", "of", "x1"][:k], k=n))
    for n in range(120):
        a, b = text(draw.choice((5, 40, 200, 400)), draw.choice((1, 3, 7))), text(draw.choice((5, 40, 200, 400)), draw.choice((1, 3, 7)))
        if n % 3 == 0:
            b = b[: len(b) // 2] + a[len(a) // 3 : len(a) // 3 + draw.randrange(1, 200)] + b[len(b) // 2 :]
        short, long = sorted((a, b), key=len)
        run = 0
        for i in range(len(short)):
            while i + run < len(short) and short[i : i + run + 1] in long:
                run += 1
        for least in (0, 1, run - 5, run, run + 1, run + 40):
            for most in (None, run, min(run + 9, len(short))):
                assert D.common_run(a, b, most, least) == (run if run >= least else 0)


def test_candidates_read_titles_once(spark):
    """Titles are read once for both sides (a filter on their length has them normalized before it and after it)."""
    articles = spark.createDataFrame([(1, "Alpha wins the final game", [1], 1, datetime(2026, 9, 1))], "id bigint, title_final string, channels array<bigint>, tab_id bigint, created_at timestamp_ntz")
    plan = D.candidates(articles)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("Scan ExistingRDD") == 2  # the other scan counts articles


def test_recalled_pairs_are_not_shuffled(spark):
    """Every pair once, with several, one or no channel in common, null channels and tabs; nothing gathers the pairs."""
    rows = [(i, None if i % 11 == 0 else [i % 3, i % 4, i % 3], None if i % 5 == 0 else i % 2, datetime(2026, 9, 1 + i % 6, i % 24)) for i in range(60)]
    articles = spark.createDataFrame(rows, "id bigint, channels array<bigint>, tab_id bigint, created_at timestamp_ntz")
    want = []
    for x in rows:
        for y in rows:
            shared = bool(set(x[1] or []) & set(y[1] or []))
            if y[0] < x[0] and y[3].date() <= x[3].date() and x[3] - y[3] <= timedelta(days=3) and (shared or (x[2] is not None and x[2] == y[2])):
                want.append((x[0], y[0], shared))
    found = D.recall_pairs(articles)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len({w[2] for w in want}) == 2
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates_without_an_id(spark):
    rows = [(i, "Alpha wins the final game", [1], 1, datetime(2026, 9, 1)) for i in (None, 1, 2)]
    articles = spark.createDataFrame(rows, "id bigint, title_final string, channels array<bigint>, tab_id bigint, created_at timestamp_ntz")
    assert [(r["id"], r["older"]) for r in D.candidates(articles).collect()] == [(2, 1)]


def test_common_runs_of_long_texts():
    a, b = "".join(chr(97 + i * i % 23) for i in range(900)), "".join(chr(97 + i * i * i % 23) for i in range(700)) + "zz\U0001f600-a run-"
    assert D.common_run(a + "zz\U0001f600-a run", b) == len("zz\U0001f600-a run") and D.common_run("x" * 400, "y" * 500) == 0 and D.common_run("x" * 400, "x" * 500) == 400


def test_guard_asks_and_decides(spark):
    articles = spark.createDataFrame([(1, 0, "", None), (2, 1, "", None), (3, 1, "FR", None), (4, 0, "en", 1), (5, 0, "en", 2), (6, 1, " fr", None), (7, 1, "fr", None), (8, 0, None, None)], "id bigint, configured_mode int, route_league string, route_rule_id bigint")
    tabs = spark.createDataFrame([(1, 1, 1, 1, "d"), (2, 1, 0, 0, "d"), (3, 0, 1, 0, ""), (4, 1, 1, 0, " ")], "id bigint, enabled int, publish_mode int, guard_enabled int, definition string")
    bound = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 4, 5)] + [(1, 2, 0), (3, 4, 0), (3, 2, 1), (6, 2, 0), (7, 1, 0), (8, 4, 0)], "article_id bigint, tab_id bigint, sort_order int")
    rules = spark.createDataFrame([(1, 1), (2, 0)], "id bigint, ai_guard_enabled int")
    asked = G.guard_asks(articles, bound, tabs, rules, ("fr",))
    assert {(r["id"], r["tab_id"], r["in_scope"]) for r in asked.collect()} == {(1, 1, False), (3, 2, True), (4, 1, False), (6, 2, True), (7, 1, True)}
    verdicts = spark.createDataFrame([(1, True, 0.5), (3, False, 0.9), (4, True, 0.9), (6, False, 0.9)], "id bigint, belongs boolean, confidence double")
    choices = spark.createDataFrame([(1, 2, 0.9), (3, None, 0.95), (6, 3, 0.95)], "id bigint, tab_id bigint, confidence double")
    got = {r["id"]: r for r in G.league_guard(asked, verdicts, choices, tabs).collect()}
    assert {i: (r["outcome"], r["effective_mode"], r["final_tab"]) for i, r in got.items()} == {1: ("kept", 0, 1), 3: ("downgraded", 0, 2), 4: ("upgraded", 1, 1), 6: ("reassigned", 0, 3), 7: ("unchecked", 1, 1)}
    assert got[6]["league_guard"]["reassigned_tab_active"] is False and got[3]["league_guard"]["downgraded_from_direct"] and got[4]["league_guard"]["upgraded_to_publish"]


def test_materials_meet_articles_by_key_then_url(spark):
    old, now = datetime(2026, 9, 1), datetime(2026, 9, 2)
    state = spark.createDataFrame(
        [(1, "a", "u1", "k1", "t", "t", "b", 0, "{}", [1], "B", None, "RECEIVED", old, old), (2, "a", "u2", None, "t", "t", "b", 0, "{}", [1], "A", 1, "PUBLISHED", old, old), (3, "a", "u3", " ", "t", "t", "b", 0, "{}", [1], "B", None, "ERROR", old, old)],
        "id bigint, source string, source_url string, origin_key string, title_original string, title string, body string, upstream_archive_id bigint, raw string, tab_ids array<bigint>, level string, publish_mode int, status string, updated_at timestamp_ntz, last_seen_at timestamp_ntz",
    )
    batch = spark.createDataFrame(
        [(1, "A", "u9", "k1", "x", "c", 5, "{1}", [2], False, now), (2, "a", "u2", "k2", "y", "c", 6, "{2}", [2], False, now), (3, "b", "n", "", "1", "c", 0, "", [7], True, now), (4, "b", "n", None, "2", "c", 1, "", [8], False, now), (5, "a", "n", "k5", "3", "c", 0, "", [9], False, now), (6, "a", "m", "k5", "4", "c", 0, "", [1], False, now)],
        "seq bigint, source string, source_url string, origin_key string, title string, body string, upstream_archive_id bigint, raw string, tab_ids array<bigint>, abandoned boolean, seen_at timestamp_ntz",
    )
    got = {(r["id"], r["source"], r["source_url"]): r for r in I.upserted(state, batch).collect()}
    seen = {k: (r["title"], r["title_original"], r["status"], r["upstream_archive_id"], r["tab_ids"], r["updated_at"] == now, r["last_seen_at"] == now) for k, r in got.items()}
    assert seen == {
        (1, "a", "u1"): ("x", "x", "RECEIVED", 5, [1], True, True), (2, "a", "u2"): ("t", "y", "PUBLISHED", 6, [1], False, True), (3, "a", "u3"): ("t", "t", "ERROR", 0, [1], False, False),
        (None, "b", "n"): ("1", "2", "ABANDONED", 1, [7], True, True), (None, "a", "n"): ("4", "4", "RECEIVED", 0, [9], True, True),
    }
    assert got[None, "b", "n"]["publish_mode"] == 2 and got[2, "a", "u2"]["level"] == "A"
    assert I.upserted(state, batch.limit(0)).count() == 3 and I.upserted(state.limit(0), batch).count() == 4


def test_language_ratio_by_code_point(spark):
    row = spark.createDataFrame([("中文𠀀abc é1",)], "x string").select(*X.language_ratio(F.col("x"))).first()
    assert tuple(row)[:2] == (3, 4)


@pytest.mark.parametrize("title,want", [(None, ["empty"]), ("  ", ["empty"]), ("abc", ["short"]), ("long enough...", ["cut"]), ("标题很长的，", ["cut"]), ("！！！！！！", ["symbols"]), ("a good title", [])])
def test_title_problems(spark, title, want):
    assert column(spark, title, X.title_problems) == want


def test_html_functions():
    body = '<p>Keep <a href="x">drop <img src="i.png"> this</a> tail &amp; more</p><p> <br></p><script>no()</script>'
    assert H.to_text(body) == "Keep drop this tail & more" and H.to_text(None) == ""
    clean = H.without_links(body)
    assert "drop" not in clean and '<img src="i.png">' in clean and H.without_links(clean) == clean
    assert H.without_links("<p><a href='x'>open stays</p>") == "<p>open stays</p>"
    assert H.without_empty_blocks("<div><p> &nbsp;</p></div><p>x</p>") == "<p>x</p>"
    assert H.links(body) == [("x", "drop this", 1)]
    assert [b[2] for b in H.blocks("<h1>A</h1><p>B<p>C</p>")] == ["A", "B", "C"]


def test_tail_rules_need_an_unbroken_tail(spark):
    body = "<p>更多球队消息</p><p>Some real text here.</p><p>点击查看比赛详情</p><p>更多新闻</p><p>前文</p>"
    rows = spark.createDataFrame([(1, body), (2, None), (3, "")], "id bigint, body_html string")
    got = [(r["id"], r["text"]) for r in M.promotional_blocks(rows, "id").orderBy("pos").collect()]
    assert got == [(1, "点击查看比赛详情"), (1, "更多新闻"), (1, "前文")]


def test_accounts_fill_the_least_used(spark):
    accounts = spark.createDataFrame([(1, 1, 3), (2, 1, 0), (3, 0, 0), (4, 1, 1)], "id bigint, enabled int, assignment_count bigint")
    articles = spark.range(10, 17)
    got = [r["account_id"] for r in P.assigned_accounts(articles, accounts).orderBy("id").collect()]
    used, want = {1: 3, 2: 0, 4: 1}, []
    for _ in got:
        least = min(used, key=lambda a: (used[a], a))
        used[least] += 1
        want.append(least)
    assert got == want
    assert P.assigned_accounts(articles, accounts.filter("enabled = 0")).count() == 0
    assert P.assigned_accounts(articles.limit(0), accounts).count() == 0


def test_business_days_are_half_open(spark):
    rows = spark.createDataFrame([(datetime(2026, 9, 8, 10, 59, 59), "view"), (datetime(2026, 9, 8, 11), "view")], "ts timestamp_ntz, event_type string")
    got = [r["day_start"] for r in Z.daily_counts(rows).orderBy("day_start").collect()]
    assert got == [datetime(2026, 9, 7, 11), datetime(2026, 9, 8, 11)]


@pytest.mark.parametrize("text,rule", [
    ("请点击查看完整赛程。", "standalone_call_to_action"), ("扫码关注获取优惠", "standalone_call_to_action"), ("更多内容请点击这里", "standalone_link_prompt"), ("合作咨询：ad@x.co.kr", "standalone_cooperation_contact"),
    ("合作联系 他们的未来", None), ("点击进入官方频道收听完整节目", "standalone_media_call_to_action"), ("欢迎加入我们的WhatsApp频道获取最新消息", "standalone_channel_call_to_action"), ("转会中心：", "standalone_feed_marker"),
    ("更多球队动态", "standalone_more_news_cta"), ("🎧 收听ge足球播客 🎧", "standalone_branded_podcast_prompt"), ("✅ 观看更多：在Globo了解全部内容", "standalone_branded_watch_prompt"), ("球队查看了赛程", None), ("点击" + "长" * 200 + "详情", None),
])
def test_rules_of_promotion(spark, text, rule):
    assert column(spark, text, M.rule_of) == rule


@pytest.mark.parametrize("quality,passes", [
    ('{"pass":true,"needs_review":false,"decision":"clean","issues":%s}', True), ('{"pass":true,"needs_review":false,"decision":null,"issues":%s,"repair_plans":[]}', True), ('{"pass":"true","needs_review":false,"issues":%s}', False),
    ('{"pass":true,"issues":%s}', False), ('{"pass":true,"needs_review":false,"repair_plans":[{"a":1}],"issues":%s}', False), ('{"pass":true,"needs_review":false,"repair_plan_error":"x","issues":%s}', False),
    ('{"pass":true,"needs_review":false,"decision":"repairable","issues":%s}', False), ('{"pass":true,"needs_review":false,"issues":{}}', False), ("not json", False), (None, False),
])
def test_strict_pass(spark, quality, passes):
    lists = '{"title_problems":[],"dirty_content":[ ],"completeness_problems":[],"channel_problems":[],"semantic_problems":[]}'
    good = quality % lists if quality and "%s" in quality else quality
    one = good.replace('"dirty_content":[ ]', '"dirty_content":["x"]') if good else good
    null = good.replace('"semantic_problems":[]', '"semantic_problems":null') if good else good
    rows = spark.createDataFrame([(1, good), (2, one), (3, null)], "id bigint, quality string")
    assert [r["id"] for r in S.strictly_passing(rows).collect()] == ([1] if passes else [])


@pytest.mark.parametrize("answer,valid", [
    ('{"belongs":true,"confidence":0.9}', True), ('{"belongs":false,"confidence":1}', True), ('{"belongs":true,"confidence":0.9,"matched_id":7}', True), ('{"belongs":true,"confidence":0.9,"matched_id":null}', True),
    ('{"belongs":true,"confidence":0.9,"matched_id":8}', False), ('{"belongs":"true","confidence":0.9}', False), ('{"belongs":true,"confidence":true}', False), ('junk {"belongs":true,"confidence":0.9}', False), (None, False),
])
def test_valid_answers(spark, answer, valid):
    rows = spark.createDataFrame([(1, answer, [7])], "id bigint, answer string, offered array<bigint>")
    got = K.valid_verdicts(rows, "offered").first()
    assert got["valid"] == valid and (got["belongs"] is not None) == valid and (got["confidence"] is not None) == valid


@pytest.mark.parametrize("name,want", [
    ("日职联J1联赛 第3轮", "日职联"), ("南美解放者杯", "解放者杯"), ("ＰＯＷＥＲ ＷＯＲＫ ＣＵＰ 2025/26赛季", "POWER WORK杯"), ("非赛事（转会）", "非赛事"), ("总决赛", ""), ("世界杯预选赛", "世界杯预选赛"), ("亚冠", "亚冠"), (None, ""), ("亚冠2和日职联", "亚冠2和日职联"),
])
def test_competition_names(spark, name, want):
    rows = spark.createDataFrame([(name, ["日职联", "亚冠精英", "亚冠2", " "])], "x string, known array<string>")
    assert Q.competition_names(rows, "x", "known").first()["competition"] == want


def test_alerts_cool_down_over_midnight(spark):
    ends = [datetime(2026, 9, 8, 23, 50), datetime(2026, 9, 9, 0, 5), datetime(2026, 9, 9, 0, 19), datetime(2026, 9, 9, 0, 20), datetime(2026, 9, 9, 9)]
    bursts = spark.createDataFrame([(e, e, 3) for e in ends], "start timestamp_ntz, end timestamp_ntz, n bigint")
    assert sorted(r["alert_at"] for r in Z.alerts(bursts).collect()) == [ends[0], ends[3], ends[4]]
    assert Z.alerts(bursts.limit(0)).count() == 0


def test_alerts_cool_down(spark):
    ends = [datetime(2026, 9, 8, 1, m) for m in (0, 5, 25, 30, 40)]
    bursts = spark.createDataFrame([(e, e, 3) for e in ends], "start timestamp_ntz, end timestamp_ntz, n bigint")
    assert sorted(r["alert_at"] for r in Z.alerts(bursts).collect()) == [ends[0], ends[3]]


def test_rejects_have_reasons(spark):
    rows = [("s", "u", " t ", "b", "7", "", "n", "", "[1, 2]"), ("s", " ", "t", "b", None, "", "", "", None), ("s", "u", "t", "b", "x", "", "", "", None), ("s", "u", "t", "b", "", "", "", "", "{}"), ("s", "u", "t", "b", "", "", "", "", '["a"]')]
    items = spark.createDataFrame(rows, "source string, source_url string, translate_title string, translate_body string, archive_id string, user_name string, username string, dqd_litpic string, channels string")
    good, bad = I.normalized(items)
    assert [(r["title"], r["user_name"], r["archive_id"], r["channels"]) for r in good.collect()] == [("t", "n", 7, [1, 2])]
    assert sorted(r["reason"] for r in bad.collect()) == ["archive_id is no integer", "channel is no integer", "channels is no array", "missing mandatory field"]
