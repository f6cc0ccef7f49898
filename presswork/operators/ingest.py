"""Ingest operators: normalization, identities, merges and routing of material."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.sinks import written

#: Markers that say nothing. Fixed values.
EMPTY_MARKERS = ("", "_", "xxx", "null", "none")
GENERIC_TAB = 58


def feed_items(pages: DataFrame) -> DataFrame:
    """Items of feed pages: an error page (code other than 0) has none."""
    return pages.filter(F.coalesce("code", F.lit(0)) == 0).select(F.explode("data.items").alias("item")).select("item.*")


def _blank(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalized(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): trimmed mandatory fields, an integer archive id, channels as an array of integers."""
    raw = F.from_json("channels", "array<string>")
    rows = items.withColumns({
        "source": _blank("source"), "source_url": _blank("source_url"), "title": _blank("translate_title"), "body": _blank("translate_body"),
        "user_name": F.trim(F.coalesce(F.nullif("user_name", F.lit("")), "username", F.lit(""))),
        "_archive": F.coalesce(F.nullif(F.trim("archive_id"), F.lit("")), F.lit("0")), "_raw": raw,
    })
    missing = F.col("source").isNull() | F.col("source_url").isNull() | F.col("title").isNull() | F.col("body").isNull()
    whole = F.forall(F.coalesce("_raw", F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike(r"^\s*[-+]?\d+\s*$"), F.lit(False)))
    reason = (
        F.when(missing, "missing mandatory field").when(~F.col("_archive").rlike(r"^[-+]?\d+$"), "archive_id is no integer")
        .when(F.col("channels").isNotNull() & (F.trim("channels") != "") & F.col("_raw").isNull(), "channels is no array").when(~whole, "channel is no integer")
    )
    rows = rows.withColumn("reason", reason)
    channels = F.array_distinct(F.transform(F.coalesce("_raw", F.array().cast("array<string>")), lambda x: F.trim(x).cast("bigint")))
    accepted = rows.filter("reason is null").select("source", "source_url", "title", "body", "user_name", F.col("_archive").cast("bigint").alias("archive_id"), channels.alias("channels"))
    return accepted, rows.filter("reason is not null").select("source", "source_url", "reason")


def origin_key(source: str = "source", url: str = "source_url", of: str = "kbs", host: str = "news.kbs.co.kr", parameter: str = "ncd") -> Column:
    """A source's exact id in its URL, if it has one digit-only value there."""
    u = F.trim(F.col(url))
    values = F.regexp_extract_all(F.concat(F.lit("&"), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)), F.lit(rf"&{parameter}=([^&]*)"), 1)
    number = F.regexp_replace(F.get(values, 0), "^0+", "")
    good = (
        (F.lower(F.trim(F.col(source))) == of) & u.rlike(r"^(?i)https?://") & (F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]*)", 1)) == host)
        & (F.size(values) == 1) & F.get(values, 0).rlike("^[0-9]+$") & (number != "")
    )
    return F.when(good, F.concat(F.lit(f"{of}:{parameter}:"), number))


def marker(part: Column) -> Column:
    low = F.lower(F.trim(part))
    return F.when(low.isin(*EMPTY_MARKERS) | ~low.rlike(r"^[a-z0-9][a-z0-9_-]{0,79}$"), "").otherwise(low)


def parsed_user_name(name: str = "user_name") -> Column:
    """struct(valid, media, sport, league, team) of ``media:sport.league.team``."""
    raw = F.trim(F.coalesce(F.col(name), F.lit("")))
    media, marks = F.split_part(raw, F.lit(":"), F.lit(1)), F.regexp_extract(raw, r"(?s)^[^:]*:(.*)$", 1)
    parts = F.split(marks, r"\.")
    valid = (raw != "") & (F.length(raw) <= 500) & raw.contains(":") & (F.trim(media) != "") & (F.size(parts) == 3)
    part = lambda i: F.when(valid, marker(F.coalesce(F.get(parts, i), F.lit("")))).otherwise("")
    return F.struct(valid.alias("valid"), F.when(valid, F.substring(F.lower(F.trim(media)), 1, 100)).otherwise("").alias("media"), part(0).alias("sport"), part(1).alias("league"), part(2).alias("team"))


def canonical(articles: DataFrame, key: str = "identity") -> DataFrame:
    """Each article's canonical one among those of its identity, and whether it is a duplicate of it.

    First what is assigned already, then what has an archive id, an upstream id, the better status, the lower id.
    The least is found by partial sums of each task, so copies by the million are no task's; an article without an
    identity is its own canonical one.
    """
    rank = F.when(F.col("status") == "PUBLISHED", 0).when(F.col("status") == "DRAFT_CREATED", 1).otherwise(2)
    order = F.struct(
        F.col("duplicate_of_article_id").isNotNull().alias("a"), F.col("backend_archive_id").isNull().alias("b"), (F.coalesce("upstream_archive_id", F.lit(0)) <= 0).alias("c"), rank.alias("d"), "id"
    )
    best = articles.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order)["id"].alias("canonical_id"))
    found = articles.join(best, key, "left").withColumn("canonical_id", F.coalesce("canonical_id", "id"))
    return found.select("id", key, "canonical_id", (F.col("id") != F.col("canonical_id")).alias("is_duplicate"))


def routed(materials: DataFrame, rules: DataFrame, tabs: DataFrame, source_tabs: DataFrame) -> DataFrame:
    """The tabs of each material: those of its best rule, or else of its source.

    Team before league, the source's own rule before a global one, the lower id before the higher; a rule counts if
    it is enabled and either bound to an enabled tab or one that abandons (mode 2). A matching rule replaces all of
    the source's tabs but the generic one.
    """
    usable = tabs.filter("enabled = 1").select(F.col("id").alias("tab_id"), F.lit(True).alias("bound"))
    live = rules.filter("enabled = 1").join(usable, "tab_id", "left").filter((F.col("bound")) | (F.col("publish_mode_override") == 2))
    marks = materials.select("id", "source", F.explode(F.array(F.struct(F.lit("team").alias("t"), F.col("team").alias("c")), F.struct(F.lit("league").alias("t"), F.col("league").alias("c")))).alias("m"))
    marks = marks.filter("m.c <> ''").select("id", "source", F.col("m.t").alias("marker_type"), F.col("m.c").alias("marker_code"))
    found = marks.join(live.withColumnRenamed("id", "rule_id"), ["marker_type", "marker_code"]).filter("source_code is null or source_code = source")
    order = F.struct((F.col("marker_type") != "team").alias("a"), F.col("source_code").isNull().alias("b"), F.col("rule_id").alias("c"))
    best = found.groupBy("id").agg(F.min_by(F.struct("rule_id", "marker_type", "tab_id", "publish_mode_override"), order).alias("rule"))
    own = source_tabs.join(tabs.select(F.col("id").alias("tab_id"), "backend_tab_id"), "tab_id")
    own = own.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("sort_order", "tab_id", "backend_tab_id"))).alias("own"))
    joined = materials.join(best, "id", "left").join(own, "source", "left")
    ids = lambda c: F.transform(c, lambda x: x["tab_id"])
    mine = F.coalesce("own", F.array().cast("array<struct<sort_order:int,tab_id:int,backend_tab_id:int>>"))
    generic = ids(F.filter(mine, lambda x: x["backend_tab_id"] == GENERIC_TAB))
    target = F.array(F.col("rule.tab_id"))
    replace = F.col("rule").isNotNull() & ~F.coalesce(F.col("rule.publish_mode_override") == 2, F.lit(False))
    return joined.select(
        "id", F.coalesce("rule.marker_type", F.lit("source")).alias("match_type"), F.col("rule.rule_id").alias("rule_id"),
        F.when(replace, F.array_union(generic, target)).otherwise(ids(mine)).alias("tab_ids"),
        F.coalesce(F.col("rule.publish_mode_override") == 2, F.lit(False)).alias("abandoned"),
    )


def observed(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """Rules after new materials: unknown leagues become pending global rules, first and last sight move."""
    leagues = seen.filter("league <> ''").groupBy(F.lit("league").alias("marker_type"), F.col("league").alias("marker_code")).agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.min_by("source", F.struct("created_at", "id")).alias("sample_source")
    )
    known = rules.filter("source_code is null").select("marker_type", "marker_code", F.col("id").alias("rule_id"))
    return leagues.join(known, ["marker_type", "marker_code"], "left").select("marker_type", "marker_code", "rule_id", F.col("rule_id").isNull().alias("pending"), "first_seen", "last_seen", "sample_source")


def first_sights(rows: DataFrame) -> DataFrame:
    """seq and leader of materials (seq, name, mark, source, source_url) that come one after the other and start articles.

    A material belongs to the article with its key (name and mark), else to the one with its source and URL, else it starts
    one itself; an article has the key and the URL of the material that started it, so what belongs to it lends it neither.
    Whether a material starts an article may hang on whether an earlier one does: in each round the first undecided of a
    key and URL are decided, by counts of keys and URLs and two joins, and are written; chains end after as many rounds
    as they have links, nothing is gathered.
    """
    undecided = written(rows.select("seq", "name", "mark", "source", "source_url", F.lit(False).alias("leads")), "undecided")
    leaders, out = undecided.limit(0), []
    while undecided.limit(1).count():
        held = undecided.unionByName(leaders)
        keys = held.filter("mark is not null").groupBy("name", "mark").agg(F.min(F.struct("seq", "leads")).alias("by_key"))
        urls = held.groupBy("source", "source_url").agg(F.min(F.struct("seq", "leads")).alias("by_url"))
        met = undecided.join(keys, ["name", "mark"], "left").join(urls, ["source", "source_url"])
        own_key = F.col("mark").isNull() | (F.col("by_key.seq") == F.col("seq"))
        leads = own_key & (F.col("by_url.seq") == F.col("seq"))
        leader = F.when(leads, F.col("seq")).when(~own_key & F.col("by_key.leads"), F.col("by_key.seq")).when(own_key & F.col("by_url.leads"), F.col("by_url.seq"))
        judged = written(met.select("seq", "name", "mark", "source", "source_url", leader.alias("leader")), "judged")
        out.append(judged.filter("leader is not null").select("seq", "leader"))
        leaders = leaders.unionByName(judged.filter("leader = seq").drop("leader").withColumn("leads", F.lit(True)))
        undecided = judged.filter("leader is null").drop("leader").withColumn("leads", F.lit(False))
    return reduce(DataFrame.unionByName, out) if out else undecided.select("seq", F.col("seq").alias("leader"))


def upserted(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The articles after a batch of materials, the new ones without an id.

    A material is that of the article with its origin key (source without case), else of the one with its source and
    URL; materials that no article has are matched to the articles that earlier ones of the batch start (``first_sights``). The first fixes
    source, URL, routing and status (ABANDONED, with mode 2, where its rule says so), the last the content. Content of
    an article moves, and with it ``updated_at``, only while it is RECEIVED or ERROR; the original title, the archive
    id, the raw record and the last sight always do; the routing of a known article never does.

    state: id, source, source_url, origin_key, title_original, title, body, upstream_archive_id, raw, tab_ids, level,
    publish_mode, status, updated_at, last_seen_at. batch: seq, source, source_url, origin_key, title, body,
    upstream_archive_id, raw, tab_ids, abandoned, seen_at. Blank origin keys are none.
    """
    name, mark = F.lower("source").alias("_name"), F.nullif(F.trim("origin_key"), F.lit("")).alias("_mark")
    least = lambda rows, c, to: (  # noqa: E731  the first article or material of each key and of each URL
        rows.select(name, mark, c).filter("_mark is not null").groupBy("_name", "_mark").agg(F.min(c).alias(f"{to}_by_key")),
        rows.groupBy("source", "source_url").agg(F.min(c).alias(f"{to}_by_url")),
    )
    find = lambda rows, firsts: rows.join(firsts[0], ["_name", "_mark"], "left").join(firsts[1], ["source", "source_url"], "left")
    known = find(batch.select("*", name, mark), least(state, "id", "known")).withColumn("id", F.coalesce("known_by_key", "known_by_url"))
    # a material that has the URL of a known article may have the key of one that the batch has started before it
    new = known.filter("id is null").select("seq", F.col("_name").alias("name"), F.col("_mark").alias("mark"), "source", "source_url")
    sights = first_sights(new)
    started = new.join(sights.filter("leader = seq").select("seq"), "seq").filter("mark is not null").select(F.col("name").alias("_name"), F.col("mark").alias("_mark"), F.col("seq").alias("_started"))
    met = known.join(sights, "seq", "left").join(started, ["_name", "_mark"], "left")
    moved = F.col("id").isNotNull() & F.col("known_by_key").isNull() & (F.col("_started") < F.col("seq"))
    met = met.withColumn("leader", F.when(moved, F.col("_started")).when(F.col("id").isNull(), F.col("leader"))).withColumn("id", F.when(~F.coalesce(moved, F.lit(False)), F.col("id")))
    content = F.struct("title", "body")
    folded = met.groupBy("id", "leader").agg(
        F.min_by(F.struct("source", "source_url", "origin_key", "tab_ids", "abandoned", content.alias("content"), "seen_at"), "seq").alias("a"),
        F.max_by(F.struct(content.alias("content"), "title", "upstream_archive_id", "raw", "seen_at"), "seq").alias("z"),
    )
    joined = state.alias("s").join(folded.alias("f"), F.col("s.id") == F.col("f.id"), "full_outer")
    new, seen = F.col("s.status").isNull(), F.col("f.z").isNotNull()
    gone = new & F.coalesce("f.a.abandoned", F.lit(False))
    moves = seen & F.when(new, ~gone).otherwise(F.col("s.status").isin("RECEIVED", "ERROR"))
    text = lambda c: F.when(moves, F.col(f"f.z.content.{c}")).when(gone, F.col(f"f.a.content.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    fixed = lambda c: F.when(new, F.col(f"f.a.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    fresh = lambda c, of: F.when(seen, F.col(f"f.z.{of}")).otherwise(F.col(f"s.{c}")).alias(c)
    return joined.select(
        F.col("s.id").alias("id"), *map(fixed, ("source", "source_url", "origin_key", "tab_ids")), fresh("title_original", "title"), text("title"), text("body"),
        fresh("upstream_archive_id", "upstream_archive_id"), fresh("raw", "raw"), F.when(new, "B").otherwise(F.col("s.level")).alias("level"),
        F.when(gone, 2).otherwise(F.col("s.publish_mode")).alias("publish_mode"), F.when(gone, "ABANDONED").when(new, "RECEIVED").otherwise(F.col("s.status")).alias("status"),
        F.when(moves, F.col("f.z.seen_at")).when(gone, F.col("f.a.seen_at")).otherwise(F.col("s.updated_at")).alias("updated_at"), F.greatest("s.last_seen_at", "f.z.seen_at").alias("last_seen_at"),
    )


def seeded(dim: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """The dimension with the seed rows that it has under none of the keys."""
    for k in keys:
        seed = seed.join(dim.select(k), k, "left_anti")
    return dim.unionByName(seed.select(*dim.columns))


#: States that keep an error. Fixed values.
FAILED_STATES = ("ERROR", "PUBLISH_FAILED")


def transitioned(state: DataFrame, requests: DataFrame) -> DataFrame:
    """One request wins for each article: allowed from its status, made on its present version, the earliest.

    state: id, status, published_at, updated_at, error, tab_names; requests: id, request_id, allowed_from, expected,
    to_status, at, message, tab_names. An article that moves keeps an error (the request's message, else its own) only in a
    failed state; its first publication fixes the time and the names of its tabs, unless there are some.
    """
    valid = requests.join(state.select("id", "status", "updated_at"), "id").filter(F.array_contains("allowed_from", F.col("status")) & F.col("expected").eqNullSafe(F.col("updated_at")))
    won = valid.groupBy("id").agg(F.min_by(F.struct("to_status", "at", "message", "tab_names"), F.struct("at", "request_id")).alias("w"))
    joined = state.join(won, "id", "left")
    moves, published = F.col("w").isNotNull(), F.col("w.to_status") == "PUBLISHED"
    kept = F.when(F.col("w.to_status").isin(*FAILED_STATES), F.coalesce(F.nullif(F.col("w.message"), F.lit("")), "error"))
    nameless = F.coalesce(F.size("tab_names"), F.lit(0)) <= 0
    return joined.select(
        "id", F.coalesce("w.to_status", "status").alias("status"), F.when(published, F.coalesce("published_at", "w.at")).otherwise(F.col("published_at")).alias("published_at"), F.coalesce("w.at", "updated_at").alias("updated_at"),
        F.when(moves, kept).otherwise(F.col("error")).alias("error"), F.when(published & nameless, F.col("w.tab_names")).otherwise(F.col("tab_names")).alias("tab_names"),
    )
