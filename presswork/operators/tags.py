"""Tag sets from season rosters: construction, acceptance, lists, and filtering of channels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window as W, functions as F


def latest_seasons(seasons: DataFrame, as_of: date, n: int = 2) -> DataFrame:
    """The n latest seasons of each competition that have started."""
    w = W.partitionBy("competition_id").orderBy(F.desc("start_date"), F.desc("id"))
    started = seasons.filter(F.col("start_date") <= F.lit(as_of))
    return started.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select(F.col("id").alias("season_id"), "competition_id")


def roster_tags(latest: DataFrame, season_teams: DataFrame, teams: DataFrame, persons: DataFrame, channels: DataFrame) -> DataFrame:
    """(competition_id, channel_id, tag_type): channels of the teams in the seasons, and of the teams' persons.

    All competitions in one pass; a channel in both stays Team.
    """
    playing = teams.filter(~F.col("deleted") & (F.col("team_type") == "default")).select(F.col("id").alias("team_id"))
    pairs = latest.join(season_teams, "season_id").join(playing, "team_id").select("competition_id", "team_id").distinct()
    of = lambda kind: channels.filter(F.col("relate_type") == kind).select("backend_id", F.col("id").alias("channel_id"))
    team = pairs.join(of("Team"), F.col("team_id") == F.col("backend_id")).select("competition_id", "channel_id", F.lit("Team").alias("tag_type"))
    people = pairs.join(persons, "team_id").select("competition_id", "person_id").distinct()
    player = people.join(of("Player"), F.col("person_id") == F.col("backend_id")).select("competition_id", "channel_id", F.lit("Player").alias("tag_type"))
    both = team.unionByName(player)
    # Team is after Player in the alphabet
    return both.groupBy("competition_id", "channel_id").agg(F.max("tag_type").alias("tag_type"))


def national_tags(teams: DataFrame, persons: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel_id, tag_type) of national teams of any kind and their persons."""
    national = teams.filter(~F.col("deleted") & (F.col("type") == "national")).select(F.col("id").alias("team_id"))
    team = national.join(channels.filter("relate_type = 'Team'"), F.col("team_id") == F.col("backend_id")).select(F.col("id").alias("channel_id"), F.lit("Team").alias("tag_type"))
    people = national.join(persons, "team_id").select("person_id").distinct()
    player = people.join(channels.filter("relate_type = 'Player'"), F.col("person_id") == F.col("backend_id")).select(F.col("id").alias("channel_id"), F.lit("Player").alias("tag_type"))
    return team.unionByName(player).groupBy("channel_id").agg(F.max("tag_type").alias("tag_type"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("competition_id").agg(F.count_if(F.col("tag_type") == "Team").alias("team_count"), F.count_if(F.col("tag_type") == "Player").alias("player_count"))


def acceptance(new: DataFrame, old: DataFrame, keep: float = 0.5) -> DataFrame:
    """competition_id, accepted and reason: an empty list, or one under half of the accepted one, is rejected."""
    was = old.select("competition_id", F.col("team_count").alias("old_team"), F.col("player_count").alias("old_player"))
    joined = new.join(was, "competition_id", "left")
    has = F.coalesce("old_team", F.lit(0)) > 0
    least = lambda c: F.floor(F.col(c) * keep)
    reason = (
        F.when((F.col("team_count") == 0) | (F.col("player_count") == 0), "empty")
        .when(has & ((F.col("team_count") < least("old_team")) | (F.col("player_count") < least("old_player"))), "dropped").otherwise("")
    )
    return joined.withColumn("reason", reason).select("competition_id", "team_count", "player_count", (F.col("reason") == "").alias("accepted"), "reason")


def accepted_tags(old: DataFrame, new: DataFrame, verdict: DataFrame) -> DataFrame:
    """Tags after a refresh: new ones of accepted competitions, the old ones of all others."""
    good = verdict.filter("accepted").select("competition_id")
    return new.join(good, "competition_id", "left_semi").unionByName(old.join(good, "competition_id", "left_anti"))


def tab_lists(tags: DataFrame, competition_tabs: DataFrame) -> DataFrame:
    """(tab_id, channel_id): what each tab allows, by its competitions."""
    return tags.join(competition_tabs, "competition_id").select("tab_id", "channel_id").distinct()


def filtered_channels(articles: DataFrame, article_tabs: DataFrame, allowed: DataFrame, blocked: DataFrame) -> DataFrame:
    """id and channels that any of the article's lists allows and that aren't blocked; order kept, first of equals.

    An article whose tabs have no list keeps its channels. Joins on exploded channels, so lists may be long.
    """
    listed = allowed.select("tab_id").distinct()
    limited = article_tabs.join(listed, "tab_id", "left_semi").select("article_id").distinct().withColumn("limited", F.lit(True))
    rows = articles.select("id", F.posexplode("channels").alias("pos", "channel_id")).groupBy("id", "channel_id").agg(F.min("pos").alias("pos"))
    rows = rows.join(blocked.select("channel_id"), "channel_id", "left_anti").join(limited.withColumnRenamed("article_id", "id"), "id", "left")
    ok = article_tabs.join(allowed, "tab_id").select(F.col("article_id").alias("id"), "channel_id").distinct().withColumn("ok", F.lit(True))
    kept = rows.join(ok, ["id", "channel_id"], "left").filter("limited is null or ok")
    lists = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "channel_id"))), lambda x: x["channel_id"]).alias("channels"))
    return articles.select("id").join(lists, "id", "left").select("id", F.coalesce("channels", F.array().cast("array<bigint>")).alias("channels"))
