"""Rated games: one side's perspective, daily activity, openings and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.clean import average, slug_words, tier
from quarrystone.operators.classify import classify
from quarrystone.operators.dedupe import latest

PAYLOAD = ("url string, pgn string, time_control string, end_time bigint, rated boolean, rules string, time_class string, "
           "eco string, white struct<username:string,rating:int,result:string>, black struct<username:string,rating:int,result:string>")
DRAWS = ("agreed", "repetition", "stalemate", "insufficient", "timevsinsufficient", "50move")
RESULTS = ("win", "draw", "loss")


def result_of(code):
    return F.when(code == "win", "win").when(code.isin(*DRAWS), "draw").when(code.isNotNull(), "loss")


def clean_games(bronze: DataFrame) -> DataFrame:
    """Games seen from the player that was asked for; a player on neither side has no side."""
    g = bronze.where("record_type = 'games'").withColumn("p", F.from_json("payload_json", PAYLOAD))
    me = F.lower("username")
    colour = F.when(F.lower("p.white.username") == me, "white").when(F.lower("p.black.username") == me, "black")
    side = lambda name: F.when(colour == "white", F.col(f"p.white.{name}")).when(colour == "black", F.col(f"p.black.{name}"))
    other = lambda name: F.when(colour == "white", F.col(f"p.black.{name}")).when(colour == "black", F.col(f"p.white.{name}"))
    end = F.timestamp_seconds("p.end_time")
    return g.select(
        F.col("p.url").alias("game_id"), "username", end.alias("game_end_at"), F.to_date(end).alias("game_date"),
        "p.time_class", "p.time_control", "p.rated", "p.rules", colour.alias("target_color"),
        side("rating").alias("target_rating"), side("result").alias("target_result_code"),
        result_of(side("result")).alias("result"), other("username").alias("opponent_username"),
        other("rating").alias("opponent_rating"),
        slug_words("p.eco", r"^https?://[^ ]*/openings/").alias("opening"), "ingested_at", "record_hash")


def classify_games(games: DataFrame):
    required = ("game_id", "game_end_at", "target_color", "target_rating", "opponent_username")
    accepted, rejected = classify(games, [(f"missing_{c}", F.col(c).isNull()) for c in required])
    return latest(accepted, ["game_id", "username"], [F.col("ingested_at").desc(), F.col("record_hash").desc()]), rejected


def results_pivot(games: DataFrame, *keys: str) -> DataFrame:
    """Wins, draws and losses as columns; absent results are zero."""
    return games.groupBy(*keys).pivot("result", list(RESULTS)).count().fillna(0, list(RESULTS))


def _won(result: str):
    return F.count_if(F.col("result") == result)


def _rate(df: DataFrame, wins: str) -> DataFrame:
    return df.withColumn("win_rate", F.round(F.col(wins) / F.col("games"), 4))


def player_summary(games: DataFrame) -> DataFrame:
    """One row for each player: days, ratings, first and last game, results; one pass, no pivot and no join."""
    return _rate(games.groupBy("username").agg(
        F.count("game_id").alias("games"), F.count_distinct("game_date").alias("active_days"),
        average("target_rating").alias("average_rating"), average("opponent_rating").alias("average_opponent_rating"),
        F.min("game_end_at").alias("first_game_at"), F.max("game_end_at").alias("last_game_at"),
        *(_won(r).alias(r) for r in RESULTS)), "win")


def player_segment(summary: DataFrame) -> DataFrame:
    return summary.select("username", "games", "active_days", "average_rating", segment("games").alias("player_segment"))


def daily_activity(games: DataFrame) -> DataFrame:
    return _rate(games.groupBy("username", "game_date").agg(
        F.count("game_id").alias("games"), _won("win").alias("wins"), _won("draw").alias("draws"), _won("loss").alias("losses"),
        average("target_rating").alias("average_rating")), "wins")


def opening_performance(games: DataFrame) -> DataFrame:
    return _rate(games.groupBy("username", "opening").agg(
        F.count("game_id").alias("games"), _won("win").alias("wins"),
        average("opponent_rating").alias("average_opponent_rating")), "wins")


def rating_progression(games: DataFrame) -> DataFrame:
    """By player and day: the last rating of the day and its change from the player's day before."""
    by = games.groupBy("username", "game_date").agg(
        F.max_by("target_rating", F.struct("game_end_at", "game_id")).alias("ending_rating"))
    return by.withColumn("rating_change", F.col("ending_rating") - F.lag("ending_rating").over(
        Window.partitionBy("username").orderBy("game_date")))


def segment(games_column):
    return tier(games_column, ((100, "POWER"), (30, "ACTIVE")), "CASUAL")
