"""A league: players' versions, games' results, standings and scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fact_box_scores(scores: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """Box scores with the player version valid on the game's date."""
    dated = scores.join(games.select("game_id", "season", "game_date"), "game_id")
    d = players.select(F.col("player_id").alias("_player"), "sk", "team_id", "effective_start", "effective_end")
    test = (dated["player_id"] == d["_player"]) & (dated["game_date"] >= d["effective_start"]) & (
        dated["game_date"] < d["effective_end"])
    return dated.join(d, test).drop("_player", "effective_start", "effective_end")


def team_games(games: DataFrame) -> DataFrame:
    """Two rows for each game, one a side; a tie counts for the away side."""
    home_won = F.col("home_score") > F.col("away_score")
    home = games.select("season", "game_id", F.col("home_team_id").alias("team_id"), home_won.cast("int").alias("won"))
    away = games.select("season", "game_id", F.col("away_team_id").alias("team_id"), (~home_won).cast("int").alias("won"))
    return home.unionByName(away)


def standings(games: DataFrame) -> DataFrame:
    return team_games(games).groupBy("season", "team_id").agg(
        F.sum("won").cast("bigint").alias("wins"), F.count(F.lit(1)).alias("games_played"),
        F.round(F.sum("won") / F.count(F.lit(1)), 3).alias("win_pct"))


def season_points(fact: DataFrame) -> DataFrame:
    return fact.groupBy("season", "sk", "team_id").agg(F.sum("pts").cast("bigint").alias("points"))


def top_by_season(df: DataFrame, metric: str, tie: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("season").orderBy(F.col(metric).desc(), F.col(tie)))
    return df.withColumn("place", place.cast("bigint")).where(F.col("place") <= n)


def melted(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Wide to long: one row for each metric."""
    return df.unpivot(keys, values, "metric", "value")
