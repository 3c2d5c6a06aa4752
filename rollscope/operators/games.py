"""Votes and rewards of the odd-image game."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.functions import games as G
from rollscope.operators import ordered
from rollscope.operators.skew import attach_stats, with_group_stats


def game_tally(votes: DataFrame, players: int) -> DataFrame:
    """One row per game: spy, votes received per player, n/a and invalid counts; one partial aggregate."""
    valid = F.coalesce(F.col("vote").between(1, players), F.lit(False)) & ~F.col("na")
    counts = [F.count_if(valid & (F.col("vote") == p)) for p in range(1, players + 1)]
    return votes.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("__n"), F.max("spy").alias("spy"), F.array(*counts).alias("received"),
        F.count_if(valid).alias("valid_votes"), F.count_if("na").alias("na_votes"),
        F.count_if(~valid & ~F.col("na")).alias("invalid_votes"))


def vote_tally(votes: DataFrame, players: int) -> DataFrame:
    """One row per game and player: votes received and the vote-share penalty."""
    rows = game_tally(votes, players).select(
        "game_id", "valid_votes", "na_votes", "invalid_votes", F.posexplode("received").alias("p", "votes"))
    return rows.select(
        "game_id", (F.col("p") + 1).alias("player"), "votes", "na_votes", "invalid_votes",
        F.when(F.col("valid_votes") > 0, -0.5 * F.col("votes") / F.col("valid_votes")).otherwise(F.lit(0.0))
        .alias("penalty"))


def vote_rewards(votes: DataFrame, players: int) -> DataFrame:
    """Reward of every voter: seekers win by naming the spy, the spy by hiding and misleading."""
    df = attach_stats(votes, game_tally(votes, players).withColumnRenamed("spy", "__spy"), ["game_id"])
    n = players - 1
    got = F.coalesce(F.get(F.col("received"), (F.col("voter") - 1).cast("int")), F.lit(0))
    parsed = F.col("vote").isNotNull() | F.col("na")
    named = F.coalesce((F.col("vote") == F.col("spy")) & ~F.col("na"), F.lit(False))
    seeker = F.when(~parsed, F.lit(-1.0)).otherwise(
        F.when(named, F.lit(1.0)).otherwise(F.lit(-1.0)) - G.SUSPICION_WEIGHT * got / n)
    on_spy = F.get(F.col("received"), (F.col("spy") - 1).cast("int"))
    misled = (F.col("valid_votes") - on_spy) + G.NA_MISLEAD * F.col("na_votes")
    hider = (1.0 - on_spy / n + G.MISLEAD_WEIGHT * misled / n
             - F.when(named, F.lit(1.0)).otherwise(F.lit(0.0)))
    raw = F.when(F.col("voter") == F.col("spy"), hider).otherwise(seeker)
    return df.select(*votes.columns, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)).alias("reward"))


def strategic_rewards(votes: DataFrame, players: int, beta: float = 0.1, spread: float = 0.1) -> DataFrame:
    """Zero-sum clue reward of every player from the suspicion on the spy against the average civilian."""
    g = game_tally(votes, players)
    n = players - 1
    on_spy = F.get(F.col("received"), (F.col("spy") - 1).cast("int"))
    mean_civ = (F.col("valid_votes") - on_spy) / n
    rows = g.select("game_id", "spy", on_spy.alias("on_spy"), mean_civ.alias("mean_civ"),
                    F.posexplode("received").alias("p", "votes"))
    psi = F.col("on_spy") - F.col("mean_civ")
    player = F.col("p") + 1
    reward = F.when(player == F.col("spy"), -beta * psi).otherwise(
        beta * psi / n - spread * (F.col("votes") - F.col("mean_civ")))
    return rows.select("game_id", player.alias("player"), (player == F.col("spy")).alias("is_spy"),
                       psi.alias("psi"), reward.alias("reward"))


def game_roles(rewards: DataFrame) -> DataFrame:
    """One row per game: the spy's reward and the mean civilian reward."""
    return rewards.groupBy("game_id").agg(
        F.max(F.when(F.col("is_spy"), F.col("reward"))).alias("spy_reward"),
        F.avg(F.when(~F.col("is_spy"), F.col("reward"))).alias("civ_reward"))


def role_ema(games: DataFrame, keys: Sequence[str] = (), order: str = "game_id", alpha: float = 0.9) -> DataFrame:
    """Role baselines in game order, updated before they are subtracted."""
    src = games.withColumn("__run", F.lit(0)) if not keys else games
    out = ordered.ema(src, list(keys) or ["__run"], [F.col(order).asc()],
                      {"b_spy": "spy_reward", "b_civ": "civ_reward"}, alpha)
    return out.select(*games.columns, "b_spy", "b_civ",
                      (F.col("spy_reward") - F.col("b_spy")).alias("spy_adjusted"),
                      (F.col("civ_reward") - F.col("b_civ")).alias("civ_adjusted"))


def majority_vote(votes: DataFrame, players: int) -> DataFrame:
    """Per game: whether the most voted player is the spy (ties to the lowest), n/a rate and votes cast."""
    g = game_tally(votes, players)
    top = F.array_position(F.col("received"), F.array_max("received"))
    return g.select(
        "game_id", F.when(F.col("valid_votes") > 0, (top == F.col("spy")).cast("double")).otherwise(F.lit(0.0))
        .alias("correct"), (F.col("na_votes") / F.col("__n")).alias("na_rate"), F.col("__n").alias("votes_cast"))


def phase_normalize(df: DataFrame, keys: Sequence[str], reward: str, ddof: int = 0, eps: float = 1e-8) -> DataFrame:
    """Standardise within a group; a flat group is only centred and a lone row kept."""
    std = {0: F.stddev_pop, 1: F.stddev_samp}[ddof](reward)
    out = with_group_stats(df, keys, {"__cnt": F.count(F.lit(1)), "__mean": F.avg(reward), "__std": std,
                                      "__range": F.max(reward) - F.min(reward)})
    centred = F.col(reward) - F.col("__mean")
    spread = (F.col("__std") > eps) & (F.col("__range") > eps)
    return out.select(*df.columns, F.when(F.col("__cnt") <= 1, F.col(reward)).when(
        spread, centred / (F.col("__std") + eps)).otherwise(centred).alias("normalized"))


def game_metrics(df: DataFrame, phase: str, reward: str) -> DataFrame:
    """Mean, population std, min and max of rewards per phase and overall."""
    out = df.groupingSets([[], [F.col(phase)]], F.col(phase)).agg(
        F.grouping(phase).alias("g"), F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean"),
        F.stddev_pop(reward).alias("std"), F.min(reward).alias("min"), F.max(reward).alias("max"))
    return out.select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col(phase)).alias(phase),
                      "n", "mean", "std", "min", "max")
