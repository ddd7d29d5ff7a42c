"""Sequential two-sided rating.

Every update needs both teams' current ratings, so results of one (sport, league) must be applied in order. The
work is one small recurrence per league: rows arrive sorted and in Arrow batches, only the ratings of the league's
teams are kept, and nothing but the update rows is emitted. Leagues run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixtures import available_day, usable_final
from .asof import TEAM, as_of, asked_days

START = 1500.0
STEP = {"baseball": 16.0}
OTHER_STEP = 24.0

SCHEMA = ("game_id long, sport string, league string, home_key string, away_key string, start_time timestamp_ntz, "
          "day date, home_rating double, away_rating double")


def advance(rating: dict, home: str, away: str, result: float, step: float) -> tuple[float, float]:
    """Apply one result to the ratings in place; returns both new ratings."""
    before_home, before_away = rating.get(home, START), rating.get(away, START)
    moved = step * (result - 1.0 / (1.0 + 10.0 ** ((before_away - before_home) / 400.0)))
    # A pairing of one team with itself keeps both moves, as two separate updates would.
    rating[home] = before_home + moved
    rating[away] = rating.get(away, START) - moved
    return rating[home], rating[away]


def _league(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    step = STEP.get(key[0], OTHER_STEP)
    rating: dict[str, float] = {}
    previous = None
    for batch in batches:
        moment = list(zip(batch["start_time"], batch["game_id"]))
        if moment and ((previous is not None and moment[0] < previous) or moment != sorted(moment)):
            raise ValueError("results of a league must arrive in (start_time, game_id) order")
        previous = moment[-1] if moment else previous
        pairs = [advance(rating, h, a, r, step)
                 for h, a, r in zip(batch["home_key"], batch["away_key"], batch["result"])]
        new = np.array(pairs, dtype=float).reshape(-1, 2)
        yield batch.drop(columns="result").assign(home_rating=new[:, 0], away_rating=new[:, 1])


def rating_updates(games: DataFrame) -> DataFrame:
    """Both ratings after every usable final."""
    margin = F.col("home_score") - F.col("away_score")
    rows = games.where(usable_final()).select(
        "game_id", "sport", "league", "home_key", "away_key", "start_time",
        available_day(F.col("start_time")).alias("day"),
        F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5).alias("result"))
    ordered = rows.repartition("sport", "league").sortWithinPartitions("sport", "league", "start_time", "game_id")
    return ordered.groupBy("sport", "league").applyInPandas(_league, SCHEMA)


def team_ratings(games: DataFrame) -> DataFrame:
    """Rating of every asked (sport, league, team, day), using only results available by that day."""
    side = [F.struct(F.col(f"{s}_key").alias("team"), F.col(f"{s}_rating").alias("rating")) for s in ("home", "away")]
    updates = rating_updates(games).select("sport", "league", "day", "start_time", "game_id", F.inline(F.array(*side)))
    daily = updates.groupBy(*TEAM, "day").agg(
        F.max_by("rating", F.struct("start_time", "game_id")).alias("rating"))
    return as_of(daily, asked_days(games), TEAM)
