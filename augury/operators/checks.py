"""Row checks that return reasons instead of raising, so they scale and can be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds, text
from ..functions.probability import argmax, valid_vector


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first condition that holds; null when none does. Unknown counts as not holding."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules])


def odds_records(raw: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Normalise price records and name why one is rejected.

    Needs sportsbook, market, price_format, home_key, away_key, home_price, away_price, draw_price, quote_timing,
    record_id, game_number (text), start_time, local_date, zone; ``extra`` columns are carried along.
    """
    required = ["sportsbook", "market", "price_format", "home_key", "away_key", "home_price", "away_price",
                "quote_timing", "record_id"]
    texts = [F.col(c).cast("string") for c in required]
    missing = F.concat(*texts).isNull() | (F.least(*[F.length(c) for c in texts]) == 0)
    # Keys and prices become columns first, so the reasons below read them instead of repeating them.
    keyed = raw.select(
        "*", missing.alias("_missing"), F.expr("try_cast(game_number AS INT)").alias("_number"),
        *[text.book_team_key(F.col(f"{s}_key")).alias(f"_{s}_key") for s in ("home", "away")],
        *[odds.to_decimal(F.col(f"{s}_price"), F.col("price_format")).alias(f"_{s}") for s in ("home", "away")])
    reason = first_reason([
        (F.col("_missing"), "missing_field"),
        (~F.lower(F.trim("market")).isin("moneyline", "ml", "money-line"), "market"),
        (F.col("draw_price").isNotNull(), "draw_price"),
        (~F.lower(F.trim("price_format")).isin("american", "decimal"), "price_format"),
        (F.col("_home").isNull() | F.col("_away").isNull(), "price"),
        (F.col("_home_key").isNull() | F.col("_away_key").isNull() | (F.col("_home_key") == F.col("_away_key")), "teams"),
        (F.col("start_time").isNull() & (F.col("local_date").isNull() | F.col("zone").isNull()), "fixture_time"),
        ((F.coalesce("game_number", F.lit("")) != "") & (F.col("_number").isNull() | (F.col("_number") < 1)), "game_number"),
    ])
    judged = keyed.withColumn("reason", reason)
    p_home, p_away = odds.devig_two_way(F.col("_home"), F.col("_away"))
    good = F.col("reason").isNull()
    return judged.select(
        "record_id", "reason", F.trim("sportsbook").alias("sportsbook"), F.col("_home_key").alias("home_key"),
        F.col("_away_key").alias("away_key"), F.when(good, p_home).alias("p_home"), F.when(good, p_away).alias("p_away"),
        "start_time", "local_date", "zone", F.col("_number").alias("game_number"), *extra)


def saved_prediction_rows(rows: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Saved predictions (game_id, sport, model, seed, outcome, p) with the first reason against each, or null.

    Repeats of one (game, model, seed) and games whose rows state different outcomes are found over all rows with a key.
    """
    missing = F.col("game_id").isNull() | F.col("model").isNull() | F.col("p").isNull() | F.col("sport").isNull()
    judged = rows.withColumn("_missing", missing)
    counted = F.when(~F.col("_missing"), 1)
    repeats = F.count(counted).over(Window.partitionBy("game_id", "model", "seed"))
    stated = F.when(~F.col("_missing"), F.col("outcome"))
    game = Window.partitionBy("game_id")
    facts = judged.withColumns({"_repeats": repeats, "_low": F.min(stated).over(game), "_high": F.max(stated).over(game)})
    finite = (F.size("p") == 3) & F.forall("p", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    reason = first_reason([
        (F.col("_missing"), "missing_field"), (~finite, "non_finite"),
        (~valid_vector(F.col("p"), F.col("sport"), tolerance), "probabilities"), (F.col("outcome").isNull(), "no_outcome"),
        (~F.col("outcome").isin(0, 1, 2), "outcome"), (F.col("_repeats") > 1, "duplicate"),
        (F.col("_low") != F.col("_high"), "outcome_disagrees")])
    return facts.withColumn("reason", reason).drop("_missing", "_repeats", "_low", "_high")


def season_rows(items: DataFrame, year: int) -> DataFrame:
    """Strict season scan: one ordered exclusion reason per row, then hard violations among the kept rows.

    ``items``: pk, game_type, abstract_state, detailed_state, resume_marker, start_time, home_score, away_score,
    home_id, away_id, home_winner, away_winner.
    """
    detail = F.lower(F.coalesce("detailed_state", F.lit("")))
    resumed = (items.where(F.col("resume_marker").isNotNull() | detail.contains("suspend"))
               .select("pk").distinct().withColumn("resumed", F.lit(True)))
    flagged = items.join(resumed, "pk", "left")
    reason = first_reason([
        (F.col("resumed"), "resumed_or_suspended"),
        (~F.col("game_type").eqNullSafe("R"), "nonregular"),
        (detail.contains("postpon") | detail.contains("cancel"), "unplayed"),
        (~F.col("abstract_state").eqNullSafe("Final"), "nonfinal"),
        (F.col("home_score") == F.col("away_score"), "tie")])
    judged = flagged.withColumn("reason", reason)
    repeated = (judged.where("reason is null").groupBy("pk").agg(F.count(F.lit(1)).alias("copies"))
                .where("copies > 1"))
    violation = first_reason([
        (F.col("reason").isNotNull(), "none"),
        (F.col("home_score").isNull() | F.col("away_score").isNull(), "score"),
        (F.coalesce(F.col("pk") < 1, F.lit(True)), "game_id"),
        (F.coalesce(F.year("start_time") != year, F.lit(True)), "season_year"),
        (F.col("home_id").isNull() | F.col("away_id").isNull(), "team_id"),
        (F.col("home_id") == F.col("away_id"), "same_team"),
        (F.col("copies") > 1, "duplicate_id"),
        (F.col("home_winner").isNull() | F.col("away_winner").isNull()
         | (F.col("home_winner") != (F.col("home_score") > F.col("away_score")))
         | (F.col("away_winner") != (F.col("away_score") > F.col("home_score"))), "winner_flag")])
    return (judged.join(repeated, "pk", "left")
            .withColumn("violation", F.when(violation != "none", violation)).drop("resumed", "copies"))


def prediction_rows(df: DataFrame, p: Column, pick: Column, confidence: Column) -> Column:
    """Reason a saved prediction is invalid, or null."""
    return first_reason([
        (F.col("game_id").isNull() | F.col("model").isNull() | F.col("start_time").isNull(), "identity"),
        (~valid_vector(p, F.col("sport")), "probabilities"),
        (pick != argmax(p), "pick"),
        (F.abs(confidence - F.array_max(p)) > 1e-5, "confidence")])


def manifest_diff(current: DataFrame, lock: DataFrame, key: str, digest: str) -> DataFrame:
    """Compare content digests with a lock table: same, changed, missing or added."""
    both = current.select(key, F.col(digest).alias("now")).join(
        lock.select(key, F.col(digest).alias("locked")), key, "full_outer")
    state = (F.when(F.col("locked").isNull(), "added").when(F.col("now").isNull(), "missing")
             .when(F.col("now") == F.col("locked"), "same").otherwise("changed"))
    return both.select(key, "now", "locked", state.alias("state"))
