"""Fits. Iterated solutions have no SQL counterpart here, so these are checked by tests, not by SQL."""

from pyspark.sql import functions as F

from ..operators import asof, models, rating, resample
from ..plans.session import stable
from .features import FEATURES, JOINED, STATES
from .registry import query, r6

FOLDS = [("f1", "1998-01-01", "1998-04-01"), ("f2", "1998-07-01", "1998-10-01"), ("f3", "1999-01-01", "1999-04-01"),
         ("f4", "1999-07-01", "1999-10-01"), ("f5", "2000-01-01", "2000-04-01")]
C_VALUES = [0.00001, 0.0001, 0.001, 0.01, 0.1, 1.0]
SIDES = ["elo", "form", "win_rate", "avg_margin", "rest_days"]
#: Value of each side column for a team without history (fixed values).
NEUTRAL = [0.75, 0.5, 0.5, 0.0, 0.0]


def _features(t, sport="baseball"):
    games = t.games()
    rows = asof.pregame_features(games, rating.team_ratings(games))
    return rows.where(F.col("label") >= 0).where(F.col("sport") == sport if sport else F.lit(True))


def grid_rows(t):
    """Folded baseball rows with the differences of both sides, and the columns of all 30 configurations."""
    games = t.games()
    rows = asof.sweep_features(games, ratings=rating.team_ratings(games)).where(
        "sport = 'baseball' AND status = 'final' AND outcome IN (0, 2)")
    pairs = [f"form_{w}_{h}" for w in (3, 5, 10, 20, 40) for h in ("pooled", "role")] + ["rest_capped", "rest_recovery"]
    rows = rows.withColumns({f"{p}_diff": F.col(f"home_{p}") - F.col(f"away_{p}") for p in pairs} | {"none": F.lit(0.0)})
    folded = resample.rolling_folds(rows, FOLDS).where("role <> 'embargoed'").withColumn("y", (F.col("outcome") == 2).cast("int"))
    configs = {}
    for w in (3, 5, 10, 20, 40):
        for history, h in (("pooled", "pooled"), ("home-away", "role")):
            for rest in ("none", "capped", "recovery"):
                form, away = f"form_{w}_{h}", [f"{{0}}_{c}_{h}" for c in ("rate", "games")]
                both = [c.format(s) for c in away for s in ("home", "away")]
                rests = ["none"] * 3 if rest == "none" else [f"home_rest_{rest}", f"away_rest_{rest}", f"rest_{rest}_diff"]
                configs[f"w{w}-{history}-{rest}"] = ["home_elo", "away_elo", "elo_diff", f"home_{form}", f"away_{form}", f"{form}_diff",
                                                     *both, *rests, f"home_margin_{h}", f"away_margin_{h}"]
    return folded.select("fold", "role", "y", *sorted({c for own in configs.values() for c in own})), configs


@query("logistic_grid")
def _(t):
    rows, configs = grid_rows(t)
    out = models.grid(rows, configs, [f[0] for f in FOLDS], C_VALUES)
    return out.select("config", "c", "folds", "n", F.round("log_loss", 6).alias("log_loss"),
                      F.round("accuracy", 6).alias("accuracy"), "converged")


def _side_sql(side):
    return ", ".join(f"{r6(f'{FEATURES[f"{side}_{c}"]} - {m}')} AS {side}_{c}" for c, m in zip(SIDES[1:], NEUTRAL[1:]))


@query("side_vectors", "games", f"{STATES} SELECT game_id, {_side_sql('home')}, {_side_sql('away')} FROM {JOINED}")
def _(t):
    sides = models.side_vectors(asof.pregame_features(t.games()), SIDES[1:], NEUTRAL[1:])
    return sides.select("game_id", *[F.round(F.col(s)[i], 6).alias(f"{s}_{c}") for s in ("home", "away") for i, c in enumerate(SIDES[1:])])


@query("quality_interval")
def _(t):
    rows = _features(t)
    day = F.col("start_time").cast("date")
    return models.quality_interval(rows, SIDES, NEUTRAL, day, (F.col("label") == 0).cast("int"), 0.1, 100, 20260913, "games_played")


@query("readout_fit")
def _(t):
    rows = stable(_features(t).withColumns({f"d_{c}": F.col(f"home_{c}") - F.col(f"away_{c}") for c in SIDES}))
    train = F.col("start_time") < F.lit("1999-01-01").cast("timestamp_ntz")
    return models.readout(rows, [f"d_{c}" for c in SIDES], (F.col("label") == 0).cast("int"), train, 0.01, False)


_NAMES = [f"{s}_{c}" for s in ("home", "away") for c in SIDES]


def _split(df):
    return df.withColumn("outcome", F.col("label")), F.col("start_time") < F.lit("1999-01-01").cast("timestamp_ntz")


@query("sport_readout")
def _(t):
    rows, train = _split(_features(t, sport=None))
    return models.sport_readouts(rows.select("sport", "outcome", "start_time", *_NAMES), _NAMES, train, 0.1)


@query("shuffle_control")
def _(t):
    rows, train = _split(_features(t, sport=None))
    rows = stable(rows.select("game_id", "sport", "outcome", "start_time", *_NAMES))
    mixed = resample.block_shuffle(rows.where(train), ["sport"], "game_id", "991", ["outcome"]).select("game_id", "shuffled_outcome")
    control = rows.join(mixed, "game_id", "left").withColumn("outcome", F.coalesce("shuffled_outcome", "outcome"))
    fits = {"true_labels": rows, "shuffled_labels": control}
    parts = [models.sport_readouts(df.select("sport", "outcome", "start_time", *_NAMES), _NAMES, train, 0.1)
             .withColumn("arm", F.lit(name)) for name, df in fits.items()]
    return parts[0].unionByName(parts[1])
