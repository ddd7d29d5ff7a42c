"""Embargoed folds and calendar buckets."""

from pyspark.sql import functions as F

from ..functions.fixtures import week_start
from ..operators import resample
from .registry import query

FOLDS = [("f1", "1998-01-01", "1998-04-01"), ("f2", "1999-01-01", "1999-04-01"), ("f3", "2000-01-01", "2000-07-01")]
_VALUES = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in FOLDS)


@query("rolling_folds", "games", f"""
SELECT fold, game_id, CASE WHEN start_time >= a THEN 'evaluation' WHEN start_time + INTERVAL 48 HOUR <= a THEN 'fit' ELSE 'embargoed' END AS role
FROM games, (VALUES {_VALUES}) f(fold, a, b) WHERE start_time < b AND outcome IS NOT NULL""")
def _(t):
    rows = t.games().where("outcome is not null").select("game_id", "start_time")
    return resample.rolling_folds(rows, FOLDS).select("fold", "game_id", "role")


@query("weekly_totals", "games", """
SELECT sport, CAST(date_trunc('week', start_time) AS DATE) AS week, count(*) AS games, count(outcome) AS finished FROM games GROUP BY ALL""")
def _(t):
    return t.games().groupBy("sport", week_start(F.col("start_time")).alias("week")).agg(
        F.count("*").alias("games"), F.count("outcome").alias("finished"))
