"""Streaming jobs driven to completion over landed files; the final tables are checked against batch SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import probability
from ..functions.fixtures import utc_day
from ..streaming import jobs
from .features import _RATED
from .ingest import landing
from .ledgers import _SNAPSHOT, SQL_NOW, now, snapshot
from .matching import INCOMING, MERGED, PAIRED
from .registry import query, r6


def deliver(df, folder, parts, run):
    """Land a table in consecutive deliveries (row conditions) of any number of files; the job runs after each."""
    for condition in parts:
        df.where(condition).write.mode("append").parquet(folder)
        run()


_GAME = ["game_id", "sport", "league", "home_key", "away_key", "start_time", "status"]


@query("stream_merge", "games", f""", {INCOMING}, {MERGED}
SELECT game_id, sport, league, home_key, away_key, CAST(start_time AS VARCHAR) AS start_time, status FROM merged""")
def _(t):
    existing = t.games().select(*_GAME)
    incoming = existing.where("game_id % 3 = 0").withColumns({
        "start_time": F.expr("timestampadd(HOUR, 24, start_time)"),
        "game_id": F.expr("CASE WHEN sport = 'soccer' AND game_id % 2 = 0 THEN game_id + 100000000 ELSE game_id END")})
    source, log, checkpoint = landing(t, "source"), landing(t, "log"), landing(t, "checkpoint")
    rows = existing.withColumn("wave", F.lit(0)).unionByName(incoming.withColumn("wave", F.lit(1)))

    def stream():
        return jobs.read_stream(t.spark, rows.schema, source).drop("wave")

    deliver(rows, source, ["wave = 0", "wave = 1"], lambda: jobs.run_available(stream(), checkpoint, jobs.append_batch(log)))
    return jobs.merged_schedule(t.spark, log, PAIRED).withColumn("start_time", F.col("start_time").cast("string"))


@query("stream_first", "forecasts", """
SELECT CAST(game_id AS VARCHAR) || ':' || model AS forecast_key, min_by(forecast_id, (saved_at, forecast_id)) AS forecast_id
FROM forecasts GROUP BY ALL""")
def _(t):
    # Two deliveries: the earliest forecast of every key is in the first or, for one day in three, in the second.
    saved = F.struct("saved_at", "forecast_id")
    first = (saved == F.min(saved).over(Window.partitionBy("game_id", "model"))) & (F.dayofmonth("start_time") % 3 > 0)
    waves = t.forecasts().select(
        F.concat_ws(":", F.col("game_id").cast("string"), "model").alias("forecast_key"), "forecast_id",
        saved.alias("saved_at"), F.date_format("start_time", "yyyy-MM").alias("month"),
        F.when(first, 0).otherwise(1).alias("wave"))
    source, ledger, checkpoint = landing(t, "source"), landing(t, "ledger"), landing(t, "checkpoint")

    def stream():
        return jobs.read_stream(t.spark, waves.schema, source).drop("wave")

    deliver(waves, source, ["wave = 0", "wave = 1"],
            lambda: jobs.run_available(stream(), checkpoint, jobs.first_write(ledger, "forecast_key", "month")))
    return t.spark.read.parquet(ledger).select("forecast_key", "forecast_id")


@query("stream_late", "forecasts", """
SELECT forecast_id, CASE WHEN saved_at >= fixture_start THEN 'late' ELSE 'in_time' END AS arrival FROM forecasts""")
def _(t):
    rows = t.forecasts().select("forecast_id", "saved_at", "fixture_start", "seed")
    source, out, checkpoint = landing(t, "source"), landing(t, "late"), landing(t, "checkpoint")

    def stream():
        return jobs.lateness(jobs.read_stream(t.spark, rows.schema, source), "fixture_start")

    deliver(rows, source, ["seed = 0", "seed = 1", "seed = 2"],
            lambda: jobs.to_table(stream().select("forecast_id", "arrival"), out, checkpoint))
    return t.spark.read.parquet(out)


@query("stream_weekly", "games", """
SELECT sport, CAST(date_trunc('week', start_time) AS DATE) AS week, count(*) AS games, count(outcome) AS finished FROM games GROUP BY ALL""")
def _(t):
    rows = t.games().select("sport", "start_time", "outcome")
    source, log, checkpoint = landing(t, "source"), landing(t, "weeks"), landing(t, "checkpoint")

    def stream():
        return jobs.weekly_counts(jobs.read_stream(t.spark, rows.schema, source), "start_time")

    # The later events first: an old result that comes after them must still count.
    deliver(rows, source, ["year(start_time) >= 1998", "year(start_time) < 1998"],
            lambda: jobs.run_available(stream(), checkpoint, jobs.append_batch(log), "update"))
    latest = t.spark.read.parquet(log).groupBy("window", "sport").agg(
        F.max_by("games", "batch").alias("games"), F.max_by("finished", "batch").alias("finished"))
    return latest.select("sport", utc_day(F.col("window.start")).alias("week"), "games", "finished")


_OBSERVED = """CASE WHEN {0} THEN 'scheduled' ELSE status END"""


@query("stream_score", "forecasts", f"""{_SNAPSHOT}
SELECT DISTINCT forecast_id, model, f.sport, CASE WHEN s.status = 'cancelled' THEN 'void'
    WHEN sha256(concat_ws('|', f.sport, f.home_key, f.away_key, CAST(fixture_start AS VARCHAR))) <> s.revision THEN 'superseded'
    WHEN saved_at >= s.start_time THEN 'late'
    WHEN s.status = 'final' AND s.start_time <= observed_at AND observed_at <= {SQL_NOW} THEN 'complete'
    WHEN s.status IN ('scheduled', 'live') THEN 'pending' ELSE 'held' END AS status
FROM forecasts f JOIN snapshot s USING (game_id)""")
def _(t):
    # Two deliveries of every event: first as scheduled, then in its final form. Scores are keyed by forecast id, so a
    # repeated ledger row has one score.
    final = snapshot(t).select("game_id", "sport", "home_key", "away_key", "start_time", "status", "home_score", "away_score",
                               "outcome", "observed_at")
    early = final.withColumns({"status": F.lit("scheduled"), "home_score": F.lit(None).cast("int"),
                               "away_score": F.lit(None).cast("int"), "outcome": F.lit(None).cast("int"),
                               "observed_at": F.expr("timestampadd(DAY, -1, observed_at)")})
    source, log, checkpoint = landing(t, "source"), landing(t, "scores"), landing(t, "checkpoint")
    # A third of the final forms comes with the early ones, a third before them: the observation time decides.
    place = F.col("game_id") % 3
    rows = early.withColumn("wave", F.when(place == 2, 1).otherwise(0)).unionByName(
        final.withColumn("wave", F.when(place == 0, 1).otherwise(0)))

    def stream():
        return jobs.read_stream(t.spark, rows.schema, source).drop("wave")

    forecasts = t.forecasts().withColumn("p", probability.vector())
    deliver(rows, source, ["wave = 0", "wave = 1"],
            lambda: jobs.run_available(stream(), checkpoint, jobs.rescore(forecasts, log, now)))
    return jobs.current_scores(t.spark, log).select("forecast_id", "model", "sport", "status")


@query("stream_rating", "games", f"""{_RATED}, sided AS (
  SELECT game_id, role, avg(result) OVER (PARTITION BY sport, league, team ORDER BY start_time, game_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS form
  FROM (SELECT game_id, sport, league, start_time, 'home' AS role, home_key AS team, home_result AS result FROM numbered UNION ALL
        SELECT game_id, sport, league, start_time, 'away', away_key, 1 - home_result FROM numbered))
SELECT game_id, {r6("home_rating", 5)} AS home_rating, {r6("away_rating", 5)} AS away_rating, {r6("h.form")} AS home_form, {r6("a.form")} AS away_form
FROM rated JOIN sided h USING (game_id) JOIN sided a USING (game_id) WHERE h.role = 'home' AND a.role = 'away'""", recursive=True)
def _(t):
    rows = t.games().drop("source_key")
    source, out, checkpoint = landing(t, "source"), landing(t, "ratings"), landing(t, "checkpoint")

    def stream():
        return jobs.rating_stream(jobs.read_stream(t.spark, rows.schema, source))

    deliver(rows, source, ["year(start_time) < 1997", "year(start_time) = 1997", "year(start_time) > 1997"],
            lambda: jobs.to_table(stream(), out, checkpoint, jobs.ROCKS))
    return t.spark.read.parquet(out).select("game_id", *[F.round(f"{s}_rating", 5).alias(f"{s}_rating") for s in ("home", "away")],
                                            *[F.round(f"{s}_form", 6).alias(f"{s}_form") for s in ("home", "away")])
