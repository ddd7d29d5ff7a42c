"""File scans. Each query lands files derived from the given tables, then scans them."""

import uuid

from pyspark.sql import functions as F

from ..operators import asof, checks
from ..plans.session import shared_folder
from ..sources import ingest, sinks
from .registry import query, r6


def landing(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


_CSV = [
    ("Date", "CASE WHEN o_orderkey % 61 = 0 THEN '31/02/2020' WHEN o_orderkey % 67 = 1 THEN NULL ELSE date_format(o_orderdate, 'dd/MM/yyyy') END"),
    ("Time", "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'noon' ELSE concat(12 + o_orderkey % 9, ':30') END"),
    ("HomeTeam", "CASE WHEN o_orderkey % 71 = 3 THEN NULL WHEN o_custkey % 4 = 0 THEN 'Man. City & Co' ELSE concat('Club ', o_custkey % 9) END"),
    ("AwayTeam", "concat('Town ', o_orderkey % 7)"),
    ("FTR", "CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN ' d ' ELSE 'A' END WHEN 'P' THEN 'X' END"),
    ("FTHG", "CAST(o_custkey % 5 AS STRING)"), ("FTAG", "CASE WHEN o_custkey % 13 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 5 AS STRING) END"),
    ("B365H", "CAST(1 + (o_orderkey % 30) / 10D AS STRING)"), ("B365D", "CASE WHEN o_custkey % 6 > 0 THEN '3.5' END"), ("B365A", "'bad'"),
]


@query("ingest_results_csv", sql="""
WITH raw AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_custkey % 3 = 0 THEN '15:00' ELSE CASE o_orderkey % 5 WHEN 0 THEN '15:00' WHEN 1 THEN '15:00' ELSE
    (12 + o_orderkey % 9) || ':30' END END AS clock, CASE WHEN o_custkey % 4 = 0 THEN 'man-city-and-co' ELSE 'club-' || (o_custkey % 9) END AS home_key,
    'town-' || (o_orderkey % 7) AS away_key, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 END AS result FROM orders
  WHERE o_orderkey % 61 <> 0 AND o_orderkey % 67 <> 1 AND o_orderkey % 71 <> 3)
SELECT concat_ws(':', 'soccer', 'epl', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), home_key, away_key) AS id,
  CAST(timezone('UTC', timezone('Europe/London', CAST(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' ' || clock || ':00' AS TIMESTAMP))) AS VARCHAR)
    AS start_time, CASE WHEN result IS NULL THEN 'scheduled' ELSE 'final' END AS status,
  CASE WHEN result IS NOT NULL THEN CAST(o_custkey % 5 AS INTEGER) END AS home_score,
  CASE WHEN result IS NOT NULL AND o_custkey % 13 <> 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS away_score, CAST(result AS INTEGER) AS outcome,
  round(1 + (o_orderkey % 30) / 10, 3) AS price_home, CASE WHEN o_custkey % 6 > 0 THEN 3.5 END AS price_draw, CAST(NULL AS DOUBLE) AS price_away
FROM raw""")
def _(t):
    folder = landing(t, "results")
    orders = t.read("orders")
    older = [f"{e} AS {n}" for n, e in reversed(_CSV) if n != "Time"]  # another season: other order, no times
    orders.where("o_custkey % 3 > 0").selectExpr(*[f"{e} AS {n}" for n, e in _CSV]).write.option("header", True).csv(folder)
    orders.where("o_custkey % 3 = 0").selectExpr(*older).write.mode("append").option("header", True).csv(folder)
    rows = ingest.results_csv(t.spark, folder)
    return rows.select("id", F.col("start_time").cast("string").alias("start_time"), "status", "home_score", "away_score", "outcome",
                       F.round(F.col("odds")[0], 3).alias("price_home"), F.col("odds")[1].alias("price_draw"),
                       F.col("odds")[2].alias("price_away"))


@query("ingest_scoreboard_json", "games", """
SELECT concat_ws(':', 'soccer', 'epl', CAST(CAST(start_time AS DATE) AS VARCHAR), lower(home_key), lower(away_key)) AS id,
  CAST(start_time AS VARCHAR) AS start_time, CASE status WHEN 'live' THEN 'live' ELSE status END AS status,
  CASE WHEN status = 'final' THEN home_score END AS home_score, CASE WHEN status = 'final' THEN away_score END AS away_score,
  CASE WHEN status = 'final' THEN outcome END AS outcome
FROM games WHERE game_id % 31 <> 4 AND game_id % 37 <> 5""")
def _(t):
    folder = landing(t, "scoreboard")
    documents = _scoreboard_documents(t)
    documents.write.text(folder)
    rows = ingest.scoreboard_json(t.spark, folder, multi_line=False)
    return rows.select("id", F.col("start_time").cast("string").alias("start_time"), "status", "home_score", "away_score", "outcome")


def _scoreboard_documents(t):
    """One scoreboard document per event; some without competitions or without a home side."""
    games = t.games()

    def side(role):
        return F.struct(F.lit(role).alias("homeAway"), F.col(f"{role}_score").cast("string").alias("score"),
                        F.struct(F.col(f"{role}_key").alias("displayName")).alias("team"))

    competition = F.struct(
        F.concat(F.replace(F.col("start_time").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")).alias("date"),
        F.struct(F.struct(F.concat(F.lit("STATUS_"), F.upper("status")).alias("name"),
                          (F.col("status") == "final").alias("completed"), F.lit("pre").alias("state")).alias("type")).alias("status"),
        F.when(F.col("game_id") % 37 == 5, F.array(side("away"))).otherwise(F.array(side("away"), side("home"))).alias("competitors"))
    event = F.struct(F.when(F.col("game_id") % 31 != 4, F.array(competition)).alias("competitions"))
    return games.select(F.to_json(F.struct(F.array(event).alias("events"))).alias("value"))


@query("ingest_schedule_json", "games", """
SELECT 'baseball:mlb:' || game_id AS id, CAST(start_time + INTERVAL 1 HOUR AS VARCHAR) AS start_time, status,
  CASE WHEN shown THEN home_score END AS home_score, CASE WHEN shown THEN away_score END AS away_score,
  CASE WHEN status = 'final' AND shown THEN outcome END AS outcome
FROM (SELECT *, status = 'final' AND game_id % 19 <> 0 AS shown FROM games WHERE sport = 'baseball' AND game_id % 43 <> 1)""")
def _(t):
    games = t.games().where("sport = 'baseball'")

    def item(shift, resume):
        at = F.col("start_time") + F.expr(f"INTERVAL '{shift}' HOUR")
        teams = F.struct(*[F.struct(F.col(f"{r}_score").cast("string").alias("score"), F.struct(
            F.when(F.col("game_id") % 43 != 1, F.col(f"{r}_key")).alias("name")).alias("team")).alias(r) for r in ("home", "away")])
        return F.struct(F.col("game_id").alias("gamePk"),
                        F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")).alias("gameDate"),
                        F.when(resume, "2001-01-01").alias("resumeDate"), teams.alias("teams"),
                        F.struct(F.when(F.col("status") == "final", "Final").otherwise("Preview").alias("abstractGameState"),
                                 F.initcap("status").alias("detailedState")).alias("status"))

    never = F.lit(False)
    days = F.array(F.struct(F.array(item(0, F.col("game_id") % 19 == 0)).alias("games")), F.struct(F.array(item(1, never)).alias("games")))
    folder = landing(t, "schedule")
    games.select(F.to_json(F.struct(days.alias("dates"))).alias("value")).write.text(folder)
    rows = ingest.schedule_json(t.spark, folder, multi_line=False)
    return rows.select("id", F.col("start_time").cast("string").alias("start_time"), "status", "home_score", "away_score", "outcome")


@query("season_scan", "games", """, items AS (
  SELECT CASE WHEN game_id % 50 = 7 THEN game_id - 1 ELSE game_id END AS pk, CASE WHEN game_id % 13 = 0 THEN 'S' ELSE 'R' END AS game_type,
    status, game_id % 37 = 0 AS marked, CASE WHEN game_id % 61 <> 9 THEN start_time END AS start_time, home_score,
    CASE WHEN game_id % 19 = 0 THEN home_score ELSE away_score END AS away_score, game_id % 30 + 1 AS home_id,
    CASE WHEN game_id % 23 = 0 THEN game_id % 30 + 1 ELSE game_id % 31 + 40 END AS away_id, home_score > away_score AS home_winner,
    CASE WHEN game_id % 29 <> 0 THEN away_score > home_score END AS away_winner FROM games WHERE sport = 'baseball'),
 judged AS (SELECT *, CASE WHEN pk IN (SELECT pk FROM items WHERE marked) THEN 'resumed_or_suspended' WHEN game_type <> 'R' THEN 'nonregular'
    WHEN contains(status, 'postpon') OR contains(status, 'cancel') THEN 'unplayed' WHEN status <> 'final' THEN 'nonfinal' WHEN home_score = away_score THEN 'tie' END AS reason
  FROM items)
SELECT pk, home_id, away_id, CAST(start_time AS VARCHAR) AS start_time, reason, CASE WHEN reason IS NOT NULL THEN NULL
    WHEN home_score IS NULL OR away_score IS NULL THEN 'score' WHEN start_time IS NULL OR year(start_time) <> 1996 THEN 'season_year'
    WHEN home_id = away_id THEN 'same_team' WHEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY pk) > 1 THEN 'duplicate_id'
    WHEN away_winner IS NULL OR home_winner <> (home_score > away_score) OR away_winner <> (away_score > home_score) THEN 'winner_flag' END
    AS violation FROM judged""")
def _(t):
    games = t.games().where("sport = 'baseball'").withColumns({
        "pk": F.expr("CASE WHEN game_id % 50 = 7 THEN game_id - 1 ELSE game_id END"), "home_id": F.expr("game_id % 30 + 1"),
        "away_id": F.expr("CASE WHEN game_id % 23 = 0 THEN game_id % 30 + 1 ELSE game_id % 31 + 40 END"),
        "away_points": F.expr("CASE WHEN game_id % 19 = 0 THEN home_score ELSE away_score END"),
        "home_won": F.expr("home_score > away_score"), "away_won": F.expr("CASE WHEN game_id % 29 <> 0 THEN away_score > home_score END")})

    def side(score, won, team):
        return F.struct(F.col(score).alias("score"), F.col(won).alias("isWinner"), F.struct(F.col(team).alias("id")).alias("team"))

    item = F.struct(
        F.col("pk").alias("gamePk"), F.when(F.col("game_id") % 13 == 0, "S").otherwise("R").alias("gameType"),
        F.concat(F.replace(F.col("start_time").cast("string"), F.lit(" "), F.lit("T")),
                 F.when(F.col("game_id") % 61 != 9, "Z").otherwise("")).alias("gameDate"),
        F.when(F.col("game_id") % 37 == 0, "1996-09-01").alias("resumedFromDate"),
        F.struct(F.when(F.col("status") == "final", "Final").otherwise("Preview").alias("abstractGameState"),
                 F.initcap("status").alias("detailedState")).alias("status"),
        F.struct(side("home_score", "home_won", "home_id").alias("home"), side("away_points", "away_won", "away_id").alias("away")).alias("teams"))
    folder = landing(t, "season")
    games.select(F.to_json(F.struct(F.array(F.struct(F.array(item).alias("games"))).alias("dates"))).alias("value")).write.text(folder)
    rows = checks.season_rows(ingest.season_items(t.spark, folder, multi_line=False), 1996)
    return rows.select("pk", "home_id", "away_id", F.col("start_time").cast("string").alias("start_time"), "reason", "violation")


@query("ingest_odds", "quotes", f"""
SELECT record_id, sportsbook, CASE WHEN price_bad THEN 'price' END AS reason, CASE WHEN NOT price_bad THEN
  {r6("(1 / h) / (1 / h + 1 / a)")} END AS p_home, length(sha) AS digest_length
FROM (SELECT record_id, sportsbook, home_price % 7 = 0 AS price_bad, repeat('x', 64) AS sha,
  1 + CASE WHEN home_price > 0 THEN home_price / 100 ELSE 100 / abs(home_price) END AS h,
  1 + CASE WHEN away_price > 0 THEN away_price / 100 ELSE 100 / abs(away_price) END AS a FROM quotes)""")
def _(t):
    folder = landing(t, "odds")
    rows = t.quotes().select(
        "sportsbook", F.lit("moneyline").alias("market"), "price_format", "home_key", "away_key",
        F.when(F.col("home_price") % 7 == 0, F.lit("n/a")).otherwise(F.col("home_price").cast("string")).alias("home_price"),
        F.col("away_price").cast("string").alias("away_price"), F.lit("close").alias("quote_timing"),
        F.col("record_id").alias("provider_source_row_id"), F.lit("1999-01-01T00:00:00Z").alias("start_time"),
        F.col("true_game_id").alias("game_id"))
    half = F.pmod(F.xxhash64("provider_source_row_id"), F.lit(2)) == 0
    rows.where(half).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{folder}/a")
    wrapped = F.to_json(F.struct(F.array(F.struct(*rows.columns)).alias("records"), F.lit("book").alias("source")))
    rows.where(~half).select(wrapped.alias("value")).write.text(f"{folder}/b")
    raw = ingest.odds_json(t.spark, f"{folder}/*", multi_line=False)
    priced = raw.withColumns({c: F.col(c).try_cast("double") for c in ("home_price", "away_price")})
    cleaned = priced.withColumn("home_price", F.coalesce("home_price", F.lit(0.0)))
    out = checks.odds_records(cleaned, extra=("file",))
    files = ingest.file_manifest(t.spark, folder).select(F.col("path").alias("file"), "sha256")
    return out.join(files, "file").select("record_id", "sportsbook", "reason", F.round("p_home", 6).alias("p_home"),
                                          F.length("sha256").alias("digest_length"))


@query("run_catalogue", sql="""
SELECT 'r' || s_suppkey AS id, CAST(2000 + s_suppkey AS VARCHAR) AS created_at, CASE WHEN s_suppkey % 3 = 0 THEN 'complete' ELSE 'running' END
  AS status, 2 AS jobs, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS complete
FROM supplier WHERE s_suppkey % 5 <> 1 AND s_suppkey % 7 <> 2""")
def _(t):
    job = "struct('j{0}' AS id, CASE WHEN s_suppkey % 2 = 0 OR {0} = 1 THEN 'complete' ELSE 'failed' END AS status)"
    rows = t.read("supplier").selectExpr(
        "concat('r', s_suppkey) AS run",
        "CASE WHEN s_suppkey % 5 = 1 THEN 'not json' ELSE to_json(struct(concat('r', CASE WHEN s_suppkey % 7 = 2 THEN -1 ELSE s_suppkey END) AS id, "
        "cast(2000 + s_suppkey AS STRING) AS created_at, CASE WHEN s_suppkey % 3 = 0 THEN 'complete' ELSE 'running' END AS status, "
        f"array({job.format(1)}, {job.format(2)}) AS jobs)) END AS value")
    folder = landing(t, "runs")
    sinks.write_folders(rows, folder, "run", "value")
    return ingest.run_catalogue(t.spark, folder)


@query("prediction_sink", "forecasts", f"""
SELECT game_id, {r6("max(p_home) FILTER (model = 'm0')")} AS p_m0, {r6("max(p_home) FILTER (model = 'm1')")} AS p_m1,
  {r6("max(p_home) FILTER (model = 'm2')")} AS p_m2 FROM forecasts GROUP BY game_id""")
def _(t):
    wide = sinks.prediction_table(t.forecasts(), ["game_id"], "model", F.col("p_home"), ["m0", "m1", "m2"])
    folder = landing(t, "predictions")
    sinks.write_predictions(wide, folder)
    saved = t.spark.read.parquet(folder)
    return saved.select("game_id", *[F.round(c, 6).alias(c) for c in ("p_m0", "p_m1", "p_m2")])


_SAVED = """, saved AS (SELECT *, l_suppkey % 19 = 0 AS missing, CASE WHEN l_suppkey % 17 = 0 THEN 2 - outcome ELSE outcome END AS claimed FROM forecasts),
 facts AS (SELECT *, count(*) FILTER (NOT missing) OVER (PARTITION BY game_id, model, seed) AS repeats,
   min(claimed) FILTER (NOT missing) OVER (PARTITION BY game_id) AS low, max(claimed) FILTER (NOT missing) OVER (PARTITION BY game_id) AS high FROM saved)"""


@query("ingest_predictions", "forecasts", f"""{_SAVED}
SELECT format, model, reason, count(*) AS n FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'json' ELSE 'csv' END AS format, model,
  CASE WHEN missing THEN 'missing_field' WHEN l_suppkey % 13 = 0 THEN 'non_finite' WHEN l_suppkey % 11 = 0 THEN 'probabilities'
    WHEN claimed IS NULL THEN 'no_outcome' WHEN repeats > 1 THEN 'duplicate' WHEN low <> high THEN 'outcome_disagrees' ELSE 'valid' END AS reason
  FROM facts) GROUP BY ALL""")
def _(t):
    folder = landing(t, "saved")
    s = F.col("l_suppkey")
    p = [F.when(s % 11 == 0, F.col("p_home") * 1.5).otherwise(F.col("p_home")), F.when(s % 13 != 0, F.col("p_draw")), F.col("p_away")]
    rows = t.forecasts().select(
        s, F.when(s % 19 != 0, F.col("game_id")).alias("game_id"), "sport", "model", "seed",
        F.when(s % 17 == 0, 2 - F.col("outcome")).otherwise(F.col("outcome")).alias("outcome"),
        *[c.alias(n) for c, n in zip(p, ingest.PROBABILITIES)])
    record = F.struct("game_id", "sport", "model", "seed", "outcome", F.array(*ingest.PROBABILITIES).alias("probabilities"))
    even = rows.where(s % 2 == 0)
    even.select(F.to_json(F.array(record)).alias("value")).write.text(f"{folder}/json")
    text = [F.coalesce(F.col(n).cast("string"), F.lit("n/a")).alias(n) for n in ingest.PROBABILITIES]
    rows.where(s % 2 == 1).select("game_id", "sport", "model", "seed", "outcome", *text).write.option("header", True).csv(f"{folder}/csv")
    found = ingest.saved_predictions(t.spark, f"{folder}/json", f"{folder}/csv", multi_line=False)
    judged = checks.saved_prediction_rows(found)
    return judged.groupBy("format", "model", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("feature_sink", "games", "SELECT game_id, sport, coalesce(outcome, -1) AS label FROM games")
def _(t):
    folder = landing(t, "features")
    sinks.write_features(asof.pregame_features(t.games()), folder)
    return t.spark.read.parquet(folder).select("game_id", F.col("sport").cast("string").alias("sport"), "label")


@query("archive_names", sql="""
SELECT page_id, replace(replace(stamp, '-', ''), ':', '') || '-pages-' || substr(sha256(url), 1, 12) || '.html' AS name
FROM (SELECT page_id, url, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM pages)""")
def _(t):
    at = F.date_format(F.expr("timestampadd(SECOND, page_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.read("pages").select("page_id", sinks.archive_name(at, F.lit("pages"), F.col("url"), ".html").alias("name"))
