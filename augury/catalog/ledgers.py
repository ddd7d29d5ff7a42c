"""Ledgers, cohorts, manifests and ordered logs."""

from pyspark.sql import functions as F

from ..functions import probability
from ..operators import ledger
from .registry import query, r6
from .scoring import PICK, P_LABEL, TOP

NOW_TEXT = "1999-06-01 00:00:00"
SQL_NOW = f"TIMESTAMP '{NOW_TEXT}'"

# Current snapshot (some events missing) with the time each result was seen, and the ledger with damaged records.
_SNAPSHOT = """, snapshot AS (SELECT *, start_time + to_hours(source_key % 72 - 2) AS observed_at,
    sha256(concat_ws('|', sport, home_key, away_key, CAST(start_time AS VARCHAR))) AS revision
    FROM games WHERE game_id % 40 <> 0)"""
_PICKS = f"""{_SNAPSHOT}, base AS (SELECT forecast_id AS pick_id, game_id, sport, home_key, away_key, fixture_start,
    saved_at AS created_at, CASE WHEN l_suppkey % 9 = 3 THEN 2 - {PICK} ELSE {PICK} END AS pick, {PICK} AS best,
    {TOP} AS confidence, p_home, p_draw, p_away, model, seed, l_suppkey,
    sha256(concat_ws('|', sport, home_key, away_key, CAST(fixture_start AS VARCHAR))) AS revision FROM forecasts),
 picks AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_suppkey % 8 = 1),
 judged AS (SELECT p.*, s.game_id AS known, s.revision AS current_revision, CASE WHEN pick <> best OR created_at >
    {SQL_NOW} THEN 'invalid_or_nonforward_record' WHEN created_at >= fixture_start THEN 'at_or_after_kickoff'
    WHEN s.game_id IS NOT NULL AND p.revision <> s.revision THEN 'replaced_fixture_revision' END AS reason
  FROM picks p LEFT JOIN snapshot s USING (game_id)),
 good AS (SELECT DISTINCT * FROM judged WHERE reason IS NULL),
 first_good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY created_at, pick_id) AS rn,
    count(*) OVER (PARTITION BY game_id) AS revision_count FROM good) WHERE rn = 1),
 desk AS (SELECT f.game_id, f.sport, coalesce(s.league, '') AS league, pick_id, f.fixture_start AS start_time, confidence,
    p_home, p_draw, p_away, pick, revision_count, s.outcome,
    CASE WHEN s.game_id IS NULL THEN 'held' WHEN status = 'cancelled' THEN 'void' WHEN status = 'postponed' THEN 'held'
      WHEN status = 'final' AND s.start_time <= observed_at AND observed_at <= {SQL_NOW}
        THEN CASE WHEN pick = s.outcome THEN 'won' ELSE 'lost' END WHEN status = 'final' THEN 'held'
      WHEN status = 'scheduled' AND s.start_time > {SQL_NOW} THEN 'upcoming' ELSE 'pending' END AS state
  FROM first_good f LEFT JOIN snapshot s USING (game_id))"""


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def snapshot(t):
    return t.games().where("game_id % 40 <> 0").withColumn(
        "observed_at", F.expr("timestampadd(HOUR, cast(source_key % 72 - 2 AS INT), start_time)"))


def picks(t):
    p = probability.vector()
    best = probability.argmax(p)
    base = t.forecasts().select(
        F.col("forecast_id").alias("pick_id"), "game_id", "sport", "home_key", "away_key", "fixture_start",
        F.col("saved_at").alias("created_at"), p.alias("p"),
        F.when(F.col("l_suppkey") % 9 == 3, 2 - best).otherwise(best).alias("pick"),
        F.array_max(p).alias("confidence"), "model", "l_suppkey")
    copies = F.when(F.col("l_suppkey") % 8 == 1, 2).otherwise(1)
    return base.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def desk(t):
    return ledger.desk(picks(t), snapshot(t), now())


_STATE_SQL = """SELECT game_id, sport, league, pick_id, CAST(start_time AS VARCHAR) AS start_time,
  CASE pick WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS pick, {0} AS confidence, state,
  revision_count, CASE WHEN state IN ('won', 'lost') THEN outcome END AS outcome FROM desk""".format(r6("confidence"))


@query("desk", "forecasts", f"{_PICKS} {_STATE_SQL}")
def _(t):
    return desk(t).select("game_id", "sport", "league", "pick_id", F.col("start_time").cast("string").alias("start_time"),
                          "pick", F.round("confidence", 6).alias("confidence"), "state", "revision_count", "outcome")


@query("exclusions", "forecasts", f"""{_PICKS}
SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'duplicate_record', (SELECT count(*) FROM judged WHERE reason IS NULL) - (SELECT count(*) FROM good)
UNION ALL SELECT 'later_predictions_same_fixture', CAST(sum(revision_count - 1) AS BIGINT) FROM first_good""")
def _(t):
    return ledger.exclusions(picks(t), snapshot(t), now())


_SUM = f"""count(*) AS total, {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in
    ("upcoming", "pending", "held", "void", "won", "lost"))},
  {r6("count(*) FILTER (state = 'won') / nullif(count(*) FILTER (state IN ('won', 'lost')), 0)")} AS hit_rate,
  {r6("avg(confidence) FILTER (state IN ('won', 'lost'))")} AS mean_pick_probability,
  {r6(f"avg(-ln(greatest({P_LABEL}, 1e-12))) FILTER (state IN ('won', 'lost'))")} AS log_loss"""


@query("desk_summary", "forecasts", f"{_PICKS} SELECT sport, {_SUM} FROM desk GROUP BY GROUPING SETS ((), (sport))")
def _(t):
    out = ledger.desk_summary(desk(t))
    return out.select(*[F.round(c, 6).alias(c) if c in ("hit_rate", "mean_pick_probability", "log_loss") else F.col(c)
                        for c in out.columns])


@query("hit_curve", "forecasts", f"""{_PICKS}
SELECT row_number() OVER w AS n, game_id, CAST(start_time AS VARCHAR) AS start_time,
  CAST(sum(CASE WHEN state = 'won' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS wins,
  sum(CASE WHEN state = 'won' THEN 1 ELSE 0 END) OVER w / row_number() OVER w AS hit_rate,
  {r6("sum(confidence) OVER w / row_number() OVER w")} AS expected_rate
FROM desk WHERE state IN ('won', 'lost') WINDOW w AS (ORDER BY start_time, game_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return ledger.hit_curve(desk(t)).select(
        "n", "game_id", F.col("start_time").cast("string").alias("start_time"), "wins",
        "hit_rate", F.round("expected_rate", 6).alias("expected_rate"))


@query("first_pick", "forecasts", """SELECT game_id, forecast_id AS pick_id FROM (SELECT *, row_number() OVER (
  PARTITION BY game_id ORDER BY saved_at, forecast_id) AS rn FROM forecasts) WHERE rn = 1""")
def _(t):
    return ledger.first_pick(picks(t))


@query("latest_pick", "forecasts", """SELECT game_id, forecast_id AS pick_id, model FROM (SELECT *, row_number() OVER (
  PARTITION BY game_id ORDER BY saved_at DESC, forecast_id) AS rn FROM forecasts) WHERE rn = 1""")
def _(t):
    return ledger.latest_pick(picks(t), ["pick_id", "model"])


@query("upcoming_with_pick", "forecasts", f"""{_SNAPSHOT}, latest AS (SELECT * FROM (SELECT game_id, forecast_id, source_key
    + CASE WHEN l_suppkey % 6 = 0 THEN 1 ELSE 0 END AS feature, sha256(concat_ws('|', sport, home_key, away_key,
    CAST(fixture_start AS VARCHAR))) AS revision, model, row_number() OVER (PARTITION BY game_id, model ORDER BY saved_at DESC,
    forecast_id) AS rn FROM forecasts) WHERE rn = 1), models AS (SELECT DISTINCT model FROM forecasts)
SELECT s.game_id, m.model, s.sport, CAST(s.start_time AS VARCHAR) AS start_time, CASE WHEN l.revision = s.revision AND
  l.feature = s.source_key THEN forecast_id END AS pick_id
FROM snapshot s CROSS JOIN models m LEFT JOIN latest l ON l.game_id = s.game_id AND l.model = m.model WHERE status = 'scheduled' AND start_time > TIMESTAMP '1998-01-01'""")
def _(t):
    features = F.col("source_key").cast("string")
    games = snapshot(t).withColumn("feature_hash", F.sha2(features, 256))
    changed = F.when(F.col("l_suppkey") % 6 == 0, 1).otherwise(0)
    own = t.games().select("game_id", "source_key")
    rows = picks(t).join(own, "game_id").withColumn(
        "feature_hash", F.sha2((F.col("source_key") + changed).cast("string"), 256))
    out = ledger.upcoming_with_pick(games, rows, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("start_time", F.col("start_time").cast("string"))


_SCORES = f"""{_SNAPSHOT}, scores AS (SELECT forecast_id, f.game_id, model, f.sport, fixture_start, p_home, p_draw, p_away,
    CASE WHEN status = 'complete' THEN outcome END AS outcome, status,
    coalesce(CASE WHEN l_suppkey % 4 = 0 AND game_id % 3 = 0 THEN fixture_start + INTERVAL 1 HOUR END,
             CASE WHEN status = 'complete' THEN observed_at END) AS first_completed_at
  FROM (SELECT f.* EXCLUDE (status, outcome), s.outcome, observed_at,
    CASE WHEN s.game_id IS NULL THEN 'held' WHEN s.status = 'cancelled' THEN 'void'
      WHEN sha256(concat_ws('|', f.sport, f.home_key, f.away_key, CAST(fixture_start AS VARCHAR))) <> s.revision
        THEN 'superseded'
      WHEN saved_at >= s.start_time THEN 'late'
      WHEN s.status = 'final' AND s.start_time <= observed_at AND observed_at <= {SQL_NOW} THEN 'complete'
      WHEN s.status IN ('scheduled', 'live') THEN 'pending' ELSE 'held' END AS status
    FROM forecasts f LEFT JOIN snapshot s USING (game_id)) f)"""


def scores(t, current=None):
    rows = t.forecasts().withColumn("p", probability.vector())
    previous = rows.where("l_suppkey % 4 = 0 AND game_id % 3 = 0").select(
        "forecast_id", F.expr("timestampadd(HOUR, 1, fixture_start)").alias("first_completed_at"))
    return ledger.score_forecasts(rows, snapshot(t) if current is None else current, previous, now())


@query("score_forecasts", "forecasts", f"""{_SCORES}
SELECT forecast_id, model, sport, status, outcome, CAST(first_completed_at AS VARCHAR) AS first_completed_at
FROM scores""")
def _(t):
    return scores(t).select("forecast_id", "model", "sport", "status", "outcome",
                            F.col("first_completed_at").cast("string").alias("first_completed_at"))


_COHORT = f"""{_SCORES}, cohort AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, sport ORDER BY
    first_completed_at, fixture_start, forecast_id) AS rank, count(*) OVER (PARTITION BY model, sport) AS done,
    CASE sport WHEN 'soccer' THEN 100 ELSE 1000 END AS wanted FROM scores WHERE status = 'complete')
  WHERE done >= wanted AND rank <= wanted)"""
THRESHOLDS = {"soccer": 100, "baseball": 1000}


@query("cohort_freeze", "forecasts", f"{_COHORT} SELECT model, sport, rank, forecast_id FROM cohort")
def _(t):
    return ledger.cohort_freeze(scores(t), THRESHOLDS).select("model", "sport", "rank", "forecast_id")


@query("cohort_status", "forecasts", f"""{_COHORT}, later AS (SELECT c.model, c.sport, c.forecast_id, {P_LABEL} AS pl,
    {PICK} AS pick, outcome, game_id % 7 <> 0 AS alive FROM cohort c)
SELECT model, sport, count(*) AS members, count(*) FILTER (alive) AS eligible, count(*) FILTER (NOT alive) AS invalidated,
  {r6("avg(-ln(greatest(pl, 1e-12))) FILTER (alive)")} AS log_loss,
  {r6("avg(CASE WHEN pick = outcome THEN 1.0 ELSE 0 END) FILTER (alive)")} AS accuracy
FROM later GROUP BY ALL""")
def _(t):
    cohort = ledger.cohort_freeze(scores(t), THRESHOLDS)
    later = scores(t, snapshot(t).withColumn("status", F.when(F.col("game_id") % 7 == 0, "postponed")
                                             .otherwise(F.col("status"))))
    out = ledger.cohort_status(cohort, later)
    return out.select("model", "sport", "members", "eligible", "invalidated", F.round("log_loss", 6).alias("log_loss"),
                      F.round("accuracy", 6).alias("accuracy"))


@query("source_freshness", sql="""
WITH attempts AS (SELECT s_suppkey AS source_id, s_suppkey % 3 <> 0 AS succeeded, 200 + s_suppkey AS fetched_at,
    md5(s_name) AS digest FROM supplier WHERE s_suppkey % 5 <> 4),
 previous AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 4 <> 1 THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN s_suppkey % 4 <> 1 THEN 100 + s_suppkey END AS fetched_at, CASE WHEN s_suppkey % 4 <> 1
    THEN md5(s_name || 'old') END AS digest FROM supplier WHERE s_suppkey % 7 <> 6)
SELECT source_id, CASE WHEN a.source_id IS NULL THEN p.status WHEN succeeded THEN 'ok' WHEN p.fetched_at IS NOT NULL
  THEN 'stale' ELSE 'failed' END AS status, CASE WHEN succeeded THEN a.fetched_at ELSE p.fetched_at END AS fetched_at,
  CASE WHEN succeeded THEN a.digest ELSE p.digest END AS digest
FROM attempts a FULL JOIN previous p USING (source_id)""")
def _(t):
    supplier = t.read("supplier")
    attempts = supplier.where("s_suppkey % 5 <> 4").selectExpr(
        "s_suppkey AS source_id", "s_suppkey % 3 <> 0 AS succeeded", "200 + s_suppkey AS fetched_at", "md5(s_name) AS digest")
    previous = supplier.where("s_suppkey % 7 <> 6").selectExpr(
        "s_suppkey AS source_id", "CASE WHEN s_suppkey % 4 <> 1 THEN 'ok' ELSE 'failed' END AS status",
        "CASE WHEN s_suppkey % 4 <> 1 THEN 100 + s_suppkey END AS fetched_at",
        "CASE WHEN s_suppkey % 4 <> 1 THEN md5(concat(s_name, 'old')) END AS digest")
    return ledger.source_freshness(attempts, previous)


_STATE = "sha2(concat_ws(':', conv_id, floor(turn / 2), CASE WHEN (conv_id + turn) % 5 = 0 THEN text END), 256)"


@query("hash_chain", sql="""
SELECT chain, position, read_only, coalesce(read_only AND state <> lag(state) OVER (PARTITION BY chain ORDER BY position),
  false) AS broken
FROM (SELECT conv_id AS chain, turn AS position, role = 'assistant' AS read_only, sha256(concat_ws(':', conv_id,
  CAST(floor(turn / 2) AS BIGINT), CASE WHEN (conv_id + turn) % 5 = 0 THEN text END)) AS state FROM conversations)""")
def _(t):
    log = t.read("conversations").selectExpr("conv_id AS chain", "turn AS position", "role = 'assistant' AS read_only",
                                             f"{_STATE} AS state")
    return ledger.hash_chain(log)


@query("recovery_tail", "chain", """, ends AS (SELECT chain, max(position) AS last, sum(size) AS total FROM chain GROUP BY chain)
SELECT chain, CAST(any_value(total) AS BIGINT) AS total, CAST(sum(size) AS BIGINT) AS tail,
  sum(size) <= greatest(1.0, any_value(total) * 0.5) AS recovered
FROM chain JOIN ends USING (chain) WHERE position > last - 2 GROUP BY chain""")
def _(t):
    return ledger.recovery_tail(t.chain(), tail=2, share=0.5)


_JOURNAL = [
    ("journal", "conv_id"), ("seq", "turn"),
    ("position", "CAST(floor(turn / 3) AS BIGINT) + CASE WHEN conv_id % 11 = 3 AND turn = 3 THEN 1 ELSE 0 END"),
    ("status", "CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'failed' WHEN conv_id % 13 = 5 AND turn = 1 THEN 'unknown' "
               "WHEN turn % 3 = 0 THEN 'prepared' WHEN turn % 3 = 1 THEN 'intent' ELSE 'completed' END"),
    ("invoked", "turn % 3 >= 1 AND NOT (conv_id % 9 = 4 AND turn = 2) OR (conv_id % 17 = 2 AND turn = 0)"),
    ("identity", "concat('c', conv_id, '-', floor(turn / 3), CASE WHEN conv_id % 8 = 6 AND turn = 1 THEN 'x' ELSE '' END)"),
]


@query("journal_check", sql=f"""
SELECT journal, seq, CASE WHEN pp IS NULL AND position <> 0 THEN 'order'
  WHEN pp IS NOT NULL AND position NOT IN (pp, pp + 1) THEN 'order'
  WHEN position = pp + 1 AND ps <> 'completed' THEN 'follows_incomplete'
  WHEN (pp IS NULL OR position = pp + 1) AND NOT (status = 'prepared' AND NOT invoked) THEN 'missing_intent'
  WHEN position = pp AND ps IN ('completed', 'failed') THEN 'terminal_rewritten'
  WHEN position = pp AND identity <> pid THEN 'identity_changed'
  WHEN position = pp AND pin AND NOT invoked THEN 'invocation_decreased'
  WHEN status NOT IN ('prepared', 'intent', 'completed', 'failed') THEN 'unknown_state' END AS violation
FROM (SELECT *, lag(position) OVER w AS pp, lag(status) OVER w AS ps, lag(invoked) OVER w AS pin, lag(identity) OVER w AS pid
  FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in _JOURNAL)} FROM conversations)
  WINDOW w AS (PARTITION BY journal ORDER BY seq))""")
def _(t):
    return ledger.journal_check(t.read("conversations").selectExpr(*[f"{e} AS {n}" for n, e in _JOURNAL]))


@query("dataset_summary", "games", """
SELECT sport, status, count(*) AS games, count(outcome) AS finished FROM games GROUP BY GROUPING SETS ((sport), (status))""")
def _(t):
    return t.games().groupingSets([["sport"], ["status"]], "sport", "status").agg(
        F.count("*").alias("games"), F.count("outcome").alias("finished"))


@query("evidence_summary", "forecasts", f"""
SELECT model, count(*) AS rows, count(DISTINCT game_id) AS games, (SELECT count(DISTINCT t) FROM (SELECT model AS m2,
    home_key AS t FROM forecasts WHERE outcome IS NOT NULL UNION SELECT model, away_key FROM forecasts WHERE outcome IS NOT
    NULL) WHERE m2 = f.model) AS teams, {r6(f"avg(CASE WHEN {PICK} = outcome THEN 1.0 ELSE 0 END)")} AS accuracy,
  {r6(f"avg(-ln(greatest({P_LABEL}, 1e-12)))")} AS log_loss
FROM forecasts f WHERE outcome IS NOT NULL GROUP BY model""")
def _(t):
    rows = t.forecasts().where("outcome is not null").withColumn("p", probability.vector())
    hit = (probability.argmax(F.col("p")) == F.col("outcome")).cast("int")
    loss = probability.log_loss(probability.label_probability(F.col("p"), F.col("outcome")))
    headline = rows.groupBy("model").agg(F.count("*").alias("rows"), F.count_distinct("game_id").alias("games"),
                                         F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(loss), 6).alias("log_loss"))
    teams = rows.select("model", F.explode(F.array("home_key", "away_key")).alias("team")).groupBy("model").agg(
        F.count_distinct("team").alias("teams"))
    return headline.join(teams, "model")


@query("quote_select", "quotes", """, q AS (SELECT record_id, sportsbook, true_game_id AS game_id, quote_time, g.start_time,
    count(*) OVER (PARTITION BY sportsbook, true_game_id) AS quotes FROM quotes JOIN games g ON g.game_id = true_game_id),
 best AS (SELECT sportsbook, game_id, max(quote_time) AS latest FROM q WHERE quote_time <= start_time GROUP BY ALL),
 winners AS (SELECT sportsbook, game_id, min(record_id) AS id FROM q JOIN best b USING (sportsbook, game_id)
             WHERE quote_time = latest GROUP BY ALL HAVING count(*) = 1)
SELECT sportsbook, game_id, any_value(quotes) AS quotes, CASE WHEN any_value(quotes) = 1 THEN any_value(record_id)
  ELSE any_value(w.id) END AS record_id
FROM q LEFT JOIN winners w USING (sportsbook, game_id) GROUP BY ALL""")
def _(t):
    starts = t.games().select(F.col("game_id").alias("true_game_id"), "start_time")
    rows = t.quotes().select("record_id", "sportsbook", "true_game_id", "quote_time").join(starts, "true_game_id")
    return ledger.quote_select(rows.withColumnRenamed("true_game_id", "game_id"), ["sportsbook", "game_id"])
