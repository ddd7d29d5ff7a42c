"""As-of state, rolling form, ratings and the pre-event feature rows."""

from pyspark.sql import functions as F

from ..operators import asof, rating
from .registry import query, r6

# One update row per side of a usable final, with its running state, and the state seen by every asked day.
UPDATES = """, updates AS (
  SELECT *, CASE WHEN start_time + INTERVAL 48 HOUR = date_trunc('day', start_time + INTERVAL 48 HOUR)
                 THEN CAST(start_time + INTERVAL 48 HOUR AS DATE)
                 ELSE CAST(start_time + INTERVAL 72 HOUR AS DATE) END AS day FROM (
    SELECT game_id, sport, league, start_time, 'home' AS role, home_key AS team, home_score - away_score AS margin,
      CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE 0.5 END AS result
    FROM games WHERE outcome IS NOT NULL
    UNION ALL
    SELECT game_id, sport, league, start_time, 'away', away_key, away_score - home_score,
      CASE WHEN home_score > away_score THEN 0.0 WHEN home_score < away_score THEN 1.0 ELSE 0.5 END
    FROM games WHERE outcome IS NOT NULL)),
 asked AS (SELECT DISTINCT sport, league, home_key AS team, 'home' AS role, CAST(start_time AS DATE) AS day FROM games
    UNION SELECT DISTINCT sport, league, away_key, 'away', CAST(start_time AS DATE) FROM games)"""


def _running(name, keys, windows):
    forms = ", ".join(f"avg(result) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS form_{n}"
                      for n in windows)
    columns = ["games", "wins", "margin_sum", "last_day", *[f"form_{n}" for n in windows]]
    last = ", ".join(f"last_value({c} IGNORE NULLS) OVER q AS {c}" for c in columns)
    empty = ", ".join(f"NULL AS {c}" for c in columns)
    return f"""{name}_line AS (
      SELECT {keys}, day, 0 AS kind, start_time, game_id, count(*) OVER w AS games,
        sum(CASE WHEN result = 1 THEN 1 ELSE 0 END) OVER w AS wins, sum(margin) OVER w AS margin_sum,
        max(CAST(start_time AS DATE)) OVER w AS last_day, {forms}
      FROM updates WINDOW w AS (PARTITION BY {keys} ORDER BY start_time, game_id)
      UNION ALL SELECT DISTINCT {keys}, day, 1, NULL, NULL, {empty} FROM asked),
 {name} AS MATERIALIZED (SELECT * FROM (SELECT {keys}, day, kind, {last} FROM {name}_line
      WINDOW q AS (PARTITION BY {keys} ORDER BY day, kind, start_time, game_id)) WHERE kind = 1)"""


_TEAM = "sport, league, team"
STATES = UPDATES + ", " + _running("states", _TEAM, [5])
JOINED = """games g
  JOIN states h ON h.sport = g.sport AND h.league = g.league AND h.team = home_key AND h.day = CAST(start_time AS DATE)
  JOIN states a ON a.sport = g.sport AND a.league = g.league AND a.team = away_key AND a.day = CAST(start_time AS DATE)"""


def _rest(side):
    return f"coalesce(least(greatest(date_diff('day', {side}.last_day, CAST(start_time AS DATE)), 0), 14) / 14.0, 0)"


def _margin(side, typical="CASE WHEN g.sport = 'baseball' THEN 5.0 ELSE 3.0 END"):
    return f"coalesce(greatest(-1, least(1, {side}.margin_sum / {side}.games / ({typical}))), 0)"


FEATURES = {
    "home_form": "coalesce(h.form_5, 0.5)", "away_form": "coalesce(a.form_5, 0.5)",
    "form_diff": "coalesce(h.form_5, 0.5) - coalesce(a.form_5, 0.5)",
    "home_win_rate": "coalesce(h.wins / h.games, 0.5)", "away_win_rate": "coalesce(a.wins / a.games, 0.5)",
    "home_games_played": "least(coalesce(h.games, 0), 50) / 50.0",
    "away_games_played": "least(coalesce(a.games, 0), 50) / 50.0",
    "home_rest_days": _rest("h"), "away_rest_days": _rest("a"), "rest_diff": f"{_rest('h')} - {_rest('a')}",
    "home_avg_margin": _margin("h"), "away_avg_margin": _margin("a"),
    "is_baseball": "CASE WHEN g.sport = 'baseball' THEN 1.0 ELSE 0.0 END",
}


@query("asof_state", "games", f"""{STATES}
SELECT sport, league, team, CAST(day AS DATE) AS day, coalesce(games, 0) AS games,
       CAST(coalesce(wins, 0) AS BIGINT) AS wins, CAST(coalesce(margin_sum, 0) AS BIGINT) AS margin, last_day
FROM states""")
def _(t):
    states = asof.team_states(t.games())
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("games", "wins", "margin")]
    return states.select("sport", "league", "team", "day", *zero, "last_day")


@query("team_form", "games", f"""{STATES}
SELECT game_id, {r6("coalesce(h.form_5, 0.5)")} AS home_form, {r6("coalesce(a.form_5, 0.5)")} AS away_form
FROM {JOINED}""")
def _(t):
    rows = asof.attach(t.games(), asof.team_states(t.games()), ["recent"])
    return rows.select("game_id", *[F.round(asof.form(F.col(f"{s}_recent"), 5), 6).alias(f"{s}_form")
                                    for s in ("home", "away")])


@query("team_cumulative", "games", f"""{STATES}
SELECT game_id, {", ".join(f"{r6(FEATURES[c])} AS {c}" for c in ("home_win_rate", "away_win_rate",
    "home_games_played", "away_games_played", "home_avg_margin", "away_avg_margin"))} FROM {JOINED}""")
def _(t):
    names = ["home_win_rate", "away_win_rate", "home_games_played", "away_games_played", "home_avg_margin",
             "away_avg_margin"]
    return asof.pregame_features(t.games()).select("game_id", *[F.round(n, 6).alias(n) for n in names])


@query("team_rest", "games", f"""{STATES}
SELECT game_id, {r6(_rest("h"))} AS home_rest, {r6(_rest("a"))} AS away_rest,
  {r6("coalesce(1 - exp(-greatest(date_diff('day', h.last_day, CAST(start_time AS DATE)), 0) / 3.0), 0)")}
    AS home_recovery FROM {JOINED}""")
def _(t):
    rows = asof.attach(t.games(), asof.team_states(t.games(), 1), ["last_day"])
    return rows.select("game_id", F.round(asof.rest("home"), 6).alias("home_rest"),
                       F.round(asof.rest("away"), 6).alias("away_rest"),
                       F.round(asof.rest("home", "recovery"), 6).alias("home_recovery"))


@query("delayed_wins", "games", f"""{STATES}
SELECT game_id, CAST(coalesce(h.wins, 0) AS BIGINT) AS home_wins, CAST(coalesce(a.wins, 0) AS BIGINT) AS away_wins
FROM {JOINED}""")
def _(t):
    return asof.delayed_wins(t.games())


@query("pregame_features_unrated", "games", f"""{STATES}
SELECT game_id, g.sport, g.league, coalesce(outcome, -1) AS label, {", ".join(f"{r6(e)} AS {n}"
                                                                    for n, e in FEATURES.items())} FROM {JOINED}""")
def _(t):
    rows = asof.pregame_features(t.games())
    return rows.select("game_id", "sport", "league", "label", *[F.round(n, 6).alias(n) for n in FEATURES])


_RATED = f""", numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY sport, league ORDER BY start_time, game_id) AS rn,
    CASE WHEN sport = 'baseball' THEN 16.0 ELSE 24.0 END AS step,
    CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0 ELSE 0.5 END AS home_result,
    CASE WHEN start_time + INTERVAL 48 HOUR = date_trunc('day', start_time + INTERVAL 48 HOUR)
         THEN CAST(start_time + INTERVAL 48 HOUR AS DATE) ELSE CAST(start_time + INTERVAL 72 HOUR AS DATE) END
      AS ready_day
  FROM games WHERE outcome IS NOT NULL),
 walk AS (
  SELECT sport, league, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS game_id, CAST(NULL AS DOUBLE) AS home_rating,
    CAST(NULL AS DOUBLE) AS away_rating, list_transform(range(12), lambda x: 1500.0::DOUBLE) AS ratings
  FROM (SELECT DISTINCT sport, league FROM numbered)
  UNION ALL
  SELECT sport, league, rn, game_id, hr + move, ar - move,
    list_transform(ratings, lambda r, i: CASE WHEN i = hi THEN hr + move WHEN i = ai THEN ar - move ELSE r END)
  FROM (SELECT *, step * (home_result - 1.0 / (1.0 + pow(10.0, (ar - hr) / 400.0))) AS move FROM (
    SELECT w.sport, w.league, n.rn, n.game_id, n.step, n.home_result, w.ratings,
      CAST(substr(home_key, 2) AS INTEGER) + 1 AS hi, CAST(substr(away_key, 2) AS INTEGER) + 1 AS ai,
      w.ratings[CAST(substr(home_key, 2) AS INTEGER) + 1] AS hr, w.ratings[CAST(substr(away_key, 2) AS INTEGER) + 1] AS ar
    FROM walk w JOIN numbered n ON n.sport = w.sport AND n.league = w.league AND n.rn = w.rn + 1))),
 rated AS MATERIALIZED (SELECT w.game_id, n.sport, n.league, n.home_key, n.away_key, n.start_time, n.ready_day, home_rating,
      away_rating FROM walk w JOIN numbered n USING (game_id))"""


@query("team_rating", "games", f"""{_RATED}
SELECT game_id, {r6("home_rating", 5)} AS home_rating, {r6("away_rating", 5)} AS away_rating FROM rated""",
       recursive=True)
def _(t):
    return rating.rating_updates(t.games()).select("game_id", F.round("home_rating", 5).alias("home_rating"),
                                                   F.round("away_rating", 5).alias("away_rating"))


@query("pregame_features", "games", f"""{_RATED}, {STATES[2:]},
 rating_line AS (
  SELECT sport, league, home_key AS team, ready_day AS day, 0 AS kind, start_time, game_id, home_rating AS rating
  FROM rated UNION ALL SELECT sport, league, away_key, ready_day, 0, start_time, game_id, away_rating FROM rated
  UNION ALL SELECT DISTINCT sport, league, team, day, 1, NULL, NULL, NULL FROM asked),
 ratings AS MATERIALIZED (SELECT * FROM (SELECT sport, league, team, day, kind, last_value(rating IGNORE NULLS) OVER (
    PARTITION BY sport, league, team ORDER BY day, kind, start_time, game_id) AS rating FROM rating_line)
    WHERE kind = 1)
SELECT g.game_id, g.sport, g.league, coalesce(outcome, -1) AS label,
  {r6("coalesce(hr.rating, 1500) / 2000")} AS home_elo, {r6("coalesce(ar.rating, 1500) / 2000")} AS away_elo,
  {r6("(coalesce(hr.rating, 1500) - coalesce(ar.rating, 1500)) / 400")} AS elo_diff,
  {", ".join(f"{r6(e)} AS {n}" for n, e in FEATURES.items())}
FROM {JOINED}
  JOIN ratings hr ON hr.sport = g.sport AND hr.league = g.league AND hr.team = home_key AND hr.day = h.day
  JOIN ratings ar ON ar.sport = g.sport AND ar.league = g.league AND ar.team = away_key AND ar.day = a.day""",
       recursive=True)
def _(t):
    games = t.games()
    rows = asof.pregame_features(games, rating.team_ratings(games))
    return rows.select("game_id", "sport", "league", "label",
                       *[F.round(n, 6).alias(n) for n in ("home_elo", "away_elo", "elo_diff", *FEATURES)])


_WINDOWS = [3, 5, 10, 20, 40]


def _sweep_sql():
    columns = []
    for side, pooled, role in (("home", "h", "hr"), ("away", "a", "ar")):
        for history, alias in (("pooled", pooled), ("role", role)):
            columns += [f"{r6(f'coalesce({alias}.form_{n}, 0.5)')} AS {side}_form_{n}_{history}" for n in _WINDOWS]
            columns += [f"{r6(f'coalesce({alias}.wins / {alias}.games, 0.5)')} AS {side}_rate_{history}",
                        f"{r6(f'least(coalesce({alias}.games, 0), 50) / 50.0')} AS {side}_games_{history}",
                        f"{r6(_margin(alias, '5.0'))} AS {side}_margin_{history}"]
        days = f"greatest(date_diff('day', {pooled}.last_day, CAST(start_time AS DATE)), 0)"
        columns += [f"{r6(_rest(pooled))} AS {side}_rest_capped",
                    f"{r6(f'coalesce(1 - exp(-{days} / 3.0), 0)')} AS {side}_rest_recovery"]
    body = UPDATES + ", " + _running("states", _TEAM, _WINDOWS) + ", " + _running("roles", _TEAM + ", role", _WINDOWS)
    joins = JOINED + "".join(
        f" JOIN roles {a} ON {a}.sport = g.sport AND {a}.league = g.league AND {a}.team = {s}_key AND "
        f"{a}.role = '{s}' AND {a}.day = CAST(start_time AS DATE)" for a, s in (("hr", "home"), ("ar", "away")))
    return f"{body} SELECT game_id, {', '.join(columns)} FROM {joins}"


@query("feature_config", "games", _sweep_sql())
def _(t):
    rows = asof.sweep_features(t.games())
    skip = ("game_id", "sport", "league", "start_time", "status", "outcome")
    return rows.select("game_id", *[F.round(c, 6).alias(c) for c in rows.columns if c not in skip])
