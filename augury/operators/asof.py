"""Availability as-of team state: a row on UTC day D sees only results available by D's midnight.

Results are first reduced to one row per (state key, available day): counts, sums and the last N results of that
day. Running state is then a window over calendar days, so a team that owns a third of all events still yields at
most one window row per day. The lookup is an equi-join on (state key, day), not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixtures import available_day, usable_final
from ..functions.probability import rest_scale

TEAM = ["sport", "league", "team"]
STATE = ["games", "wins", "margin", "last_day", "recent"]


def sides(games: DataFrame, delay_hours: int = 48) -> DataFrame:
    """Two update rows (home and away view) per usable final."""
    margin = F.col("home_score") - F.col("away_score")
    result = F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5)

    def side(role: str, team: str, sign: int, value: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(team).alias("team"), value.alias("result"),
                        (margin * sign).alias("margin"))

    return games.where(usable_final()).select(
        "game_id", "sport", "league", "start_time", F.col("start_time").cast("date").alias("played"),
        available_day(F.col("start_time"), delay_hours).alias("day"),
        F.inline(F.array(side("home", "home_key", 1, result), side("away", "away_key", -1, 1 - result))))


def daily_totals(updates: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Per available day: games, wins, margin, last played day and the last ``longest`` results.

    Both halves combine inside the map tasks: sums partially, results by the group limit on ``row_number``.
    """
    day_keys = [*keys, "day"]
    totals = updates.groupBy(*day_keys).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("result") == 1).alias("wins"),
        F.sum("margin").alias("margin"), F.max("played").alias("last_day"))
    newest = Window.partitionBy(*day_keys).orderBy(F.desc("start_time"), F.desc("game_id"))
    recent = (updates.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= longest)
              .groupBy(*day_keys).agg(F.array_sort(F.collect_list(F.struct("start_time", "game_id", "result")))
                                      .alias("recent")))
    return totals.join(recent, day_keys)


def _timeline(daily: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Day rows (kind 0) and asked days (kind 1) of every state key, placed together by one exchange."""
    rows = daily.withColumn("_kind", F.lit(0)).unionByName(
        asked.select(*keys, "day").distinct().withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition(*keys)


def _latest(line: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Latest day row at or before each asked day; columns are null when there is none."""
    order = Window.partitionBy(*keys).orderBy("day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(F.col("_kind") == 0, F.struct(*columns))
    return (line.withColumn("_s", F.last(packed, ignorenulls=True).over(order)).where("_kind = 1")
            .select(*keys, "day", *[F.col(f"_s.{c}").alias(c) for c in columns]))


def states_as_of(updates: DataFrame, asked: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Running state seen by every asked (keys, day). All windows run over days and share one partitioning."""
    line = _timeline(daily_totals(updates, keys, longest), asked, keys)
    own = Window.partitionBy(*keys, "_kind").orderBy("day")
    upto, last = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(-(longest - 1), 0)
    values = F.transform(F.flatten(F.collect_list("recent").over(last)), lambda r: r["result"])
    running = line.select(
        *keys, "day", "_kind", *[F.sum(c).over(upto).alias(c) for c in ("games", "wins", "margin")],
        F.max("last_day").over(upto).alias("last_day"), values.alias("_v"))
    sliced = F.slice("_v", F.greatest(F.size("_v") - longest, F.lit(0)) + 1, longest)
    return _latest(running.withColumn("recent", sliced), keys, STATE)


def as_of(daily: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Latest row of a (keys, day) table at or before each asked (keys, day)."""
    columns = [c for c in daily.columns if c not in (*keys, "day")]
    return _latest(_timeline(daily, asked, keys), keys, columns)


def asked_days(games: DataFrame) -> DataFrame:
    """Every (team, day) some event needs a state for; ``role`` is kept for role-specific states."""
    side = [F.struct(F.lit(r).alias("role"), F.col(f"{r}_key").alias("team")) for r in ("home", "away")]
    return games.select("sport", "league", F.col("start_time").cast("date").alias("day"), F.inline(F.array(*side)))


def attach(games: DataFrame, states: DataFrame, columns: list[str], with_role: bool = False) -> DataFrame:
    """Join a state table to both sides of every event as home_*/away_* columns."""
    out = games.withColumn("day", F.col("start_time").cast("date"))
    for role in ("home", "away"):
        rows = states.where(F.col("role") == role) if with_role else states
        named = rows.select("sport", "league", F.col("team").alias(f"{role}_key"), "day",
                            *[F.col(c).alias(f"{role}_{c}") for c in columns])
        out = out.join(named, ["sport", "league", f"{role}_key", "day"], "left")
    return out


def team_states(games: DataFrame, form: int = 5, delay_hours: int = 48) -> DataFrame:
    """State of every asked (sport, league, team, day)."""
    return states_as_of(sides(games, delay_hours), asked_days(games), TEAM, form)


# --- feature columns -------------------------------------------------------------------------------------------

def form(recent: Column, window: int) -> Column:
    """Mean of the last ``window`` results, 0.5 before any result."""
    tail = F.slice(recent, F.greatest(F.size(recent) - window, F.lit(0)) + 1, window)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    return F.when(F.coalesce(F.size(recent), F.lit(0)) > 0, mean).otherwise(0.5)


def win_rate(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_wins") / F.col(f"{side}_games"), F.lit(0.5))


def games_scale(side: str) -> Column:
    return F.least(F.coalesce(F.col(f"{side}_games"), F.lit(0)), F.lit(50)) / 50.0


def margin_scale(side: str, typical: Column) -> Column:
    mean = F.col(f"{side}_margin") / F.col(f"{side}_games") / typical
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)), F.lit(0.0))


def rest(side: str, transform: str = "capped") -> Column:
    return rest_scale(F.datediff("day", f"{side}_last_day"), transform)


def pregame_features(games: DataFrame, ratings: DataFrame | None = None, form_window: int = 5) -> DataFrame:
    """The sixteen-column pre-event feature row (thirteen without ratings) and the label (-1 = not usable)."""
    rows = attach(games, team_states(games, form_window), STATE)
    if ratings is not None:
        rows = attach(rows, ratings, ["rating"])
    typical = F.when(F.col("sport") == "baseball", 5.0).otherwise(3.0)
    form_of = {s: form(F.col(f"{s}_recent"), form_window) for s in ("home", "away")}
    rest_of = {s: rest(s) for s in ("home", "away")}
    columns = {}
    if ratings is not None:
        rate = {s: F.coalesce(F.col(f"{s}_rating"), F.lit(1500.0)) for s in ("home", "away")}
        columns |= {"home_elo": rate["home"] / 2000, "away_elo": rate["away"] / 2000,
                    "elo_diff": (rate["home"] - rate["away"]) / 400}
    columns |= {
        "home_form": form_of["home"], "away_form": form_of["away"], "form_diff": form_of["home"] - form_of["away"],
        "home_win_rate": win_rate("home"), "away_win_rate": win_rate("away"),
        "home_games_played": games_scale("home"), "away_games_played": games_scale("away"),
        "home_rest_days": rest_of["home"], "away_rest_days": rest_of["away"],
        "rest_diff": rest_of["home"] - rest_of["away"],
        "home_avg_margin": margin_scale("home", typical), "away_avg_margin": margin_scale("away", typical),
        "is_baseball": (F.col("sport") == "baseball").cast("double")}
    label = F.when(usable_final(), F.col("outcome")).otherwise(-1)
    return rows.select("game_id", "sport", "league", "start_time", label.alias("label"),
                       *[c.alias(n) for n, c in columns.items()])


def role_states(games: DataFrame, longest: int = 40) -> tuple[DataFrame, DataFrame]:
    """(pooled, role-specific) states with enough recent results for every swept form window."""
    updates = sides(games)
    asked = asked_days(games)
    by_role = [*TEAM, "role"]
    return states_as_of(updates, asked, TEAM, longest), states_as_of(updates, asked, by_role, longest)


def sweep_features(games: DataFrame, windows: tuple[int, ...] = (3, 5, 10, 20, 40), ratings: DataFrame | None = None) -> DataFrame:
    """All swept histories in one pass: pooled and role-specific columns, every form window, every rest transform; with
    ``ratings`` the rating columns too."""
    pooled, by_role = role_states(games, max(windows))
    # Forms belong to a (team, day), of which there are far fewer than events, and are narrower than the results.
    forms = [form(F.col("recent"), w).alias(f"form_{w}") for w in windows]
    plain = [c for c in STATE if c != "recent"]
    names = [*plain, *[f"form_{w}" for w in windows]]
    rows = attach(games, pooled.select(*TEAM, "day", *plain, *forms), names)
    renamed = by_role.select(*TEAM, "role", "day", *plain, *forms).withColumnsRenamed({c: f"role_{c}" for c in names})
    rows = attach(rows, renamed, [f"role_{c}" for c in names], with_role=True)
    typical = F.lit(5.0)
    columns = {}
    if ratings is not None:
        rows = attach(rows, ratings, ["rating"])
        rate = {s: F.coalesce(F.col(f"{s}_rating"), F.lit(1500.0)) for s in ("home", "away")}
        columns = {f"{s}_elo": r / 2000 for s, r in rate.items()} | {"elo_diff": (rate["home"] - rate["away"]) / 400}
    for side in ("home", "away"):
        for history, prefix in (("pooled", side), ("role", f"{side}_role")):
            for window in windows:
                columns[f"{side}_form_{window}_{history}"] = F.coalesce(f"{prefix}_form_{window}", F.lit(0.5))
            columns[f"{side}_rate_{history}"] = win_rate(prefix)
            columns[f"{side}_games_{history}"] = games_scale(prefix)
            columns[f"{side}_margin_{history}"] = margin_scale(prefix, typical)
        for transform in ("capped", "recovery"):
            columns[f"{side}_rest_{transform}"] = rest(side, transform)
    return rows.select("game_id", "sport", "league", "start_time", "status", "outcome",
                       *[c.alias(n) for n, c in columns.items()])


def delayed_wins(games: DataFrame) -> DataFrame:
    """Wins each side had when the event's day began."""
    rows = attach(games, team_states(games, 1), ["wins"])
    return rows.select("game_id", *[F.coalesce(f"{s}_wins", F.lit(0)).alias(f"{s}_wins") for s in ("home", "away")])
