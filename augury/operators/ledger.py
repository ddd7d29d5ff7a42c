"""Append-only forecast ledgers: first valid forecast, scoring against results, cohorts, order audits.

Ledger rows are reduced per (event, revision) before they meet the event table, so an event with a huge number of
saved forecasts costs one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixtures import OUTCOME_NAMES, revision
from ..functions.probability import argmax, label_probability, log_loss, valid_vector
from ..plans.ordered import first_rows, ranked
from .checks import first_reason


def fixture_of(start: str) -> Column:
    return revision(F.col("sport"), F.col("home_key"), F.col("away_key"), F.col(start))


def resolvable(now: Column) -> Column:
    """Consistent final scores seen between the start and now; baseball has no tie."""
    home, away = F.col("home_score"), F.col("away_score")
    implied = F.when(home > away, 0).when(home < away, 2).otherwise(1)
    good = ((home >= 0) & (away >= 0) & (F.col("start_time") <= F.col("observed_at")) & (F.col("observed_at") <= now)
            & (F.col("outcome") == implied) & ((F.col("sport") != "baseball") | (F.col("outcome") != 1)))
    return F.coalesce(good, F.lit(False))


def pick_reason(now: Column) -> Column:
    """Why a saved pick cannot count, before looking at the current event."""
    p = F.col("p")
    return first_reason([
        (~valid_vector(p, F.col("sport")) | (F.col("pick") != argmax(p))
         | (F.abs(F.col("confidence") - F.array_max(p)) > 1e-5) | (F.col("created_at") > now),
         "invalid_or_nonforward_record"),
        (F.col("created_at") >= F.col("fixture_start"), "at_or_after_kickoff")])


def _by_revision(picks: DataFrame, now: Column) -> DataFrame:
    rows = picks.select("*", pick_reason(now).alias("reason"), fixture_of("fixture_start").alias("revision"))
    good = F.col("reason").isNull()
    first = F.min_by(F.struct("pick_id", "created_at", "fixture_start", "sport", "p", "pick", "confidence"),
                     F.when(good, F.struct("created_at", "pick_id")))
    return rows.groupBy("game_id", "revision").agg(
        F.count_if(F.col("reason") == "invalid_or_nonforward_record").alias("invalid"),
        F.count_if(F.col("reason") == "at_or_after_kickoff").alias("late"),
        F.count_if(good).alias("rows"), F.count_distinct(F.when(good, F.col("pick_id"))).alias("picks"),
        first.alias("first"))


def _against_events(picks: DataFrame, games: DataFrame, now: Column) -> DataFrame:
    current = games.select("*", fixture_of("start_time").alias("current_revision"), F.lit(True).alias("known"))
    shown = current.drop("home_key", "away_key").withColumnRenamed("sport", "game_sport")
    joined = _by_revision(picks, now).join(shown, "game_id", "left")
    return joined.withColumn("replaced", F.col("known").isNotNull()
                             & (F.col("revision") != F.col("current_revision")))


def exclusions(picks: DataFrame, games: DataFrame, now: Column) -> DataFrame:
    """How many saved picks were left out, by reason."""
    rows = _against_events(picks, games, now)
    kept = ~F.col("replaced")
    per_game = rows.groupBy("game_id").agg(
        F.sum("invalid").alias("invalid_or_nonforward_record"), F.sum("late").alias("at_or_after_kickoff"),
        F.sum(F.when(F.col("replaced"), F.col("rows")).otherwise(0)).alias("replaced_fixture_revision"),
        F.sum(F.when(kept, F.col("rows") - F.col("picks")).otherwise(0)).alias("duplicate_record"),
        F.greatest(F.sum(F.when(kept, F.col("picks")).otherwise(0)) - 1, F.lit(0)).alias("later_predictions_same_fixture"))
    names = [c for c in per_game.columns if c != "game_id"]
    totals = per_game.agg(*[F.sum(c).alias(c) for c in names])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).alias("n")) for c in names]))
                         ).where("n > 0")


def desk(picks: DataFrame, games: DataFrame, now: Column) -> DataFrame:
    """First valid pick per current event revision with its state."""
    rows = _against_events(picks, games, now).where("picks > 0 AND NOT replaced")
    event = ["status", "start_time", "home_score", "away_score", "outcome", "observed_at", "known", "league", "game_sport"]
    one = rows.groupBy("game_id").agg(
        F.min_by("first", F.struct("first.created_at", "first.pick_id")).alias("pick"),
        F.sum("picks").alias("revision_count"), *[F.first(c).alias(c) for c in event])
    one = one.withColumn("sport", F.col("game_sport"))
    won = F.col("pick.pick") == F.col("outcome")
    status, done = F.col("status"), resolvable(now)
    state = (F.when(F.col("known").isNull(), "held").when(status == "cancelled", "void")
             .when(status == "postponed", "held")
             .when((status == "final") & done, F.when(won, "won").otherwise("lost")).when(status == "final", "held")
             .when((status == "scheduled") & (F.col("start_time") > now), "upcoming")
             .when(status.isin("live", "scheduled"), "pending").otherwise("held"))
    names = F.array(*[F.lit(n) for n in OUTCOME_NAMES])
    return one.select(
        "game_id", F.col("pick.sport").alias("sport"), F.coalesce("league", F.lit("")).alias("league"),
        F.col("pick.pick_id").alias("pick_id"), F.col("pick.fixture_start").alias("start_time"),
        F.col("pick.p").alias("p"), F.element_at(names, F.col("pick.pick") + 1).alias("pick"),
        F.col("pick.confidence").alias("confidence"), state.alias("state"), "revision_count",
        F.when(state.isin("won", "lost"), F.col("outcome")).alias("outcome"))


def desk_summary(rows: DataFrame) -> DataFrame:
    """Ledger totals over all rows and per sport in one pass (sport is null for the total)."""
    done = F.col("state").isin("won", "lost")
    loss = F.when(done, log_loss(label_probability(F.col("p"), F.col("outcome"))))
    slim = rows.select("sport", "state", F.when(done, F.col("confidence")).alias("expected"), loss.alias("loss"))
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("upcoming", "pending", "held", "void", "won", "lost")]
    return slim.groupingSets([[], ["sport"]], "sport").agg(
        F.count(F.lit(1)).alias("total"), *states,
        (F.count_if(F.col("state") == "won") / F.nullif(F.count("expected"), F.lit(0))).alias("hit_rate"),
        F.avg("expected").alias("mean_pick_probability"), F.avg("loss").alias("log_loss"))


def hit_curve(rows: DataFrame) -> DataFrame:
    """Cumulative hits against expectation in (start, event) order; the order is ranked in slices."""
    done = rows.where("state in ('won', 'lost')").select(
        "game_id", "start_time", (F.col("state") == "won").cast("long").alias("won"), "confidence")
    out = ranked(done, [], [F.col("start_time"), F.col("game_id")], "n", {"wins": "won", "expected": "confidence"})
    return out.select("n", "game_id", "start_time", "wins", (F.col("wins") / F.col("n")).alias("hit_rate"),
                      (F.col("expected") / F.col("n")).alias("expected_rate"))


def first_pick(picks: DataFrame) -> DataFrame:
    return picks.groupBy("game_id").agg(F.min_by("pick_id", F.struct("created_at", "pick_id")).alias("pick_id"))


def latest_pick(picks: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Latest row per event (and ``by``); among equal times the smallest id."""
    first = F.min_by(F.struct(*columns), F.col("pick_id")).alias("_l")
    at_time = picks.groupBy("game_id", *by, "created_at").agg(first)
    return at_time.groupBy("game_id", *by).agg(F.max_by("_l", "created_at").alias("_l")).select("game_id", *by, "_l.*")


def upcoming_with_pick(games: DataFrame, picks: DataFrame, now: Column) -> DataFrame:
    """Upcoming events with the latest pick of every model, only if features and revision still match."""
    models = picks.select("model").distinct().agg(F.array_sort(F.collect_list("model"))).scalar()
    upcoming = games.where((F.col("status") == "scheduled") & (F.col("start_time") > now)).withColumn(
        "current_revision", fixture_of("start_time")).select("*", models.alias("_models")).withColumn("model", F.explode("_models"))
    rows = picks.withColumn("revision", fixture_of("fixture_start"))
    latest = latest_pick(rows, ["pick_id", "revision", "feature_hash"], ("model",)).withColumnRenamed(
        "feature_hash", "pick_features")
    joined = upcoming.join(latest, ["game_id", "model"], "left")
    fresh = (F.col("revision") == F.col("current_revision")) & (F.col("pick_features") == F.col("feature_hash"))
    return joined.select("game_id", "model", "sport", "start_time", F.when(fresh, F.col("pick_id")).alias("pick_id"))


def score_forecasts(forecasts: DataFrame, games: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Status of every saved forecast against the current events; the first completion time is kept."""
    current = games.select(
        "game_id", "status", "start_time", "home_score", "away_score", "outcome", "observed_at",
        fixture_of("start_time").alias("current_revision"), F.lit(True).alias("known"))
    own = forecasts.select("forecast_id", "game_id", "model", "sport", "saved_at", "fixture_start", "p",
                           fixture_of("fixture_start").alias("revision"))
    rows = own.join(current, "game_id", "left").join(previous, "forecast_id", "left")
    status = (F.when(F.col("known").isNull(), "held").when(F.col("status") == "cancelled", "void")
              .when(F.col("revision") != F.col("current_revision"), "superseded")
              .when(F.col("saved_at") >= F.col("start_time"), "late")
              .when((F.col("status") == "final") & resolvable(now), "complete")
              .when(F.col("status").isin("scheduled", "live"), "pending").otherwise("held"))
    done = status == "complete"
    return rows.select(
        "forecast_id", "game_id", "model", "sport", status.alias("status"), "fixture_start", "p",
        F.when(done, F.col("outcome")).alias("outcome"),
        F.coalesce("first_completed_at", F.when(done, F.col("observed_at"))).alias("first_completed_at"))


def cohort_freeze(scores: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """The first N completed forecasts per (model, sport), once there are N.

    Groups are few and large, so parts of a group are cut to N rows before one task ranks the group.
    """
    done = scores.where("status = 'complete'")
    order = [F.col(c) for c in ("first_completed_at", "fixture_start", "forecast_id")]
    wanted = F.lit(None)
    for sport, n in thresholds.items():
        wanted = F.when(F.col("sport") == sport, n).otherwise(wanted)
    largest = max(thresholds.values())
    head = first_rows(done, ["model", "sport"], order, largest, "forecast_id").where(F.col("rank") <= wanted)
    full = F.count(F.lit(1)).over(Window.partitionBy("model", "sport")) == wanted
    return head.withColumn("_full", full).where("_full").drop("_full")


def cohort_status(cohort: DataFrame, scores: DataFrame) -> DataFrame:
    """Frozen membership against the current scores: still eligible, invalidated, metrics of the eligible."""
    now = scores.select("forecast_id", "status", "p", "outcome")
    rows = cohort.select("forecast_id", "model", "sport").join(now, "forecast_id", "left")
    alive = F.coalesce(F.col("status") == "complete", F.lit(False))
    loss = F.when(alive, log_loss(label_probability(F.col("p"), F.col("outcome"))))
    hit = F.when(alive, (argmax(F.col("p")) == F.col("outcome")).cast("int"))
    return rows.groupBy("model", "sport").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(alive).alias("eligible"), F.count_if(~alive).alias("invalidated"),
        F.avg(loss).alias("log_loss"), F.avg(hit).alias("accuracy"))


def source_freshness(attempts: DataFrame, previous: DataFrame) -> DataFrame:
    """New source manifest: ok, stale (last good copy kept) or failed; sources not attempted stay as they were."""
    old = previous.select("source_id", F.col("fetched_at").alias("old_fetched"), F.col("digest").alias("old_digest"),
                          F.col("status").alias("old_status"))
    rows = attempts.withColumn("attempted", F.lit(True)).join(old, "source_id", "full_outer")
    status = (F.when(F.col("attempted").isNull(), F.col("old_status")).when(F.col("succeeded"), "ok")
              .when(F.col("old_fetched").isNotNull(), "stale").otherwise("failed"))
    fresh = F.coalesce(F.col("succeeded"), F.lit(False))
    return rows.select("source_id", status.alias("status"),
                       F.when(fresh, F.col("fetched_at")).otherwise(F.col("old_fetched")).alias("fetched_at"),
                       F.when(fresh, F.col("digest")).otherwise(F.col("old_digest")).alias("digest"))


def with_previous(rows: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Values of the preceding row of each group as prev_*; ranked in slices and joined on (group, rank)."""
    numbered = ranked(rows, group, [F.col(c) for c in order], "_rank")
    before = numbered.select(*group, (F.col("_rank") + 1).alias("_rank"),
                             *[F.col(c).alias(f"prev_{c}") for c in columns])
    return numbered.join(before, [*group, "_rank"], "left").drop("_rank")


def hash_chain(log: DataFrame) -> DataFrame:
    """Read-only steps must leave the state digest of their chain unchanged."""
    rows = with_previous(log, ["chain"], ["position"], ["state"])
    broken = F.col("read_only") & F.col("prev_state").isNotNull() & (F.col("state") != F.col("prev_state"))
    return rows.select("chain", "position", "read_only", broken.alias("broken"))


def recovery_tail(log: DataFrame, tail: int = 5, share: float = 0.01) -> DataFrame:
    """Chains whose last steps still carry more than max(1, share of the total)."""
    last = log.groupBy("chain").agg(F.max("position").alias("last"), F.sum("size").alias("total"))
    rows = log.join(last, "chain").where(F.col("position") > F.col("last") - tail)
    sums = rows.groupBy("chain").agg(F.max("total").alias("total"), F.sum("size").alias("tail"))
    limit = F.greatest(F.lit(1.0), F.col("total") * share)
    return sums.select("chain", "total", "tail", (F.col("tail") <= limit).alias("recovered"))


# States of a journalled attempt.
ATTEMPT_STATES = ["prepared", "intent", "completed", "failed"]


def journal_check(events: DataFrame) -> DataFrame:
    """First rule each journal event breaks, or null; events are ordered by ``seq`` within a journal."""
    rows = with_previous(events, ["journal"], ["seq"], ["position", "status", "invoked", "identity"])
    first, fresh = F.col("prev_position").isNull(), F.col("position") == F.col("prev_position") + 1
    same = F.col("position") == F.col("prev_position")
    opens = (F.col("status") == "prepared") & ~F.col("invoked")
    reason = first_reason([
        (first & (F.col("position") != 0), "order"), (~first & ~fresh & ~same, "order"),
        (fresh & (F.col("prev_status") != "completed"), "follows_incomplete"),
        ((first | fresh) & ~opens, "missing_intent"),
        (same & F.col("prev_status").isin("completed", "failed"), "terminal_rewritten"),
        (same & (F.col("identity") != F.col("prev_identity")), "identity_changed"),
        (same & F.col("prev_invoked") & ~F.col("invoked"), "invocation_decreased"),
        (~F.col("status").isin(*ATTEMPT_STATES), "unknown_state")])
    return rows.select("journal", "seq", reason.alias("violation"))


def quote_select(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """One quote per key: the only one, or the unique latest at or before the start; otherwise none."""
    by_time = quotes.groupBy(*keys, "quote_time").agg(
        F.count(F.lit(1)).alias("n"), F.min("record_id").alias("id"), F.max("start_time").alias("start_time"))
    timely = F.when(F.col("quote_time") <= F.col("start_time"), F.col("quote_time"))
    one = by_time.groupBy(*keys).agg(F.sum("n").alias("quotes"), F.min("id").alias("any_id"),
                                     F.max_by(F.struct("n", "id"), timely).alias("latest"))
    chosen = (F.when(F.col("quotes") == 1, F.col("any_id"))
              .when(F.col("latest.n") == 1, F.col("latest.id")))
    return one.select(*keys, "quotes", chosen.alias("record_id"))
