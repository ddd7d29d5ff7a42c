"""Conservative matching of records to events, keyed merges and same-sample assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixtures import season_year
from ..functions.probability import label_probability, log_loss, vector
from ..plans.ordered import ranked
from ..plans.session import saved

#: Fixed value: leagues in which a pairing occurs once per season.
SEASON_PAIR_LEAGUES = ("EPL",)


def same_events(df: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Seed-averaged loss of every model as columns, kept only where all models scored the event."""
    loss = log_loss(label_probability(vector(), F.col("outcome")))
    wide = df.groupBy(*keys).agg(F.max("start_time").alias("start_time"),
                                 *[F.avg(F.when(F.col("model") == m, loss)).alias(m) for m in models])
    return wide.where(reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in models]))


def model_table(df: DataFrame, models: list[str]) -> DataFrame:
    """Mean loss of every model on its own events and on the events all models share."""
    loss = log_loss(label_probability(vector(), F.col("outcome")))
    wide = df.groupBy("sport", "game_id").agg(
        *[F.avg(F.when(F.col("model") == m, loss)).alias(m) for m in models])
    shared: Column = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in models])
    tall = wide.select("sport", shared.alias("shared"), F.inline(F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("loss")) for m in models]))).where("loss is not null")
    return tall.groupBy("sport", "model").agg(
        F.count(F.lit(1)).alias("own_games"), F.count_if("shared").alias("shared_games"),
        F.avg("loss").alias("own_loss"), F.avg(F.when(F.col("shared"), F.col("loss"))).alias("shared_loss"))


def match_records(records: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Match price records to events by teams plus event id, instant or local date; accept only a single candidate.

    ``records``: record_id, home_key, away_key, game_id, start_time, local_date, zone, game_number (nulls allowed).
    ``fixtures``: game_id, home_key, away_key, start_time.

    Each kind of record joins once on its full key, with the candidates of that key in one list: an event id's events, an
    instant's slot, and the slots of each local date that records ask for (dates are looked up once, not once a record).
    Fixtures that share (teams, instant) are counted before that, so a popular pairing never multiplies records by all its
    events. A game number picks the n-th candidate by (start, id): the instant holding it is found from the counts, and
    only then is the event looked up by its place.
    """
    teams = ["home_key", "away_key"]
    records = saved(records, "records")  # each kind reads its own part
    slots = fixtures.groupBy(*teams, F.col("start_time").alias("instant")).agg(
        F.count(F.lit(1)).alias("events"), F.min("game_id").alias("slot_id"))
    slot = F.struct("instant", "events", "slot_id")
    events = fixtures.groupBy(F.col("game_id").alias("_id")).agg(
        F.collect_list(F.struct(*teams, F.col("start_time").alias("instant"))).alias("_events"))
    days = records.where("game_id is null and start_time is null").select(*teams, "zone", "local_date").distinct()
    near = days.withColumn("utc_day", F.explode(F.sequence(F.date_sub("local_date", 1), F.date_add("local_date", 1))))
    dated = near.join(slots.withColumn("utc_day", F.col("instant").cast("date")), [*teams, "utc_day"]).where(
        _local("instant") == F.col("local_date")).groupBy(*teams, "zone", "local_date").agg(
        F.collect_list(slot).alias("slots"))

    simple = _placed(_candidates(records, slots, events, dated)).where("nth is null or slot.events = 1").withColumn(
        "matched_id", F.col("slot.slot_id"))
    # only a record with a game number can ask for a place in a slot of several events
    numbered = _placed(_candidates(records.where("game_number is not null"), slots, events, dated))
    shared = numbered.where("nth is not null and slot.events > 1")
    deep = shared.withColumn("instant", F.col("slot.instant")).join(
        _numbered_events(fixtures, slots), [*teams, "instant", "nth"]).drop("instant")
    out = simple.unionByName(deep.select(*simple.columns))
    candidates = F.when(place_applies(), F.when(F.col("slot").isNotNull(), 1).otherwise(0)).otherwise(F.col("total"))
    how = (F.when(F.col("asked_id").isNotNull(), "game_id").when(F.col("start_time").isNotNull(), "start_time")
           .when(F.col("game_number").isNotNull(), "date_and_game_number").otherwise("unique_team_date"))
    hit = candidates == 1
    return out.select(
        "record_id", F.when(hit, F.col("matched_id")).alias("game_id"),
        F.when(hit, "matched").when(candidates == 0, "unmatched_fixture").otherwise("ambiguous_fixture").alias("status"),
        F.when(hit, how).alias("matched_by"))


def _local(instant: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col(instant)).cast("date")


def _candidates(records: DataFrame, slots: DataFrame, events: DataFrame, dated: DataFrame) -> DataFrame:
    """Records with the sorted list of the slots they may mean."""
    teams = ["home_key", "away_key"]
    by_id = records.where("game_id is not null")
    by_time = records.where("game_id is null and start_time is not null")
    by_date = records.where("game_id is null and start_time is null and local_date is not null")

    def fits(x: Column) -> Column:
        local = F.convert_timezone(F.lit("UTC"), F.col("zone"), x["instant"]).cast("date")
        asked = F.coalesce(F.when(F.col("start_time").isNotNull(), x["instant"] == F.col("start_time"))
                           .when(F.col("local_date").isNotNull(), local == F.col("local_date")), F.lit(True))
        return reduce(lambda a, b: a & b, [F.col(t) == x[t] for t in teams]) & asked

    own = F.transform(F.filter("_events", fits), lambda x: F.struct(
        x["instant"].alias("instant"), F.lit(1).cast("long").alias("events"), F.col("game_id").alias("slot_id")))
    id_rows = by_id.join(events, F.col("game_id") == F.col("_id"), "left").select(*by_id.columns, own.alias("slots"))
    slot = F.when(F.col("instant").isNotNull(), F.array(F.struct("instant", "events", "slot_id")))
    time_rows = by_time.join(slots.withColumn("start_time", F.col("instant")), [*teams, "start_time"], "left").select(
        *by_time.columns, slot.alias("slots"))
    date_rows = by_date.join(dated, [*teams, "zone", "local_date"], "left").select(*by_date.columns, "slots")
    rows = id_rows.unionByName(time_rows).unionByName(date_rows)
    return rows.withColumn("slots", F.array_sort(F.coalesce("slots", F.array().cast(rows.schema["slots"].dataType))))


def _placed(found: DataFrame) -> DataFrame:
    """The one slot a record means (null if there is none or more than one) and, with a game number, the place in it."""
    keys = [c for c in found.columns if c not in ("game_id", "slots")]
    total = F.aggregate("slots", F.lit(0).cast("long"), lambda a, s: a + s["events"])
    before = F.transform(F.sequence(F.lit(1), F.size("slots")), lambda i: F.aggregate(
        F.slice("slots", 1, i - 1), F.lit(0).cast("long"), lambda a, s: a + s["events"]))
    place = F.when((F.col("game_number").isNotNull()) & (total > 1), F.col("game_number"))
    placed = F.filter(F.arrays_zip(F.col("slots").alias("s"), before.alias("b")),
                      lambda x: (x["b"] < place) & (place <= x["b"] + x["s"]["events"]))
    return found.select(
        *keys, F.col("game_id").alias("asked_id"), total.alias("total"),
        F.when(place.isNotNull(), F.try_element_at(placed, F.lit(1))["s"]).when(
            total == 1, F.try_element_at("slots", F.lit(1))).alias("slot"),
        F.when(place.isNotNull(), place - F.try_element_at(placed, F.lit(1))["b"]).alias("nth"))


def place_applies() -> Column:
    return F.col("game_number").isNotNull() & (F.col("total") > 1)


def _numbered_events(fixtures: DataFrame, slots: DataFrame) -> DataFrame:
    """Position of every event inside its (teams, instant) slot, for slots that hold several."""
    teams = ["home_key", "away_key"]
    several = slots.where("events > 1").select(*teams, "instant")
    rows = fixtures.withColumn("instant", F.col("start_time")).join(several, [*teams, "instant"], "left_semi")
    numbered = ranked(rows.select("game_id", *teams, "instant"), [*teams, "instant"], [F.col("game_id")], "nth")
    return numbered.select(*teams, "instant", F.col("nth").cast("int").alias("nth"), F.col("game_id").alias("matched_id"))


def merge_log(rows: DataFrame, seq: str, leagues: Sequence[str] = SEASON_PAIR_LEAGUES, observed: str | None = None) -> DataFrame:
    """Current events of a revision log: a row counts while no later row has its id or its season pairing.

    In the soccer ``leagues`` a pairing occurs once per season (seasons turn in July), so a moved date replaces the
    earlier row; elsewhere, cups for example, only the id does. Later means a larger ``seq``, then a larger
    ``observed`` (fetch time) where that column is named, then a larger start. Revisions that tie in all of these are
    ordered by their whole content, so row order never decides. Repeated revisions collapse with map-side combine
    first; the two windows then see one row per (id, pairing).
    """
    rest = [c for c in rows.columns if c != "game_id"]
    paired = (F.col("sport") == "soccer") & F.col("league").isin(*leagues)
    pairing = F.when(paired, F.concat_ws(
        "|", "league", season_year(F.col("start_time")).cast("string"), "home_key", "away_key")).otherwise(
        F.col("game_id").cast("string"))
    first = [seq, *([observed] if observed else []), "start_time", "game_id"]
    content = F.to_json(F.struct(*[c for c in rest if c not in first]))
    order = F.struct(*first, content.alias("_content"))
    one = rows.groupBy("game_id", pairing.alias("_alt")).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(
        "game_id", "_alt", "_r.*").withColumn("_order", order)
    latest = F.max("_order").over(Window.partitionBy("_alt"))
    own = F.max("_order").over(Window.partitionBy("game_id"))
    marked = one.withColumns({"_latest": latest, "_own": own})
    return marked.where((F.col("_order") == F.col("_latest")) & (F.col("_order") == F.col("_own"))).select(
        "game_id", *[c for c in rest if c != seq])


def merge_games(existing: DataFrame, incoming: DataFrame, leagues: Sequence[str] = SEASON_PAIR_LEAGUES,
                observed: str | None = None) -> DataFrame:
    """Incoming rows replace rows with the same id or the same season pairing."""
    both = existing.withColumn("_seq", F.lit(0)).unionByName(incoming.withColumn("_seq", F.lit(1)))
    return merge_log(both, "_seq", leagues, observed)


def history_union(history: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Union of old and new rows with the number of times each key occurs."""
    both = history.withColumn("origin", F.lit("history")).unionByName(fresh.withColumn("origin", F.lit("fresh")))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min("origin").alias("origin"))


def matrix_complete(rows: DataFrame, unit: str, levels: dict[str, list], units: DataFrame | None = None) -> DataFrame:
    """Cells of units x levels that do not occur exactly once: missing, duplicate or unexpected.

    ``units`` is the table of expected units: one without any row lacks all its cells, and the cells of a unit that is
    not in it are unexpected. Without that table the units are those that occur. The levels are a short declared list,
    so each unit's missing cells come from an array difference, not a join.
    """
    names = list(levels)
    cell = F.struct(*names)
    counted = rows.groupBy(unit, *names).agg(F.count(F.lit(1)).alias("n"))
    expected = F.array(*[F.struct(*[F.lit(v).cast(rows.schema[n].dataType).alias(n) for n, v in zip(names, combo)])
                         for combo in product(*levels.values())])
    known = reduce(lambda a, b: a & b, [F.col(n).isin(v) for n, v in levels.items()])
    asked = counted.select(unit).distinct() if units is None else units.select(unit).distinct()
    counted = counted.join(asked.withColumn("_asked", F.lit(True)), unit, "left")
    known = F.coalesce(known & F.col("_asked"), F.lit(False))
    odd = counted.where((F.col("n") > 1) | ~known).select(
        unit, *names, F.when(known, "duplicate").otherwise("unexpected").alias("problem"))
    # Only declared cells are collected, so a unit's list is no longer than the declaration.
    present = counted.groupBy(unit).agg(F.collect_list(F.when(known, cell)).alias("cells"))
    missing = asked.join(present, unit, "left").select(unit, F.inline(F.array_except(
        expected, F.coalesce("cells", F.array().cast(present.schema["cells"].dataType))))).withColumn(
        "problem", F.lit("missing"))
    return odd.unionByName(missing)
