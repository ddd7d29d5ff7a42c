"""Structured Streaming jobs: merged schedules, first-write ledgers, lateness, scores and ratings.

Batches are appended as ``batch=N`` folders (a retried batch overwrites its own folder, so each batch counts once),
and the current table is a keyed maximum over the log. The first-write ledger has one folder per period above them. ``compact`` folds old batches into one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.fixtures import event_time, usable_final
from ..operators.ledger import score_forecasts
from ..operators.matching import SEASON_PAIR_LEAGUES, merge_log
from ..operators.rating import OTHER_STEP, STEP, advance
from ..plans.session import stable


def read_stream(spark: SparkSession, schema, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a landing folder; all that have landed form one batch unless the caller sets a limit."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what has landed and stop; a restart with the same checkpoint continues after the last batch."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(
        mode).foreachBatch(each).start()
    query.awaitTermination()
    return query


def append_batch(log: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
    return write


# --- merged schedule ------------------------------------------------------------------------------------------

def merged_schedule(spark: SparkSession, log: str, leagues: Sequence[str] = SEASON_PAIR_LEAGUES,
                    observed: str | None = None) -> DataFrame:
    """Current events: later batches replace earlier ones by id and by season pairing."""
    return merge_log(spark.read.parquet(log), "batch", leagues, observed)


def compact(spark: SparkSession, log: str, target: str, leagues: Sequence[str] = SEASON_PAIR_LEAGUES,
            observed: str | None = None) -> None:
    """Fold the log into one batch of surviving rows in a new folder; replaced rows can never matter again."""
    rows = spark.read.parquet(log)
    last = rows.agg(F.max("batch")).first()[0]
    merge_log(rows, "batch", leagues, observed).write.mode("overwrite").parquet(f"{target}/batch={last}")


def written(spark: SparkSession, folder: str, column: str) -> bool:
    """Whether a table has any partition yet. Any other trouble with the folder is an error, never an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{column}=*")
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0


# --- first-write ledger ---------------------------------------------------------------------------------------

#: Most periods that are named to the scan; a batch of more periods is matched by a join.
NAMED_PERIODS = 10_000


def known_keys(once: DataFrame, ledger: str, key: str, period: str, number: int) -> DataFrame:
    """Keys that earlier batches wrote in the periods of this one.

    The periods are named to the scan, which then lists and reads their folders only. The schema is given, so no
    footer is read and a period such as ``01`` stays text.
    """
    fields = [f for f in once.schema if f.name != period]
    schema = StructType([*fields, once.schema[period], StructField("batch", LongType())])
    rows = once.sparkSession.read.schema(schema).parquet(ledger).where(F.col("batch") != number)
    periods = once.select(period).distinct()
    names = [r[0] for r in periods.limit(NAMED_PERIODS + 1).collect()]
    if len(names) > NAMED_PERIODS:
        other = periods.withColumnRenamed(period, "_period")
        return rows.join(other, F.col(period).eqNullSafe(F.col("_period")), "left_semi").select(key)
    named = F.col(period).isin([n for n in names if n is not None])
    return rows.where(named | F.col(period).isNull() if None in names else named).select(key)


def first_write(ledger: str, key: str, period: str) -> Callable[[DataFrame, int], None]:
    """Insert-or-ignore. A key belongs to one period (the month of its event); only the batch's periods are read.

    Folders are by period, then batch, so the months of a batch are found without listing the others. A batch that is
    run again writes the same rows to the same folders. The batch is stored first and read from there.
    """
    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        once = stable(batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("saved_at")).alias("_r")).select(key, "_r.*"))
        if written(batch.sparkSession, ledger, period):
            once = once.join(known_keys(once, ledger, key, period, number), key, "left_anti")
        # Rebalancing by period gives few files per folder and still splits a busy period over tasks.
        once.withColumn("batch", F.lit(number)).hint("rebalance", period).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(period, "batch").parquet(ledger)
    return write


# --- lateness -------------------------------------------------------------------------------------------------

def lateness(stream: DataFrame, cutoff: str, delay: str = "48 hours") -> DataFrame:
    """Late forecasts are labelled, not dropped; the watermark, on the time of saving, bounds downstream state."""
    late = F.col("saved_at") >= F.col(cutoff)
    timed = stream.withColumns({"arrival": F.when(late, "late").otherwise("in_time"), "event_time": event_time(F.col("saved_at"))})
    return timed.withWatermark("event_time", delay)


def weekly_counts(stream: DataFrame, time: str) -> DataFrame:
    """Monday-start tumbling weeks.

    No watermark: a schedule lists events months ahead, and a watermark on their start would drop every result that
    comes after such a row. State is one row per (week, sport), so the calendar bounds it.
    """
    timed = stream.withColumn("event_time", event_time(F.col(time)))
    return timed.groupBy(F.window("event_time", "7 days", startTime="4 days"), "sport").agg(
        F.count(F.lit(1)).alias("games"), F.count("outcome").alias("finished"))


# --- scores ---------------------------------------------------------------------------------------------------

def rescore(forecasts: DataFrame, log: str, now) -> Callable[[DataFrame, int], None]:
    """Score the static ledger against the latest observation of every event in a batch and append the result.

    Observations of one event that tie in ``observed_at`` are ordered by their whole content.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        none = spark.createDataFrame([], "forecast_id string, first_completed_at timestamp_ntz")
        rest = [c for c in batch.columns if c != "game_id"]
        order = F.struct("observed_at", F.to_json(F.struct(*rest)).alias("_content"))
        latest = batch.groupBy("game_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("game_id", "_r.*")
        touched = forecasts.join(latest.select("game_id"), "game_id", "left_semi")
        seen = latest.select("game_id", F.col("observed_at").alias("seen_at"))
        score_forecasts(touched, latest, none, now()).join(seen, "game_id").write.mode("overwrite").parquet(f"{log}/batch={number}")
    return write


def current_scores(spark: SparkSession, log: str) -> DataFrame:
    """Status of every forecast by the latest observation, whatever its batch, with its first completion time."""
    rows = spark.read.parquet(log)
    return rows.groupBy("forecast_id").agg(
        F.max_by(F.struct("model", "sport", "status", "outcome"), F.struct("seen_at", "batch")).alias("s"),
        F.min_by("first_completed_at", F.when(F.col("first_completed_at").isNotNull(), F.col("batch"))).alias("first_completed_at")
    ).select("forecast_id", "s.*", "first_completed_at")


# --- ratings --------------------------------------------------------------------------------------------------

RATING_OUT = "game_id long, sport string, league string, home_rating double, away_rating double, home_form double, away_form double"
FORM_WINDOW = 5
#: Results of a league that a batch holds in memory (about 100 bytes each).
HELD_RESULTS = 500_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeagueRatings(StatefulProcessor):
    """Ratings and recent results per team of one (sport, league), each team an entry of its own in the state store.

    A batch reads and writes the entries of the teams that played. Results are applied in order of start. A batch of a
    league that comes in several pieces is held up to ``HELD_RESULTS`` results; a larger one is laid down in the store by
    day, a held part at a time, so that one part or one day is in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team string", "rating double, recent array<double>")
        self.waiting = handle.getMapState("waiting", "day string, part int", "results string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, pieces, parts, days = 0, 0, 0, {}
        for piece in rows:
            held.append(piece.drop(columns=["sport", "league"], errors="ignore"))
            size, pieces = size + len(piece), pieces + 1
            if size >= HELD_RESULTS:
                self.lay_down(pd.concat(held), parts, days)
                held, size, parts = [], 0, parts + 1
        rating, recent = {}, {}
        if days:
            if held:
                self.lay_down(pd.concat(held), parts, days)
            held = []
            for day in sorted(days):
                yield self.apply(key, self.taken(day, days[day]), rating, recent)
        elif pieces == 1:
            yield self.apply(key, held[0], rating, recent)
        elif held:
            for _, own in (whole := pd.concat(held)).groupby(self.day(whole)):
                yield self.apply(key, own, rating, recent)
        for team, values in recent.items():
            self.teams.updateValue((team,), (rating[team], values))

    @staticmethod
    def day(rows: pd.DataFrame) -> pd.Series:
        return rows["start_time"].dt.strftime("%Y-%m-%d")

    def lay_down(self, rows: pd.DataFrame, part: int, days: dict[str, list[int]]) -> None:
        for day, own in rows.groupby(self.day(rows)):
            self.waiting.updateValue((day, part), (own.to_json(orient="records", date_format="iso", date_unit="us"),))
            days.setdefault(day, []).append(part)

    def taken(self, day: str, parts: list[int]) -> pd.DataFrame:
        pieces = []
        for part in parts:
            pieces.append(pd.read_json(StringIO(self.waiting.getValue((day, part))[0]), orient="records", dtype=False,
                                       convert_dates=["start_time"]))
            self.waiting.removeKey((day, part))
        return pd.concat(pieces)

    def apply(self, key, rows: pd.DataFrame, rating: dict[str, float], recent: dict[str, list[float]]) -> pd.DataFrame:
        """Apply results in order to the teams' entries, which are read from the store when a team first plays."""
        step = STEP.get(key[0], OTHER_STEP)
        rows = rows.sort_values(["start_time", "game_id"])
        for team in {*rows["home_key"], *rows["away_key"]} - recent.keys():
            known = self.teams.getValue((team,))
            if known is not None:
                rating[team] = float(known[0])
            recent[team] = list(known[1]) if known is not None else []
        out = []
        for home, away, result in zip(rows["home_key"], rows["away_key"], rows["result"]):
            new = advance(rating, home, away, result, step)
            for team, own in ((home, result), (away, 1.0 - result)):
                recent[team] = [*recent[team], float(own)][-FORM_WINDOW:]
            out.append((*new, *(sum(recent[t]) / len(recent[t]) for t in (home, away))))
        table = pd.DataFrame(out, columns=["home_rating", "away_rating", "home_form", "away_form"])
        return pd.concat([rows[["game_id"]].reset_index(drop=True), table], axis=1).assign(sport=key[0], league=key[1])[
            [f.split()[0] for f in RATING_OUT.split(", ")]]

    def close(self) -> None:
        pass


def rating_stream(events: DataFrame) -> DataFrame:
    """Ratings and form after every result, per (sport, league) in arrival order; a micro-batch is ordered by start.

    Start it with ``to_table(..., provider=ROCKS)``: state of this kind needs that store.
    """
    margin = F.col("home_score") - F.col("away_score")
    rows = events.where(usable_final()).select(
        "game_id", "sport", "league", "home_key", "away_key", "start_time",
        F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5).alias("result"))
    return rows.groupBy("sport", "league").transformWithStateInPandas(LeagueRatings(), RATING_OUT, "append", "None")


def to_table(stream: DataFrame, path: str, checkpoint: str, provider: str | None = None) -> StreamingQuery:
    """Append what has landed to a table. ``provider`` names the state store of this query only."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if provider is not None:
        conf.set(name, provider)
    try:
        return _appended(stream, path, checkpoint)
    finally:
        conf.set(name, before)


def _appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    query = (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet")
             .option("path", path).outputMode("append").start())
    query.awaitTermination()
    return query
