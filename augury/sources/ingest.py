"""Scans of landed result files: delimited results, scoreboard and schedule documents, price records, run manifests.

Every scan is a plain DataFrame over a landing folder, so file listing, splitting and retries are Spark's.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixtures import iso_utc, outcome, utc_second
from ..functions.text import schedule_status, scoreboard_status, team_key
from ..plans.session import stable

# Columns of the delimited results format.
RESULT_COLUMNS = ["Date", "Time", "HomeTeam", "AwayTeam", "FTR", "FTHG", "FTAG", "B365H", "B365D", "B365A"]
DEFAULT_KICKOFF = "15:00"

SCOREBOARD_SCHEMA = """events array<struct<date: string, competitions: array<struct<date: string,
  status: struct<type: struct<name: string, description: string, detail: string, shortDetail: string, completed: boolean, state: string>>,
  venue: struct<fullName: string>,
  competitors: array<struct<homeAway: string, score: string, team: struct<displayName: string, name: string, logo: string>>>>>>>"""

_SIDE = "struct<score: string, isWinner: boolean, team: struct<id: long, name: string>>"
_GAME = f"""struct<gamePk: long, gameType: string, gameDate: string, resumeDate: string,
  status: struct<abstractGameState: string, detailedState: string>, teams: struct<home: {_SIDE}, away: {_SIDE}>,
  venue: struct<name: string>>"""
SCHEDULE_SCHEMA = f"dates array<struct<games: array<{_GAME}>>>"

ODDS_FIELDS = ["sportsbook", "market", "price_format", "home_key", "away_key", "home_price", "away_price", "draw_price",
               "quote_timing", "provider_source_row_id", "start_time", "date", "timezone", "game_id", "game_number", "quote_time"]
_RECORD = ", ".join(f"{f}: string" for f in ODDS_FIELDS)
ODDS_SCHEMA = f"{', '.join(f'{f} string' for f in ODDS_FIELDS)}, source string, records array<struct<{_RECORD}>>"


def _blank_to_null(column: Column) -> Column:
    trimmed = F.trim(column)
    return F.when(trimmed != "", trimmed)


def _int(column: Column) -> Column:
    return column.try_cast("int")


def _by_own_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of delimited files by name, each file by its own first line; a column that a file lacks is null."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("at")).where(F.trim("value") != "")
    # the first line is in the block at 0, and row numbers rise within a block
    top = lines.where("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("top"))
    names = F.transform(F.split(F.regexp_replace("top", "^\ufeff", ""), ","), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    headers = top.withColumn("names", names)
    width = headers.agg(F.max(F.size("names"))).first()[0] or 1
    fields = F.from_csv("value", ", ".join(f"f{i} string" for i in range(width)))
    rows = lines.join(headers, "file").where("value <> top").withColumn("r", fields).withColumn(
        "cells", F.array(*[F.col(f"r.f{i}") for i in range(width)]))
    return rows.select(*[F.get("cells", (F.array_position("names", c) - 1).cast("int")).alias(c) for c in columns])


def results_csv(spark: SparkSession, path: str, league: str = "EPL") -> DataFrame:
    """Delimited soccer results, seasons with different columns included. Rows without a date or a team are skipped;
    local London times become UTC."""
    rows = _by_own_header(spark, path, RESULT_COLUMNS)
    day = F.try_to_timestamp(F.trim("Date"), F.lit("dd/MM/yyyy")).cast("date")
    clock = F.coalesce(_blank_to_null(F.col("Time")), F.lit(DEFAULT_KICKOFF))
    clock = F.when(clock.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$"), clock).otherwise(DEFAULT_KICKOFF)
    hour, minute = (F.split(clock, ":")[i].cast("int") for i in (0, 1))
    local = F.make_timestamp_ntz(F.year("day"), F.month("day"), F.dayofmonth("day"), hour, minute, F.lit(0))
    result = F.upper(F.trim("FTR"))
    final = F.coalesce(result.isin("H", "D", "A"), F.lit(False))
    kept = rows.withColumn("day", day).where("day is not null").where(
        (F.coalesce("HomeTeam", F.lit("")) != "") & (F.coalesce("AwayTeam", F.lit("")) != ""))
    named = kept.withColumns({"home": F.trim("HomeTeam"), "away": F.trim("AwayTeam")})
    keyed = named.withColumns({f"{s}_key": team_key(F.col(s), F.lit("soccer")) for s in ("home", "away")})
    return keyed.select(
        F.concat_ws(":", F.lit("soccer"), F.lit(league.lower()), F.col("day").cast("string"), "home_key", "away_key").alias("id"),
        F.lit("soccer").alias("sport"), F.lit(league).alias("league"),
        F.convert_timezone(F.lit("Europe/London"), F.lit("UTC"), local).alias("start_time"),
        "home", "away", "home_key", "away_key", F.when(final, "final").otherwise("scheduled").alias("status"),
        F.when(final, _int(F.col("FTHG"))).alias("home_score"), F.when(final, _int(F.col("FTAG"))).alias("away_score"),
        F.when(result == "H", 0).when(result == "D", 1).when(result == "A", 2).alias("outcome"),
        F.array(*[F.col(c).try_cast("double") for c in ("B365H", "B365D", "B365A")]).alias("odds"))


def _documents(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def scoreboard_json(spark: SparkSession, path: str, league: str = "EPL", multi_line: bool = True) -> DataFrame:
    """Scoreboard documents: first competition of each event, sides picked by their label."""
    events = _documents(spark, path, SCOREBOARD_SCHEMA, multi_line).select(F.explode("events").alias("e"))
    game = events.select(F.col("e.date").alias("event_date"), F.get("e.competitions", 0).alias("c")).where("c is not null")

    def side(label: str) -> Column:
        # The last entry with a label is the one that counts.
        return F.try_element_at(F.filter("c.competitors", lambda x: x["homeAway"] == label), F.lit(-1))

    paired = game.where(F.exists("c.competitors", lambda x: x["homeAway"] == "home")
                        & F.exists("c.competitors", lambda x: x["homeAway"] == "away"))
    rows = paired.select(F.coalesce(_blank_to_null(F.col("c.date")), F.col("event_date")).alias("date"),
                         F.col("c.status.type").alias("t"), F.col("c.venue.fullName").alias("venue"),
                         side("home").alias("h"), side("away").alias("a"))
    named = rows.withColumns({
        n: F.coalesce(F.nullif(F.col(f"{s}.team.displayName"), F.lit("")), F.nullif(F.col(f"{s}.team.name"), F.lit("")))
        for n, s in (("home", "h"), ("away", "a"))}).where("home is not null and away is not null")
    status = scoreboard_status([F.col(f"t.{w}") for w in ("name", "description", "detail", "shortDetail")],
                               F.col("t.completed"), F.col("t.state"))
    keyed = named.withColumns({"status": status, "home_key": team_key(F.col("home"), F.lit("soccer")),
                               "away_key": team_key(F.col("away"), F.lit("soccer")),
                               "start_time": utc_second(F.col("date"))})
    seen = F.col("status").isin("live", "final")
    scored = keyed.withColumns({"home_score": F.when(seen, _int(F.col("h.score"))), "away_score": F.when(seen, _int(F.col("a.score")))})
    return scored.select(
        F.concat_ws(":", F.lit("soccer"), F.lit(league.lower()), F.substring(iso_utc(F.col("date")), 1, 10), "home_key",
                    "away_key").alias("id"),
        F.lit("soccer").alias("sport"), F.lit(league).alias("league"), "start_time", "home", "away", "home_key", "away_key",
        "status", "home_score", "away_score",
        F.when(F.col("status") == "final", outcome(F.col("home_score"), F.col("away_score"))).alias("outcome"),
        F.coalesce("venue", F.lit("")).alias("venue"), F.col("h.team.logo").alias("home_logo"), F.col("a.team.logo").alias("away_logo"))


def _schedule_items(documents: DataFrame) -> DataFrame:
    """Games of every schedule document with their document, date and game positions."""
    numbered = documents.withColumn("doc", F.coalesce(F.col("_metadata.file_path"), F.lit("")))
    days = numbered.select("doc", F.posexplode("dates").alias("day_pos", "d"))
    return days.select("doc", "day_pos", F.posexplode("d.games").alias("game_pos", "g"))


def schedule_json(spark: SparkSession, path: str, league: str = "MLB", multi_line: bool = True) -> DataFrame:
    """Schedule documents: resumed finals lose scores and outcome, the last occurrence of a game wins."""
    items = _schedule_items(_documents(spark, path, SCHEDULE_SCHEMA, multi_line))
    rows = items.select("doc", "day_pos", "game_pos", "g.*")
    # One aggregate answers both "resumed anywhere" and "last usable occurrence", with map-side combine.
    home, away = F.col("teams.home.team.name"), F.col("teams.away.team.name")
    usable = (F.coalesce(home, F.lit("")) != "") & (F.coalesce(away, F.lit("")) != "") & F.coalesce(
        F.col("gameDate") != "", F.lit(False))
    last = F.max_by(F.struct("gameDate", "status", "teams", "venue"), F.when(usable, F.struct("day_pos", "game_pos")))
    one = rows.groupBy("doc", "gamePk").agg(
        F.bool_or(F.coalesce(F.col("resumeDate") != "", F.lit(False))).alias("resumed"), last.alias("g"),
        F.bool_or(usable).alias("usable")).where("usable").select("doc", "gamePk", "resumed", "g.*")
    status = schedule_status(F.col("status.abstractGameState"), F.col("status.detailedState"))
    named = one.withColumns({"home": home, "away": away}).withColumn("state", status)
    shown = F.col("state").isin("live", "final") & ~((F.col("state") == "final") & F.col("resumed"))
    scored = named.withColumns({"home_score": F.when(shown, _int(F.col("teams.home.score"))),
                                "away_score": F.when(shown, _int(F.col("teams.away.score")))})
    return scored.select(
        "doc", F.concat(F.lit(f"baseball:{league.lower()}:"), F.col("gamePk")).alias("id"), F.lit("baseball").alias("sport"),
        F.lit(league).alias("league"), utc_second(F.col("gameDate")).alias("start_time"),
        "home", "away", team_key(F.col("home"), F.lit("baseball")).alias("home_key"),
        team_key(F.col("away"), F.lit("baseball")).alias("away_key"), F.col("state").alias("status"), "home_score", "away_score",
        F.when(F.col("state") == "final", outcome(F.col("home_score"), F.col("away_score"))).alias("outcome"),
        F.coalesce("venue.name", F.lit("")).alias("venue"))


def season_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every game entry of schedule documents with the fields that the strict season rules ask for.

    Any filled field with "resume" in its name marks a resumed game; a time without an offset counts as no time.
    """
    documents = _documents(spark, path, "dates array<struct<games: array<string>>>", multi_line)
    games = documents.select(F.explode("dates.games").alias("games")).select(F.explode("games").alias("text"))
    read = games.select(F.from_json("text", _GAME).alias("g"), F.from_json("text", "map<string, string>").alias("all"))
    marks = F.map_filter("all", lambda k, v: F.lower(k).contains("resume") & ~F.coalesce(v, F.lit("")).isin("", "false", "0", "{}", "[]"))
    zoned = F.when(F.col("g.gameDate").rlike(r"(?:Z|[+\-]\d\d:?\d\d)$"), utc_second(F.col("g.gameDate")))
    sides = [F.col(f"g.teams.{s}.{f}").alias(f"{s}_{n}") for s in ("home", "away")
             for f, n in (("team.id", "id"), ("team.name", "name"), ("isWinner", "winner"))]
    scores = [_int(F.col(f"g.teams.{s}.score")).alias(f"{s}_score") for s in ("home", "away")]
    return read.select(
        F.col("g.gamePk").alias("pk"), F.col("g.gameType").alias("game_type"), F.col("g.status.abstractGameState").alias("abstract_state"),
        F.col("g.status.detailedState").alias("detailed_state"), F.get(F.map_values(marks), 0).alias("resume_marker"),
        zoned.alias("start_time"), *scores, *sides)


def odds_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Price records from a list or a {records, source} object, with the file they came from."""
    rows = _documents(spark, path, ODDS_SCHEMA, multi_line).withColumn("file", F.col("_metadata.file_path"))
    listed = rows.where("records is null").select("file", "source", *ODDS_FIELDS)
    nested = rows.where("records is not null").select("file", "source", F.explode("records").alias("r")).select(
        "file", "source", "r.*")
    return listed.unionByName(nested).withColumnRenamed("provider_source_row_id", "record_id").withColumnsRenamed(
        {"date": "local_date", "timezone": "zone"})


#: Fields of a saved prediction, and its three probabilities in a delimited file.
PREDICTION_FIELDS = "game_id string, sport string, model string, seed string, outcome string"
PROBABILITIES = ["p_home", "p_draw", "p_away"]


def saved_predictions(spark: SparkSession, json_path: str | None = None, csv_path: str | None = None,
                      multi_line: bool = True) -> DataFrame:
    """Saved predictions from lists of records and from delimited files with a header, every row of every file.

    A field that cannot be read is null: nothing is dropped here, ``checks.saved_prediction_rows`` names what is wrong.
    """
    found = []
    if json_path is not None:
        rows = _documents(spark, json_path, f"{PREDICTION_FIELDS}, probabilities array<string>", multi_line)
        found.append(rows.withColumn("format", F.lit("json")))
    if csv_path is not None:
        schema = ", ".join([PREDICTION_FIELDS, *[f"{p} string" for p in PROBABILITIES]])
        rows = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).csv(csv_path)
        found.append(rows.withColumns({"probabilities": F.array(*PROBABILITIES), "format": F.lit("csv")}))
    if not found:
        raise ValueError("name a folder of predictions")
    named = [r.select("format", F.col("game_id").try_cast("long").alias("game_id"), F.nullif("sport", F.lit("")).alias("sport"),
                      F.nullif("model", F.lit("")).alias("model"), _int(F.col("seed")).alias("seed"),
                      _int(F.col("outcome")).alias("outcome"),
                      F.transform("probabilities", lambda p: p.try_cast("double")).alias("p")) for r in found]
    return reduce(DataFrame.unionByName, named)


#: Files up to this size are hashed as one value, larger ones line by line.
WHOLE_BYTES = 32 << 20
#: Text scans unpack these, so such files are hashed as one value.
_PACKED = ["gz", "bz2", "lz4", "snappy", "zst", "deflate"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every file whose lines come in order, a file at a time; nothing but the current batch is held."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])
    path, size, seen, state = None, 0, 0, []

    def finished() -> pa.RecordBatch:
        # the scan drops a byte order mark, and a line does not say whether a line end followed it
        missing = size - seen
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{path} was read with {seen} of its {size} bytes")
        digest = state[missing >= 3]
        if missing in (1, 4):
            digest.update(b"\n")
        return pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "sha256": digest.hexdigest()}], schema)

    for batch in batches:
        for name, length, line in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if name != path:
                if path is not None:
                    yield finished()
                path, size, seen, state = name, length, 0, [hashlib.sha256(), hashlib.sha256(codecs.BOM_UTF8)]
            else:
                line = b"\n" + line
            seen += len(line)
            for s in state:
                s.update(line)
    if path is not None:
        yield finished()


def file_manifest(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Size and SHA-256 of every file below a folder.

    Files of more than ``whole_bytes`` are never held as a whole: a task reads one of them line by line. The checkpoint
    makes a later join see finished digests: without it a join would hash the content once per match.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    large = F.col("length") > whole_bytes
    # plain conditions on the length and the name are settled before a file's content is read
    short = files.load(path).where(F.col("length") <= whole_bytes)
    packed = files.option("pathGlobFilter", f"*.{{{','.join(_PACKED)}}}").load(path).where(large)
    whole = short.unionByName(packed).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).repartition("path")
    plain = ~F.col("path").rlike(rf"\.({'|'.join(_PACKED)})$")
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    longest = sizes.where(large & plain).agg(F.max("length")).first()[0]
    if longest is None:
        return whole
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("value").cast("binary")).where((F.col("bytes") > whole_bytes) & plain)
    # a split as long as the longest file, and as much for opening one: no file is split, no two share a task
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(longest))
        hashed = stable(lines.mapInArrow(_digests, "path string, bytes long, sha256 string"))
    finally:
        for n, old in before.items():
            spark.conf.set(n, old)
    return whole.unionByName(hashed)


RUN_FIELDS = "id string, created_at string, status string, jobs array<struct<id: string, status: string>>"


def run_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests below a folder, newest first. A manifest counts when its id is the name of its folder."""
    text = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("folder"), "value")
    parsed = text.withColumn("m", F.from_json("value", RUN_FIELDS))
    name = F.regexp_replace("folder", "^run=", "")
    done = F.size(F.filter("m.jobs", lambda j: j["status"] == "complete"))
    return parsed.where(F.col("m.id").isNotNull() & (F.col("m.id") == name)).select(
        F.col("m.id").alias("id"), F.col("m.created_at").alias("created_at"), F.col("m.status").alias("status"),
        F.size("m.jobs").alias("jobs"), done.alias("complete")).orderBy(F.desc("created_at"), "id")
