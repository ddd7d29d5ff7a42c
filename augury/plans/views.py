"""Domain views derived from the given Parquet tables with integer arithmetic only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a large table that one task sorts or adds up. Up to ``UNDEALT_ROWS`` Spark deals the rows as it likes.
TASK_ROWS, UNDEALT_ROWS = 250_000, 1_000_000


class Tables:
    """Lazy access to the given tables and the domain views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._rows: dict[str, int] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        if name not in self._rows:
            self._rows[name] = self.read(name).count()
        return self._rows[name]

    def dealt(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """``df`` dealt by ``keys`` to tasks whose number follows the rows of table ``name``.

        A number given here is kept, while Spark would join small partitions to as many as there are cores, so that a
        task's share, and the memory of its sorts and sums, would grow with the table.
        """
        rows = self.rows(name)
        if rows <= UNDEALT_ROWS:
            return df
        return df.repartition(max(ceil(rows / TASK_ROWS), self.spark.sparkContext.defaultParallelism), *keys)

    def games(self) -> DataFrame:
        base = self.read("orders").selectExpr(
            "o_orderkey AS game_id",
            "CASE WHEN o_orderkey % 4 = 0 THEN 'soccer' ELSE 'baseball' END AS sport",
            "concat('L', o_custkey % 5) AS league",
            "concat('T', (o_orderkey * 7 + 3) % 12) AS home_key",
            "concat('T', ((o_orderkey * 7 + 3) % 12 + 1 + o_orderkey % 11) % 12) AS away_key",
            "timestampadd(HOUR, cast(o_orderkey % 24 AS INT), o_orderdate) AS start_time",
            "CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'scheduled' "
            "WHEN o_orderkey % 3 = 0 THEN 'final' WHEN o_orderkey % 3 = 1 THEN 'postponed' "
            "ELSE 'cancelled' END AS status",
            "cast((o_custkey * 3 + o_orderkey) % 7 AS INT) AS h",
            "cast((o_custkey * 5 + o_orderkey * 2) % 7 AS INT) AS a",
            "o_custkey AS source_key")
        tie_broken = "CASE WHEN sport = 'baseball' AND a = h THEN a + 1 ELSE a END"
        return base.selectExpr(
            "game_id", "sport", "league", "home_key", "away_key", "start_time", "status",
            "CASE WHEN status = 'final' THEN h END AS home_score",
            f"CASE WHEN status = 'final' THEN {tie_broken} END AS away_score", "source_key",
        ).selectExpr(
            "*", "CASE WHEN home_score > away_score THEN 0 WHEN home_score < away_score THEN 2 "
                 "WHEN home_score = away_score THEN 1 END AS outcome")

    def forecasts(self) -> DataFrame:
        """One saved probability forecast per lineitem, with the fixture it was made for."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        lines, games = self.dealt(lines, "lineitem", "l_orderkey"), self.dealt(self.games(), "lineitem", "game_id")
        joined = lines.join(games, lines.l_orderkey == F.col("game_id"))
        weighted = joined.selectExpr(
            "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS forecast_id", "game_id", "sport",
            "league", "home_key", "away_key", "start_time", "status", "home_score", "away_score", "outcome",
            "concat('m', l_linenumber % 3) AS model", "cast(l_suppkey % 3 AS INT) AS seed", "l_suppkey",
            "timestampadd(HOUR, l_linenumber - 5, start_time) AS saved_at",
            "timestampadd(HOUR, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END, start_time) AS fixture_start",
            "cast(1 + l_partkey % 50 AS DOUBLE) AS w_home",
            "cast(CASE WHEN sport = 'soccer' THEN 1 + l_suppkey % 20 ELSE 0 END AS DOUBLE) AS w_draw",
            "cast(1 + (l_partkey + l_linenumber) % 50 AS DOUBLE) AS w_away")
        total = "(w_home + w_draw + w_away)"
        return weighted.selectExpr(
            "*", f"w_home / {total} AS p_home", f"w_draw / {total} AS p_draw", f"w_away / {total} AS p_away",
        ).drop("w_home", "w_draw", "w_away")

    def quotes(self) -> DataFrame:
        """Moneyline records; the way a record names its fixture (id, instant, local date) cycles by line."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
        games = self.dealt(self.games().where("sport = 'baseball'"), "lineitem", "game_id")
        lines = self.dealt(lines, "lineitem", "l_orderkey")
        joined = lines.join(games, lines.l_orderkey == F.col("game_id"))
        local = "convert_timezone('UTC', 'America/New_York', start_time)"
        return joined.selectExpr(
            "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS record_id",
            "l_returnflag AS sportsbook", "'american' AS price_format", "home_key", "away_key",
            "cast((100 + l_partkey % 150) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS home_price",
            "cast((100 + l_partkey % 150) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS away_price",
            "timestampadd(HOUR, -cast(l_suppkey % 48 AS INT) + 2, start_time) AS quote_time",
            "CASE WHEN l_linenumber % 4 = 0 THEN game_id END AS game_id",
            "CASE WHEN l_linenumber % 4 = 1 THEN start_time END AS start_time",
            f"CASE WHEN l_linenumber % 4 > 1 THEN cast({local} AS DATE) END AS local_date",
            "CASE WHEN l_linenumber % 4 > 1 THEN 'America/New_York' END AS zone",
            "CASE WHEN l_linenumber % 4 = 3 THEN cast(1 + l_suppkey % 2 AS INT) END AS game_number",
            "l_orderkey AS true_game_id")

    def edges(self) -> DataFrame:
        lines = self.read("lineitem").select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"))
        return self.dealt(lines, "lineitem", "pre", "post").groupBy("pre", "post").agg(F.count(F.lit(1)).alias("contacts"))

    def all_nodes(self) -> DataFrame:
        return self.read("part").selectExpr(
            "p_partkey AS id", "p_type AS type", "p_brand AS class", "p_size AS size", "p_retailprice AS price",
            "p_name AS name",
            "CASE p_partkey % 4 WHEN 0 THEN 'acetylcholine' WHEN 1 THEN 'gaba' WHEN 2 THEN 'acetylcholine,gaba' "
            "ELSE 'dopamine' END AS transmitter")

    def nodes(self) -> DataFrame:
        return self.all_nodes().where("size <= 40")

    def trials(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id", "ts", "user_id AS unit", "event_type AS condition", "cast(event_id % 2 AS INT) AS seed_set",
            "minute(ts) AS bin", "value", "event_id % 50 = 0 AS clipped")

    def binary(self) -> DataFrame:
        """Binary outcomes with a probability, a date and a group, one row per labelled document."""
        docs = self.read("documents").select("doc_id", "lang", "n_chars", "source")
        return self.read("labels").join(docs, "doc_id").selectExpr(
            "doc_id", "quality AS y", "(1 + n_chars % 97) / 98.0D AS p", "(1 + n_chars % 89) / 90.0D AS p_rival",
            "date_add(DATE'2023-04-01', cast(doc_id % 180 AS INT)) AS day", "lang", "source", "toxic")

    def chain(self) -> DataFrame:
        """Ordered state log: one state digest per conversation turn."""
        return self.read("conversations").selectExpr(
            "conv_id AS chain", "turn AS position", "role", "sha2(text, 256) AS state", "length(text) AS size")
