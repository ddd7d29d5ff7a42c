"""Query registry and the SQL text of the shared views used by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.views import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

VIEWS = {
    "games": """
  SELECT *, CASE WHEN home_score > away_score THEN 0 WHEN home_score < away_score THEN 2
                 WHEN home_score = away_score THEN 1 END AS outcome
  FROM (SELECT game_id, sport, league, home_key, away_key, start_time, status,
               CASE WHEN status = 'final' THEN h END AS home_score,
               CASE WHEN status = 'final' THEN CASE WHEN sport = 'baseball' AND a = h THEN a + 1 ELSE a END END
                 AS away_score, source_key
        FROM (SELECT o_orderkey AS game_id,
                     CASE WHEN o_orderkey % 4 = 0 THEN 'soccer' ELSE 'baseball' END AS sport,
                     'L' || (o_custkey % 5) AS league, 'T' || ((o_orderkey * 7 + 3) % 12) AS home_key,
                     'T' || (((o_orderkey * 7 + 3) % 12 + 1 + o_orderkey % 11) % 12) AS away_key,
                     o_orderdate + to_hours(o_orderkey % 24) AS start_time,
                     CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'scheduled'
                          WHEN o_orderkey % 3 = 0 THEN 'final' WHEN o_orderkey % 3 = 1 THEN 'postponed'
                          ELSE 'cancelled' END AS status,
                     CAST((o_custkey * 3 + o_orderkey) % 7 AS INTEGER) AS h,
                     CAST((o_custkey * 5 + o_orderkey * 2) % 7 AS INTEGER) AS a, o_custkey AS source_key
              FROM orders))""",
    "forecasts": """
  SELECT * EXCLUDE (w_home, w_draw, w_away), w_home / (w_home + w_draw + w_away) AS p_home,
         w_draw / (w_home + w_draw + w_away) AS p_draw, w_away / (w_home + w_draw + w_away) AS p_away
  FROM (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS forecast_id, g.*,
               'm' || (l_linenumber % 3) AS model, CAST(l_suppkey % 3 AS INTEGER) AS seed, l_suppkey,
               start_time + to_hours(l_linenumber - 5) AS saved_at,
               start_time + to_hours(CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END) AS fixture_start,
               CAST(1 + l_partkey % 50 AS DOUBLE) AS w_home,
               CAST(CASE WHEN sport = 'soccer' THEN 1 + l_suppkey % 20 ELSE 0 END AS DOUBLE) AS w_draw,
               CAST(1 + (l_partkey + l_linenumber) % 50 AS DOUBLE) AS w_away
        FROM lineitem JOIN games g ON l_orderkey = game_id)""",
    "quotes": """
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS record_id, l_returnflag AS sportsbook,
         'american' AS price_format, home_key, away_key,
         CAST((100 + l_partkey % 150) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS home_price,
         CAST((100 + l_partkey % 150) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS away_price,
         start_time + to_hours(2 - l_suppkey % 48) AS quote_time,
         CASE WHEN l_linenumber % 4 = 0 THEN game_id END AS game_id,
         CASE WHEN l_linenumber % 4 = 1 THEN start_time END AS start_time,
         CASE WHEN l_linenumber % 4 > 1
              THEN CAST(timezone('America/New_York', timezone('UTC', start_time)) AS DATE) END AS local_date,
         CASE WHEN l_linenumber % 4 > 1 THEN 'America/New_York' END AS zone,
         CASE WHEN l_linenumber % 4 = 3 THEN CAST(1 + l_suppkey % 2 AS INTEGER) END AS game_number,
         l_orderkey AS true_game_id
  FROM lineitem JOIN games ON l_orderkey = game_id AND sport = 'baseball'""",
    "edges": "SELECT l_suppkey AS pre, l_partkey AS post, count(*) AS contacts FROM lineitem GROUP BY ALL",
    "all_nodes": """
  SELECT p_partkey AS id, p_type AS type, p_brand AS class, p_size AS size, p_retailprice AS price, p_name AS name,
         CASE p_partkey % 4 WHEN 0 THEN 'acetylcholine' WHEN 1 THEN 'gaba' WHEN 2 THEN 'acetylcholine,gaba'
              ELSE 'dopamine' END AS transmitter FROM part""",
    "nodes": "SELECT * FROM all_nodes WHERE size <= 40",
    "trials": """
  SELECT event_id, ts, user_id AS unit, event_type AS condition, CAST(event_id % 2 AS INTEGER) AS seed_set,
         minute(ts) AS bin, value, event_id % 50 = 0 AS clipped FROM events""",
    "binary_rows": """
  SELECT doc_id, quality AS y, (1 + n_chars % 97) / 98.0::DOUBLE AS p, (1 + n_chars % 89) / 90.0::DOUBLE AS p_rival,
         CAST(DATE '2023-04-01' + CAST(doc_id % 180 AS INTEGER) AS DATE) AS day, lang, source, toxic
  FROM labels JOIN documents USING (doc_id)""",
    "chain": """
  SELECT conv_id AS chain, turn AS position, role, sha256(text) AS state, length(text) AS size FROM conversations""",
}
_NEEDS = {"forecasts": ["games"], "quotes": ["games"], "nodes": ["all_nodes"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named views (and the views they need); ``body`` may start with ', more AS (...)'."""
    wanted: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    if not wanted:
        return body.strip()
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body.strip()}"


def r6(expression: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables)`` under ``name``; ``sql`` is the check run by another engine."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = with_views(views, sql, recursive)
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
