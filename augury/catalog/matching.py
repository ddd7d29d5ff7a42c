"""Record matching, merges, completeness and table audits."""

from pyspark.sql import functions as F

from ..operators import audit, matching
from .registry import query, r6
from .scoring import finals, firsts, FIRST, LOSS


@query("odds_match", "quotes", """, q AS (SELECT *, row_number() OVER () AS rid FROM quotes), candidates AS (
  SELECT q.*, g.game_id AS candidate, row_number() OVER (PARTITION BY rid ORDER BY g.start_time, g.game_id) AS place,
    count(g.game_id) OVER (PARTITION BY rid) AS total
  FROM q LEFT JOIN games g ON g.sport = 'baseball' AND g.home_key = q.home_key AND g.away_key = q.away_key
    AND (q.game_id IS NULL OR g.game_id = q.game_id) AND (q.start_time IS NULL OR g.start_time = q.start_time)
    AND (q.local_date IS NULL OR CAST(timezone('America/New_York', timezone('UTC', g.start_time)) AS DATE) = q.local_date)),
 kept AS (SELECT * FROM candidates WHERE candidate IS NOT NULL AND (game_number IS NULL OR total = 1 OR place = game_number)),
 tally AS (SELECT rid, count(*) AS n, min(candidate) AS candidate FROM kept GROUP BY rid)
SELECT record_id, CASE WHEN n = 1 THEN candidate END AS game_id, CASE WHEN n = 1 THEN 'matched' WHEN n IS NULL
  THEN 'unmatched_fixture' ELSE 'ambiguous_fixture' END AS status, CASE WHEN n = 1 THEN CASE WHEN q.game_id IS NOT NULL
  THEN 'game_id' WHEN start_time IS NOT NULL THEN 'start_time' WHEN game_number IS NOT NULL THEN 'date_and_game_number'
  ELSE 'unique_team_date' END END AS matched_by
FROM q LEFT JOIN tally USING (rid)""")
def _(t):
    fixtures = t.games().where("sport = 'baseball'").select("game_id", "home_key", "away_key", "start_time")
    records = t.quotes().select("record_id", "home_key", "away_key", "game_id", "start_time", "local_date", "zone",
                                "game_number")
    return matching.match_records(records, fixtures)


_SEASON = "year(start_time) - CASE WHEN month(start_time) >= 7 THEN 0 ELSE 1 END"


#: Leagues in which a pairing occurs once per season; in the others, as in cups, it may occur again.
PAIRED = ("L0", "L1", "L2")
MERGED = f"""both_sides AS (SELECT game_id, sport, league, home_key, away_key, start_time, status, 0 AS seq FROM games
                UNION ALL SELECT *, 1 FROM incoming),
 keyed AS (SELECT *, CASE WHEN sport = 'soccer' AND league IN ('L0', 'L1', 'L2') THEN concat_ws('|', league, {_SEASON}, home_key, away_key)
                     ELSE CAST(game_id AS VARCHAR) END AS alt FROM both_sides),
 merged AS (SELECT * FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM keyed o WHERE o.alt = k.alt AND (o.seq, o.start_time, o.game_id)
     > (k.seq, k.start_time, k.game_id)) AND NOT EXISTS (SELECT 1 FROM keyed o WHERE o.game_id = k.game_id AND
     (o.seq, o.start_time) > (k.seq, k.start_time)))"""
INCOMING = """incoming AS (SELECT CASE WHEN sport = 'soccer' AND game_id % 2 = 0
    THEN game_id + 100000000 ELSE game_id END AS game_id, sport, league, home_key, away_key,
    start_time + INTERVAL 24 HOUR AS start_time, status FROM games WHERE game_id % 3 = 0)"""


@query("merge_games", "games", f""", {INCOMING}, {MERGED}
SELECT game_id, sport, league, home_key, away_key, CAST(start_time AS VARCHAR) AS start_time, status FROM merged""")
def _(t):
    columns = ["game_id", "sport", "league", "home_key", "away_key", "start_time", "status"]
    existing = t.games().select(*columns)
    incoming = existing.where("game_id % 3 = 0").withColumns({
        "start_time": F.expr("timestampadd(HOUR, 24, start_time)"),
        "game_id": F.expr("CASE WHEN sport = 'soccer' AND game_id % 2 = 0 THEN game_id + 100000000 ELSE game_id END")})
    return matching.merge_games(existing, incoming, PAIRED).withColumn("start_time", F.col("start_time").cast("string"))


@query("history_union", "games", """
SELECT game_id, count(*) AS copies, min(origin) AS origin FROM (
  SELECT game_id, 'history' AS origin FROM games WHERE start_time < TIMESTAMP '1998-06-01'
  UNION ALL SELECT game_id, 'fresh' FROM games WHERE start_time >= TIMESTAMP '1998-05-01') GROUP BY game_id""")
def _(t):
    games = t.games().select("game_id", "start_time")
    return matching.history_union(games.where("start_time < TIMESTAMP_NTZ'1998-06-01 00:00:00'").drop("start_time"),
                                  games.where("start_time >= TIMESTAMP_NTZ'1998-05-01 00:00:00'").drop("start_time"),
                                  "game_id")


@query("id_difference", "forecasts quotes", """, l AS (SELECT model, game_id FROM forecasts WHERE outcome IS NOT NULL GROUP BY ALL),
 r AS (SELECT sportsbook, true_game_id AS game_id FROM quotes GROUP BY ALL)
SELECT model, sportsbook, game_id, CASE WHEN bool_or(l) THEN 'left_only' ELSE 'right_only' END AS side FROM (
  SELECT model, sportsbook, game_id, true AS l FROM l, (SELECT DISTINCT sportsbook FROM quotes) UNION ALL
  SELECT model, sportsbook, game_id, false FROM r, (SELECT DISTINCT model FROM forecasts)) GROUP BY ALL HAVING count(*) = 1""")
def _(t):
    """Every model against every book."""
    models = t.forecasts().select("model").distinct().agg(F.collect_list("model")).scalar()
    books = t.quotes().select("sportsbook").distinct().agg(F.collect_list("sportsbook")).scalar()
    left = finals(t).select("model", "game_id").distinct().select("model", books.alias("b"), "game_id").select(
        "model", F.explode("b").alias("sportsbook"), "game_id")
    right = t.quotes().select("sportsbook", F.col("true_game_id").alias("game_id")).distinct().select(
        models.alias("m"), "sportsbook", "game_id").select(F.explode("m").alias("model"), "sportsbook", "game_id")
    return audit.id_difference(left, right, ["model", "sportsbook", "game_id"])


@query("matrix_complete", "trials", """, cells AS (SELECT unit, condition, seed_set, count(*) AS n FROM trials GROUP BY ALL),
 units AS (SELECT DISTINCT c_custkey AS unit FROM customer),
 known AS (SELECT *, condition IN ('view', 'click', 'purchase') AND unit IN (SELECT unit FROM units) AS fits FROM cells)
SELECT unit, condition, seed_set, 'duplicate' AS problem FROM known WHERE n > 1 AND fits
UNION ALL SELECT unit, condition, seed_set, 'unexpected' FROM known WHERE NOT fits
UNION ALL SELECT u.unit, c.condition, s.seed_set, 'missing' FROM units u
  CROSS JOIN (VALUES ('view'), ('click'), ('purchase')) c(condition) CROSS JOIN (VALUES (0), (1)) s(seed_set)
  ANTI JOIN cells x ON x.unit = u.unit AND x.condition = c.condition AND x.seed_set = s.seed_set""")
def _(t):
    rows = t.trials().select("unit", "condition", "seed_set")
    units = t.read("customer").select(F.col("c_custkey").cast(rows.schema["unit"].dataType).alias("unit"))
    return matching.matrix_complete(rows, "unit", {"condition": ["view", "click", "purchase"], "seed_set": [0, 1]}, units)


@query("table_diff", sql="""
WITH changed AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS p_size,
    CASE WHEN p_partkey % 14 = 3 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_partkey % 50 <> 7),
 both_sides AS (SELECT p_partkey, a.p_name AS n1, b.p_name AS n2, a.p_brand AS b1, b.p_brand AS b2, CAST(a.p_size AS VARCHAR)
    AS s1, CAST(b.p_size AS VARCHAR) AS s2, a.p_type AS t1, b.p_type AS t2
   FROM part a FULL JOIN changed b USING (p_partkey))
SELECT p_partkey, 'p_name' AS field, n1 AS left_value, n2 AS right_value FROM both_sides WHERE n1 IS DISTINCT FROM n2
UNION ALL SELECT p_partkey, 'p_brand', b1, b2 FROM both_sides WHERE b1 IS DISTINCT FROM b2
UNION ALL SELECT p_partkey, 'p_size', s1, s2 FROM both_sides WHERE s1 IS DISTINCT FROM s2
UNION ALL SELECT p_partkey, 'p_type', t1, t2 FROM both_sides WHERE t1 IS DISTINCT FROM t2""")
def _(t):
    part = t.read("part")
    changed = part.where("p_partkey % 50 <> 7").withColumns({
        "p_size": F.expr("CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END"),
        "p_type": F.expr("CASE WHEN p_partkey % 14 = 3 THEN NULL ELSE p_type END"),
        "p_retailprice": F.col("p_retailprice") * 2})
    return audit.table_diff(part, changed, ["p_partkey"], ["p_retailprice"])


@query("reconcile_sums", "forecasts", f"""{FIRST}, recomputed AS (SELECT model, sport, sum({LOSS}) AS total, count(*) AS n
    FROM firsts GROUP BY ALL),
 recorded AS (SELECT model, sport, total + CASE WHEN model = 'm2' THEN 0.5 ELSE 0.0000001 END AS recorded FROM recomputed)
SELECT model, sport, n, {r6("total", 5)} AS recomputed, {r6("recorded", 5)} AS recorded, abs(total - recorded) <= 1e-6 AS agrees
FROM recomputed JOIN recorded USING (model, sport)""")
def _(t):
    from ..functions.probability import label_probability, log_loss, vector
    rows = firsts(t).withColumn("loss", log_loss(label_probability(vector(), F.col("outcome"))))
    recorded = rows.groupBy("model", "sport").agg(
        (F.sum("loss") + F.when(F.col("model") == "m2", 0.5).otherwise(0.0000001)).alias("recorded"))
    out = audit.reconcile_sums(rows, recorded, ["model", "sport"], F.col("loss"), 1e-6)
    return out.select("model", "sport", "n", F.round("recomputed", 5).alias("recomputed"),
                      F.round("recorded", 5).alias("recorded"), "agrees")


@query("edge_reconcile", "edges", """, raw AS (SELECT pre, post, CASE WHEN (pre + post) % 41 = 0 THEN contacts + 1 ELSE contacts
    END AS contacts FROM edges WHERE (pre * 3 + post) % 53 <> 0)
SELECT pre, post, e.contacts AS derived, r.contacts AS raw FROM edges e FULL JOIN raw r USING (pre, post)
WHERE e.contacts IS DISTINCT FROM r.contacts""")
def _(t):
    edges = t.edges()
    raw = edges.where("(pre * 3 + post) % 53 <> 0").withColumn(
        "contacts", F.expr("CASE WHEN (pre + post) % 41 = 0 THEN contacts + 1 ELSE contacts END"))
    return audit.edge_reconcile(edges, raw, ["pre", "post"], "contacts")


@query("repro_gate", "forecasts", f"""{FIRST}, actual AS (SELECT model, sport, avg({LOSS}) AS loss FROM firsts GROUP BY ALL),
 expected AS (SELECT model, sport, loss + CASE model WHEN 'm0' THEN 0.0 WHEN 'm1' THEN 0.00000001 ELSE 0.001 END AS loss
   FROM actual UNION ALL SELECT 'm9', 'soccer', 0.7)
SELECT model, sport, {r6("e.loss")} AS expected, {r6("a.loss")} AS actual, coalesce(abs(a.loss - e.loss) <= 1e-6, false) AS passed
FROM expected e LEFT JOIN actual a USING (model, sport)""")
def _(t):
    from ..functions.probability import label_probability, log_loss, vector
    loss = log_loss(label_probability(vector(), F.col("outcome")))
    actual = firsts(t).groupBy("model", "sport").agg(F.avg(loss).alias("loss"))
    shift = F.expr("CASE model WHEN 'm0' THEN 0.0D WHEN 'm1' THEN 0.00000001D ELSE 0.001D END")
    absent = t.spark.createDataFrame([("m9", "soccer", 0.7)], "model string, sport string, loss double")
    expected = actual.withColumn("loss", F.col("loss") + shift).unionByName(absent)
    out = audit.within_tolerance(actual, expected, ["model", "sport"], "loss", 1e-6)
    return out.select("model", "sport", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"),
                      "passed")


@query("pair_verdicts", "games", """
SELECT pair, original, heldout, original = 1 AND heldout = 1 AS paired, original = 1 AND heldout = 1 AND coalesce(op AND hp,
  false) AS qualified
FROM (SELECT sha256(concat_ws('|', home_key, away_key, CAST(start_time AS DATE))) AS pair,
   count(*) FILTER (role = 'original') AS original, count(*) FILTER (role = 'heldout') AS heldout,
   bool_and(passed) FILTER (role = 'original') AS op, bool_and(passed) FILTER (role = 'heldout') AS hp
 FROM (SELECT *, CASE WHEN game_id % 2 = 0 THEN 'original' ELSE 'heldout' END AS role, source_key % 4 <> 0 AS passed FROM games)
 GROUP BY 1)""")
def _(t):
    rows = t.games().select("home_key", "away_key", F.col("start_time").cast("date").cast("string").alias("day"),
                            F.expr("CASE WHEN game_id % 2 = 0 THEN 'original' ELSE 'heldout' END").alias("role"),
                            F.expr("source_key % 4 <> 0").alias("passed"))
    return audit.pair_verdicts(rows, ["home_key", "away_key", "day"], "role", "passed", ("original", "heldout"))


@query("running_sum_check", "trials", """, logged AS (SELECT unit, event_id, value, sum(value) OVER w AS running,
    sum(value) OVER w + CASE WHEN event_id % 97 = 0 THEN 0.01 ELSE 0 END AS recorded, row_number() OVER w AS position
  FROM trials WINDOW w AS (PARTITION BY unit ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT unit, event_id, position, round(running, 4) AS running, abs(running - recorded) <= 1e-6 AS consistent FROM logged""")
def _(t):
    from ..plans.ordered import ranked
    rows = ranked(t.trials().select("unit", "event_id", "value"), ["unit"], [F.col("event_id")], "k", {"c": "value"})
    logged = rows.select("unit", "event_id", "value", (F.col("c") + F.expr(
        "CASE WHEN event_id % 97 = 0 THEN 0.01D ELSE 0D END")).alias("recorded"))
    out = audit.running_sum_check(logged, ["unit"], ["event_id"], "value", "recorded")
    return out.select("unit", "event_id", "position", F.round("running", 4).alias("running"), "consistent")


@query("first_divergence", "chain", """, other AS (SELECT chain, position, CASE WHEN (chain * 7 + position) % 5 = 3 THEN state || 'x'
    ELSE state END AS state FROM chain WHERE NOT (chain % 6 = 2 AND position > 3))
SELECT chain, min(position) FILTER (d) AS first_step, count(*) AS steps, count(*) FILTER (d) AS different
FROM (SELECT chain, position, a.state IS DISTINCT FROM b.state AS d FROM chain a FULL JOIN other b USING (chain, position))
GROUP BY chain""")
def _(t):
    rows = t.chain().select("chain", "position", "state")
    other = rows.where("NOT (chain % 6 = 2 AND position > 3)").withColumn("state", F.expr(
        "CASE WHEN (chain * 7 + position) % 5 = 3 THEN concat(state, 'x') ELSE state END"))
    return audit.first_divergence(rows, other, ["chain"], "position", "state")


@query("mask_invariants", "edges", """, after AS (SELECT pre, post, contacts + CASE WHEN post % 3 = 0 OR (pre + post) % 67 = 5 THEN 1
    ELSE 0 END AS contacts FROM edges)
SELECT pre, post, b.contacts AS old, a.contacts AS new FROM edges b JOIN after a USING (pre, post)
WHERE post % 3 <> 0 AND a.contacts <> b.contacts""")
def _(t):
    before = t.edges().withColumn("masked", F.col("post") % 3 == 0)
    after = before.withColumn("contacts", F.col("contacts") + F.when(
        F.col("masked") | ((F.col("pre") + F.col("post")) % 67 == 5), 1).otherwise(0))
    return audit.mask_invariants(before, after, ["pre", "post"], "contacts", "masked")
