"""Scalar expressions, row checks and simple projections."""

from pyspark.sql import functions as F

from ..functions import fixtures, odds, probability, text
from ..operators import checks
from .registry import query, r6

_SLUG = "trim(regexp_replace(replace(replace(lower({0}), '&', ' and '), '''', ' '), '[^a-z0-9]+', '-', 'g'), '-')"


@query("canonical_key", sql=f"""
SELECT 'part' AS origin, p_partkey AS id, {_SLUG.format("p_name || ' & Sons'' ' || p_brand")} AS key FROM part
UNION ALL SELECT 'customer', c_custkey, {_SLUG.format("c_name || ' / ' || c_mktsegment")} FROM customer""")
def _(t):
    sport = F.lit("soccer")
    part = t.read("part").select(
        F.lit("part").alias("origin"), F.col("p_partkey").alias("id"),
        text.team_key(F.concat_ws("", F.col("p_name"), F.lit(" & Sons' "), F.col("p_brand")), sport).alias("key"))
    customer = t.read("customer").select(
        F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"),
        text.team_key(F.concat_ws(" / ", "c_name", "c_mktsegment"), sport).alias("key"))
    return part.unionByName(customer)


@query("canonical_key_alias", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE code WHEN 'nyy' THEN 'new-york-yankees' WHEN 'kcr' THEN 'kansas-city-royals' WHEN 'az' THEN
       'arizona-diamondbacks' WHEN '' THEN NULL ELSE code END AS key
FROM (SELECT *, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '-') AS code
      FROM (SELECT *, CASE l_suppkey % 5 WHEN 0 THEN ' NYY ' WHEN 1 THEN 'kcr' WHEN 2 THEN 'AZ' WHEN 3 THEN '--'
                      ELSE 'Team ' || l_linenumber || '/' || l_returnflag END AS raw FROM lineitem))""")
def _(t):
    raw = F.expr("CASE l_suppkey % 5 WHEN 0 THEN ' NYY ' WHEN 1 THEN 'kcr' WHEN 2 THEN 'AZ' WHEN 3 THEN '--' "
                 "ELSE concat('Team ', l_linenumber, '/', l_returnflag) END")
    return t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                     text.book_team_key(raw).alias("key"))


@query("iso_utc", sql="""
SELECT event_id, CASE WHEN user_id % 5 <> 4 THEN strftime(date_trunc('second', ts - to_minutes(CASE user_id % 5
       WHEN 1 THEN 120 WHEN 3 THEN -330 ELSE 0 END)), '%Y-%m-%dT%H:%M:%SZ') END AS utc
FROM events""")
def _(t):
    shown = F.expr("CASE user_id % 5 WHEN 4 THEN 'soon' ELSE concat(cast(ts AS STRING), CASE user_id % 5 "
                   "WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 3 THEN '-05:30' ELSE '' END) END")
    return t.read("events").select("event_id", fixtures.iso_utc(shown).alias("utc"))


@query("outcome", "games", "SELECT game_id, outcome FROM games")
def _(t):
    return t.games().select("game_id", fixtures.outcome(F.col("home_score"), F.col("away_score")).alias("outcome"))


@query("status_classify", sql="""
SELECT o_orderkey,
  CASE WHEN contains(words, 'postpon') THEN 'postponed' WHEN contains(words, 'cancel') THEN 'cancelled'
       WHEN contains(words, 'final') OR contains(words, 'completed') THEN 'final'
       WHEN abstract = 'Live' OR contains(words, 'progress') OR contains(words, 'warmup') THEN 'live'
       ELSE 'scheduled' END AS schedule_status,
  CASE WHEN contains(detail, 'postpon') THEN 'postponed' WHEN contains(detail, 'cancel') THEN 'cancelled'
       WHEN o_orderkey % 5 = 0 OR state = 'post' THEN 'final' WHEN state = 'in' THEN 'live' ELSE 'scheduled'
       END AS scoreboard_status
FROM (SELECT o_orderkey, abstract, state, lower(abstract || ' ' || detailed) AS words, lower(detailed) AS detail
      FROM (SELECT o_orderkey,
              CASE o_orderkey % 4 WHEN 0 THEN 'Final' WHEN 1 THEN 'Live' WHEN 2 THEN 'Preview' ELSE '' END AS abstract,
              CASE o_custkey % 8 WHEN 0 THEN 'Postponed' WHEN 1 THEN 'Cancelled: Rain' WHEN 2 THEN 'In Progress'
                WHEN 3 THEN 'Completed Early' WHEN 4 THEN 'Warmup' WHEN 5 THEN 'Scheduled' WHEN 6 THEN 'Game Over'
                ELSE '' END AS detailed,
              CASE o_orderkey % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'in' ELSE 'pre' END AS state FROM orders))""")
def _(t):
    rows = t.read("orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'Final' WHEN 1 THEN 'Live' WHEN 2 THEN 'Preview' ELSE '' END "
        "AS abstract", "CASE o_custkey % 8 WHEN 0 THEN 'Postponed' WHEN 1 THEN 'Cancelled: Rain' WHEN 2 THEN "
        "'In Progress' WHEN 3 THEN 'Completed Early' WHEN 4 THEN 'Warmup' WHEN 5 THEN 'Scheduled' WHEN 6 THEN "
        "'Game Over' ELSE '' END AS detailed",
        "CASE o_orderkey % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'in' ELSE 'pre' END AS state",
        "o_orderkey % 5 = 0 AS completed")
    return rows.select(
        "o_orderkey", text.schedule_status(F.col("abstract"), F.col("detailed")).alias("schedule_status"),
        text.scoreboard_status([F.col("detailed")], F.col("completed"), F.col("state")).alias("scoreboard_status"))


_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("odds_decimal", sql=f"""
SELECT {_LINE}, CASE WHEN abs(price) >= 100 THEN {r6("1 + CASE WHEN price > 0 THEN price / 100 "
                                                     "ELSE 100 / abs(price) END")} END AS american_decimal,
       CASE WHEN l_quantity / 20 > 1 THEN {r6("l_quantity / 20")} END AS decimal_checked
FROM (SELECT *, CAST(l_partkey % 400 - 200 AS DOUBLE) AS price FROM lineitem)""")
def _(t):
    return t.read("lineitem").select(
        *_LINE.split(", "),
        F.round(odds.american_to_decimal(F.col("l_partkey") % 400 - 200), 6).alias("american_decimal"),
        F.round(odds.decimal_price(F.col("l_quantity") / 20), 6).alias("decimal_checked"))


_DECIMAL = "(1 + CASE WHEN {0} > 0 THEN {0} / 100 ELSE 100 / abs({0}) END)"


@query("devig", "quotes", f"""
SELECT record_id, {r6("(1 / h) / (1 / h + 1 / a)")} AS fair_home, {r6("(1 / a) / (1 / h + 1 / a)")} AS fair_away
FROM (SELECT record_id, {_DECIMAL.format("home_price")} AS h, {_DECIMAL.format("away_price")} AS a FROM quotes)""")
def _(t):
    q = t.quotes()
    home, away = (odds.to_decimal(F.col(f"{s}_price"), F.col("price_format")) for s in ("home", "away"))
    fair_home, fair_away = odds.devig_two_way(home, away)
    return q.select("record_id", F.round(fair_home, 6).alias("fair_home"), F.round(fair_away, 6).alias("fair_away"))


@query("devig3", sql=f"""
SELECT {_LINE}, CASE WHEN h > 1 AND d > 1 AND a > 1 THEN {r6("(1 / d) / (1 / h + 1 / d + 1 / a)")} END AS draw
FROM (SELECT *, CASE WHEN l_suppkey % 11 > 0 THEN 1 + (l_partkey % 40) / 10 END AS h,
             1 + (l_suppkey % 30) / 10 AS d, 1 + l_quantity / 10 AS a FROM lineitem)""")
def _(t):
    rows = t.read("lineitem").withColumn("prices", F.array(
        F.expr("CASE WHEN l_suppkey % 11 > 0 THEN 1 + (l_partkey % 40) / 10D END"),
        F.expr("1 + (l_suppkey % 30) / 10D"), F.expr("1 + l_quantity / 10")))
    return rows.select(*_LINE.split(", "), F.round(odds.devig_draw(F.col("prices")), 6).alias("draw"))


_RAW = [
    ("record_id", "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"),
    ("sportsbook", "CASE WHEN l_suppkey % 17 > 0 THEN concat(' ', l_returnflag, ' ') END"),
    ("market", "CASE l_partkey % 6 WHEN 0 THEN 'spread' WHEN 1 THEN 'ML' WHEN 2 THEN ' Money-Line' "
               "ELSE 'moneyline' END"),
    ("price_format", "CASE l_orderkey % 9 WHEN 0 THEN 'fractional' WHEN 1 THEN 'Decimal' ELSE 'american' END"),
    ("home_key", "concat('Team ', l_partkey % 7)"), ("away_key", "concat('Team ', l_suppkey % 7)"),
    ("home_price", "l_partkey % 500 - 150"), ("away_price", "l_suppkey * 3 + 2"),
    ("draw_price", "CASE WHEN l_partkey % 19 = 0 THEN 300 END"), ("quote_timing", "'close'"),
    ("start_time", "CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END"),
    ("local_date", "CASE WHEN l_linenumber = 1 THEN l_shipdate END"),
    ("zone", "CASE WHEN l_suppkey % 3 > 0 THEN 'America/New_York' END"),
    ("game_number", "CASE l_orderkey % 7 WHEN 0 THEN '0' WHEN 1 THEN 'two' WHEN 2 THEN '' WHEN 3 THEN '2' END"),
]


@query("odds_normalize", sql=f"""
SELECT record_id, reason, trim(sportsbook) AS sportsbook, home_slug AS home_key, away_slug AS away_key,
       CASE WHEN reason IS NULL THEN {r6("(1 / h) / (1 / h + 1 / a)")} END AS p_home,
       CASE WHEN reason IS NULL THEN {r6("(1 / a) / (1 / h + 1 / a)")} END AS p_away,
       TRY_CAST(game_number AS INTEGER) AS game_number
FROM (SELECT *, CASE WHEN sportsbook IS NULL THEN 'missing_field'
         WHEN lower(trim(market)) NOT IN ('moneyline', 'ml', 'money-line') THEN 'market'
         WHEN draw_price IS NOT NULL THEN 'draw_price' WHEN kind = 'fractional' THEN 'price_format'
         WHEN h IS NULL OR a IS NULL THEN 'price' WHEN home_slug = away_slug THEN 'teams'
         WHEN start_time IS NULL AND (local_date IS NULL OR zone IS NULL) THEN 'fixture_time'
         WHEN game_number IN ('0', 'two') THEN 'game_number' END AS reason
  FROM (SELECT *, replace(lower(home_key), ' ', '-') AS home_slug, replace(lower(away_key), ' ', '-') AS away_slug,
          CASE WHEN kind = 'american' AND abs(home_price) >= 100 THEN {_DECIMAL.format("home_price")}
               WHEN kind = 'decimal' AND home_price > 1 THEN home_price END AS h,
          CASE WHEN kind = 'american' AND abs(away_price) >= 100 THEN {_DECIMAL.format("away_price")}
               WHEN kind = 'decimal' AND away_price > 1 THEN away_price END AS a
    FROM (SELECT *, lower(price_format) AS kind FROM (
      SELECT {", ".join(f"{e} AS {n}" for n, e in _RAW)} FROM lineitem))))""")
def _(t):
    raw = t.read("lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _RAW])
    out = checks.odds_records(raw)
    return out.select("record_id", "reason", "sportsbook", "home_key", "away_key", F.round("p_home", 6).alias("p_home"),
                      F.round("p_away", 6).alias("p_away"), "game_number")


@query("fixture_revision", "games", """
SELECT game_id, sha256(concat_ws('|', sport, home_key, away_key, CAST(start_time AS VARCHAR))) AS revision,
       sha256(concat_ws('|', game_id, sha256(concat_ws('|', sport, home_key, away_key, CAST(start_time AS VARCHAR))),
                        'm0')) AS forecast_key
FROM games""")
def _(t):
    revision = fixtures.revision(F.col("sport"), F.col("home_key"), F.col("away_key"), F.col("start_time"))
    return t.games().select("game_id", revision.alias("revision"),
                            F.sha2(F.concat_ws("|", "game_id", revision, F.lit("m0")), 256).alias("forecast_key"))


_ARGMAX = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END"


def _claimed(t):
    """Forecasts with a claimed pick and confidence, some of them damaged."""
    best = probability.argmax(probability.vector())
    return t.forecasts().withColumns({
        "p": F.expr("CASE WHEN l_suppkey % 23 = 0 THEN array(p_home + 0.1D, p_draw, p_away) "
                    "WHEN l_suppkey % 29 = 1 THEN array(p_home, p_draw + 0.2D, p_away - 0.2D) "
                    "ELSE array(p_home, p_draw, p_away) END"),
        "claimed": F.when(F.col("l_suppkey") % 7 == 0, 2 - best).otherwise(best),
        "confidence": F.array_max(probability.vector()) + F.when(F.col("l_suppkey") % 31 == 2, 0.01).otherwise(0.0)})


_CLAIMED = f"""claimed AS (SELECT *, p1 + p2 + p3 AS total, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1
      ELSE 2 END AS best FROM (SELECT *, CASE WHEN l_suppkey % 23 = 0 THEN p_home + 0.1 ELSE p_home END AS p1,
      CASE WHEN l_suppkey % 23 <> 0 AND l_suppkey % 29 = 1 THEN p_draw + 0.2 ELSE p_draw END AS p2,
      CASE WHEN l_suppkey % 23 <> 0 AND l_suppkey % 29 = 1 THEN p_away - 0.2 ELSE p_away END AS p3,
      CASE WHEN l_suppkey % 7 = 0 THEN 2 - ({_ARGMAX}) ELSE {_ARGMAX} END AS claimed,
      greatest(p_home, p_draw, p_away) + CASE WHEN l_suppkey % 31 = 2 THEN 0.01 ELSE 0 END AS confidence
      FROM forecasts))"""


@query("valid_prob", "forecasts", f""", {_CLAIMED}
SELECT forecast_id, best AS pick, {r6("greatest(p1, p2, p3)")} AS top, coalesce(least(p1, p2, p3) >= 0 AND
  greatest(p1, p2, p3) <= 1 AND abs(total - 1) <= 1e-5 AND (sport <> 'baseball' OR p2 = 0), false) AS valid
FROM claimed""")
def _(t):
    p = F.col("p")
    return _claimed(t).select("forecast_id", probability.argmax(p).alias("pick"),
                              F.round(F.array_max(p), 6).alias("top"),
                              probability.valid_vector(p, F.col("sport")).alias("valid"))


@query("validate_predictions", "forecasts", f""", {_CLAIMED}
SELECT model, coalesce(reason, 'valid') AS reason, count(*) AS n FROM (
  SELECT model, CASE WHEN NOT (least(p1, p2, p3) >= 0 AND greatest(p1, p2, p3) <= 1 AND abs(total - 1) <= 1e-5
                               AND (sport <> 'baseball' OR p2 = 0)) THEN 'probabilities'
                     WHEN claimed <> best THEN 'pick'
                     WHEN abs(confidence - greatest(p1, p2, p3)) > 1e-5 THEN 'confidence' END AS reason FROM claimed)
GROUP BY ALL""")
def _(t):
    rows = _claimed(t)
    reason = checks.prediction_rows(rows, F.col("p"), F.col("claimed"), F.col("confidence"))
    return rows.groupBy("model", F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("pick_payload", "forecasts", f"""
SELECT forecast_id, CASE pick WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS pick,
       CASE pick WHEN 0 THEN home_key WHEN 1 THEN 'Draw' ELSE away_key END AS pick_label,
       {r6("greatest(p_home, p_draw, p_away)")} AS confidence, {r6("1 / greatest(p_home, p_draw, p_away)")} AS fair_odds
FROM (SELECT *, {_ARGMAX} AS pick FROM forecasts)""")
def _(t):
    p = probability.vector()
    names = F.array(*[F.lit(n) for n in fixtures.OUTCOME_NAMES])
    labels = F.array(F.col("home_key"), F.lit("Draw"), F.col("away_key"))
    pick = probability.argmax(p) + 1
    return t.forecasts().select(
        "forecast_id", F.element_at(names, pick).alias("pick"), F.element_at(labels, pick).alias("pick_label"),
        F.round(F.array_max(p), 6).alias("confidence"), F.round(1 / F.array_max(p), 6).alias("fair_odds"))


@query("upcoming", "games", """
SELECT game_id, sport, CAST(start_time AS VARCHAR) AS start_time FROM games
WHERE status = 'scheduled' AND start_time > TIMESTAMP '1998-01-01 00:00:00' AND sport = 'baseball'
ORDER BY start_time, game_id""")
def _(t):
    return (t.games().where("status = 'scheduled' AND start_time > TIMESTAMP_NTZ'1998-01-01 00:00:00' "
                            "AND sport = 'baseball'").orderBy("start_time", "game_id")
            .select("game_id", "sport", F.col("start_time").cast("string").alias("start_time")))


_PAGE = ("sport = 'baseball' AND outcome IS NOT NULL AND (home_key = 'T3' OR away_key = 'T3') AND start_time >= "
         "{0}'1995-01-01 00:00:00' AND start_time < {0}'2001-01-01 00:00:00' AND model = 'm1'")


@query("games_page", "forecasts", f""", hits AS (SELECT * FROM forecasts WHERE {_PAGE.format("TIMESTAMP ")})
SELECT forecast_id, game_id, (SELECT count(*) FROM hits) AS total, (SELECT {r6("avg(-ln(greatest(CASE outcome WHEN 0 "
  "THEN p_home ELSE p_away END, 1e-12)))")} FROM hits) AS mean_loss
FROM hits ORDER BY start_time, game_id, forecast_id LIMIT 20 OFFSET 10""")
def _(t):
    hits = t.forecasts().where(_PAGE.format("TIMESTAMP_NTZ"))
    loss = probability.log_loss(probability.label_probability(probability.vector(), F.col("outcome")))
    summary = hits.agg(F.count("*").alias("total"), F.round(F.avg(loss), 6).alias("mean_loss"))
    page = hits.orderBy("start_time", "game_id", "forecast_id").offset(10).limit(20).select("forecast_id", "game_id")
    return page.select("*", summary.select("total").scalar().alias("total"),
                       summary.select("mean_loss").scalar().alias("mean_loss"))


@query("score_softmax", "games", f""", scored AS (
  SELECT {_LINE}, sport, 0.2 + 0.9 * x1 - 1.5 * x2 AS z0, -0.4 + 0.3 * x3 + 0.1 * x1 AS z1, 0.5 * x2 + 2.0 * x3 AS z2
  FROM (SELECT *, l_quantity / 50 AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem JOIN games ON l_orderkey = game_id)),
 weighted AS (SELECT *, exp(z0 - top) AS w0, CASE WHEN sport = 'soccer' THEN exp(z1 - top) ELSE 0 END AS w1,
  exp(z2 - top) AS w2 FROM (SELECT *, CASE WHEN sport = 'soccer' THEN greatest(z0, z1, z2) ELSE greatest(z0, z2) END
  AS top FROM scored))
SELECT {_LINE}, {r6("w0 / (w0 + w1 + w2)")} AS p_home, {r6("w1 / (w0 + w1 + w2)")} AS p_draw,
  {r6("w2 / (w0 + w1 + w2)")} AS p_away, {r6("1 / (1 + exp(-(z0 - z2)))")} AS p_binary,
  {r6("0.55 * exp(-greatest(-4, least(4, (ln(1 + abs(z0)) - 0.5) / 0.25))) / (0.55 * exp(-greatest(-4, least(4, "
      "(ln(1 + abs(z0)) - 0.5) / 0.25))) + 0.45 * exp(-greatest(-4, least(4, (ln(1 + abs(z2)) - 0.1) / 0.05))))")}
    AS p_decoded
FROM weighted""")
def _(t):
    lines = t.read("lineitem").select(*_LINE.split(", "), (F.col("l_quantity") / 50).alias("x1"),
                                      F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"))
    rows = lines.join(t.games().select("game_id", "sport"), F.col("l_orderkey") == F.col("game_id"))
    xs = [F.col("x1"), F.col("x2"), F.col("x3")]
    z = [probability.dot(xs, w, b) for w, b in [([0.9, -1.5, 0.0], 0.2), ([0.1, 0.0, 0.3], -0.4),
                                                ([0.0, 0.5, 2.0], 0.0)]]
    never = F.lit(False)
    p = probability.masked_softmax(z, [never, F.col("sport") == "baseball", never])
    decoded = probability.prior_adjusted([F.abs(z[0]), F.abs(z[2])], [0.5, 0.1], [0.25, 0.05], [0.55, 0.45])
    return rows.select(*_LINE.split(", "), *[F.round(c, 6).alias(n) for c, n in zip(p, ("p_home", "p_draw", "p_away"))],
                       F.round(probability.sigmoid(z[0] - z[2]), 6).alias("p_binary"),
                       F.round(decoded[0], 6).alias("p_decoded"))


@query("quality_bucket", sql=f"""
SELECT {_LINE}, {r6("q")} AS quality, CASE WHEN l_quantity < 10 THEN 0.0 ELSE {r6("greatest(0, q - 0.1)")} END AS low,
  CASE WHEN l_quantity < 10 THEN 1.0 ELSE {r6("least(1, q + 0.05)")} END AS high,
  CASE WHEN l_quantity >= 10 AND least(1, q + 0.05) < 0.2 THEN 35 ELSE CAST(floor(q * 34 + 0.5) AS INTEGER) END
    AS quality_key
FROM (SELECT *, 1 / (1 + exp(-(l_extendedprice - 50000) / 20000)) AS q FROM lineitem)""")
def _(t):
    q = probability.sigmoid((F.col("l_extendedprice") - 50000) / 20000)
    few = F.col("l_quantity") < 10
    low = F.when(few, 0.0).otherwise(F.greatest(F.lit(0.0), q - 0.1))
    high = F.when(few, 1.0).otherwise(F.least(F.lit(1.0), q + 0.05))
    return t.read("lineitem").select(
        *_LINE.split(", "), F.round(q, 6).alias("quality"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
        probability.quality_key(q, high).alias("quality_key"))


_CACHE = ("SELECT p_partkey % 36 AS k, CAST(count(*) AS DOUBLE) AS c0, sum(p_size) / 10.0 AS c1, "
          "max(p_retailprice) / 100 AS c2, CAST(min(p_size) AS DOUBLE) AS c3 FROM part GROUP BY p_partkey % 36")


@query("lookup_contrast", sql=f"""WITH cache AS ({_CACHE})
SELECT {_LINE}, {", ".join(r6(f"ln(1 + h.c{i}) - ln(1 + a.c{i})") + f" AS z{i}" for i in range(4))},
  {r6("(" + " + ".join(f"ln(1 + h.c{i}) - ln(1 + a.c{i})" for i in range(4)) + ") / 4")} AS contrast
FROM lineitem JOIN cache h ON l_partkey % 36 = h.k JOIN cache a ON l_suppkey % 36 = a.k""")
def _(t):
    cache = t.read("part").groupBy((F.col("p_partkey") % 36).alias("k")).agg(
        F.count("*").cast("double").alias("c0"), (F.sum("p_size") / 10.0).alias("c1"),
        (F.max("p_retailprice") / 100).alias("c2"), F.min("p_size").cast("double").alias("c3"))
    home = cache.select(F.col("k").alias("hk"), *[F.col(f"c{i}").alias(f"h{i}") for i in range(4)])
    away = cache.select(F.col("k").alias("ak"), *[F.col(f"c{i}").alias(f"a{i}") for i in range(4)])
    lines = t.read("lineitem").select(*_LINE.split(", "), (F.col("l_partkey") % 36).alias("hk"),
                                      (F.col("l_suppkey") % 36).alias("ak"))
    z = [F.log1p(f"h{i}") - F.log1p(f"a{i}") for i in range(4)]
    return lines.join(home, "hk").join(away, "ak").select(
        *_LINE.split(", "), *[F.round(c, 6).alias(f"z{i}") for i, c in enumerate(z)],
        F.round((z[0] + z[1] + z[2] + z[3]) / 4, 6).alias("contrast"))


_FAMILIES = [("ECO", "economy"), ("PRO", "promotion"), ("STA", "standard")]


@query("label_family", "all_nodes", """
SELECT id, CASE WHEN starts_with(type, 'ECO') THEN 'economy' WHEN starts_with(type, 'PRO') THEN 'promotion'
                WHEN starts_with(type, 'STA') THEN 'standard' ELSE 'other' END AS family FROM all_nodes""")
def _(t):
    return t.all_nodes().select("id", text.label_family(F.col("type"), _FAMILIES).alias("family"))


@query("token_sign", "all_nodes", """
SELECT id, CASE WHEN transmitter = 'gaba' THEN -1 ELSE 1 END AS sign,
       transmitter IN ('acetylcholine,gaba', 'dopamine') AS uncertain FROM all_nodes""")
def _(t):
    sign, uncertain = text.token_sign(F.col("transmitter"))
    return t.all_nodes().select("id", sign.alias("sign"), uncertain.alias("uncertain"))


@query("eligibility_audit", "edges all_nodes", """
SELECT channel, family, count(*) AS edges, CAST(sum(contacts) AS BIGINT) AS contacts, CAST(sum(CASE WHEN channel = 'home'
       OR family = 'promotion' THEN 1 ELSE 0 END) AS BIGINT) AS eligible
FROM (SELECT contacts, CASE WHEN n.class IN ('Brand#1', 'Brand#2') THEN 'home' ELSE 'away' END AS channel,
        CASE WHEN starts_with(s.type, 'ECO') THEN 'economy' WHEN starts_with(s.type, 'PRO') THEN 'promotion'
             WHEN starts_with(s.type, 'STA') THEN 'standard' ELSE 'other' END AS family
      FROM edges JOIN all_nodes s ON pre = s.id JOIN all_nodes n ON post = n.id) GROUP BY ALL""")
def _(t):
    nodes = t.all_nodes()
    source = nodes.select(F.col("id").alias("pre"), text.label_family(F.col("type"), _FAMILIES).alias("family"))
    target = nodes.select(F.col("id").alias("post"), F.when(F.col("class").isin("Brand#1", "Brand#2"), "home")
                          .otherwise("away").alias("channel"))
    allowed = (F.col("channel") == "home") | (F.col("family") == "promotion")
    return t.edges().join(source, "pre").join(target, "post").groupBy("channel", "family").agg(
        F.count("*").alias("edges"), F.sum("contacts").alias("contacts"), F.count_if(allowed).alias("eligible"))


@query("edge_weighting", "edges all_nodes", """
SELECT pre, post, CAST(CASE WHEN transmitter = 'dopamine' THEN 0 ELSE CAST(CAST(contacts AS FLOAT) *
         CAST(CASE WHEN transmitter = 'gaba' THEN -1 ELSE 1 END AS FLOAT) * CAST(0.1375 AS FLOAT) AS FLOAT) *
         CAST(CASE WHEN type = 'PROMO' AND transmitter = 'gaba' THEN 0.5 ELSE 1 END AS FLOAT) END AS DOUBLE) AS weight
FROM edges JOIN all_nodes ON pre = id""")
def _(t):
    sign, _uncertain = text.token_sign(F.col("transmitter"))
    base = F.col("contacts").cast("float") * sign.cast("float") * F.lit(0.1375).cast("float")
    factor = F.when((F.col("type") == "PROMO") & (F.col("transmitter") == "gaba"), 0.5).otherwise(1.0).cast("float")
    weight = F.when(F.col("transmitter") == "dopamine", F.lit(0).cast("float")).otherwise(base * factor)
    nodes = t.all_nodes().select(F.col("id").alias("pre"), "type", "transmitter")
    return t.edges().join(nodes, "pre").select("pre", "post", weight.cast("double").alias("weight"))


@query("csv_safe", sql=r"""
SELECT p_partkey, CASE WHEN regexp_matches(cell, '^\s*[=+\-@]') THEN '''' || cell ELSE cell END AS cell
FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN '-' WHEN 3 THEN '@'
             WHEN 4 THEN ' ' ELSE '' END || p_name AS cell FROM part)""")
def _(t):
    cell = F.expr("concat(CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN '-' WHEN 3 THEN '@' "
                  "WHEN 4 THEN ' ' ELSE '' END, p_name)")
    return t.read("part").select("p_partkey", text.spreadsheet_safe(cell).alias("cell"))


@query("content_manifest", sql="""
WITH now AS (SELECT doc_id, sha256(text) AS digest, n_chars FROM documents WHERE doc_id % 11 <> 3),
 lock AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS digest
          FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id, n.digest AS now, l.digest AS locked, CASE WHEN l.digest IS NULL THEN 'added' WHEN n.digest IS NULL
       THEN 'missing' WHEN n.digest = l.digest THEN 'same' ELSE 'changed' END AS state
FROM now n FULL JOIN lock l USING (doc_id)""")
def _(t):
    docs = t.read("documents").select("doc_id", "text")
    now = docs.where("doc_id % 11 <> 3").select("doc_id", F.sha2("text", 256).alias("digest"))
    lock = docs.where("doc_id % 10 <> 0").select(
        "doc_id", F.sha2(F.expr("CASE WHEN doc_id % 13 = 0 THEN concat(text, '!') ELSE text END"), 256).alias("digest"))
    return checks.manifest_diff(now, lock, "doc_id", "digest")


@query("season_eligibility", "games", """, items AS (
  SELECT CASE WHEN game_id % 50 = 7 THEN game_id - 1 ELSE game_id END AS pk,
    CASE WHEN game_id % 13 = 0 THEN 'S' ELSE 'R' END AS game_type,
    CASE status WHEN 'final' THEN 'Final' ELSE 'Preview' END AS abstract_state,
    CASE WHEN game_id % 41 = 0 THEN 'Suspended: Rain' ELSE status END AS detailed_state,
    CASE WHEN game_id % 37 = 0 THEN start_time END AS resume_marker, start_time, home_score,
    CASE WHEN game_id % 19 = 0 THEN home_score ELSE away_score END AS away_score, home_key AS home_id,
    CASE WHEN game_id % 23 = 0 THEN home_key ELSE away_key END AS away_id,
    home_score > away_score AS home_winner, CASE WHEN game_id % 29 = 0 THEN NULL ELSE away_score > home_score END
      AS away_winner, game_id AS row_id FROM games WHERE sport = 'baseball'),
 judged AS (SELECT *, CASE WHEN pk IN (SELECT pk FROM items WHERE resume_marker IS NOT NULL OR
      contains(lower(detailed_state), 'suspend')) THEN 'resumed_or_suspended' WHEN game_type <> 'R' THEN 'nonregular'
    WHEN contains(detailed_state, 'postpon') OR contains(detailed_state, 'cancel') THEN 'unplayed'
    WHEN abstract_state <> 'Final' THEN 'nonfinal' WHEN home_score = away_score THEN 'tie' END AS reason FROM items)
SELECT row_id, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN year(start_time) <> 1996 THEN 'season_year'
    WHEN home_id = away_id THEN 'same_team' WHEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY pk) > 1
    THEN 'duplicate_id' WHEN away_winner IS NULL OR home_winner <> (home_score > away_score) OR away_winner <>
    (away_score > home_score) THEN 'winner_flag' END AS violation
FROM judged""")
def _(t):
    items = t.games().where("sport = 'baseball'").selectExpr(
        "CASE WHEN game_id % 50 = 7 THEN game_id - 1 ELSE game_id END AS pk",
        "CASE WHEN game_id % 13 = 0 THEN 'S' ELSE 'R' END AS game_type",
        "CASE status WHEN 'final' THEN 'Final' ELSE 'Preview' END AS abstract_state",
        "CASE WHEN game_id % 41 = 0 THEN 'Suspended: Rain' ELSE status END AS detailed_state",
        "CASE WHEN game_id % 37 = 0 THEN start_time END AS resume_marker", "start_time", "home_score",
        "CASE WHEN game_id % 19 = 0 THEN home_score ELSE away_score END AS away_score", "home_key AS home_id",
        "CASE WHEN game_id % 23 = 0 THEN home_key ELSE away_key END AS away_id", "home_score > away_score AS home_winner",
        "CASE WHEN game_id % 29 = 0 THEN NULL ELSE away_score > home_score END AS away_winner", "game_id AS row_id")
    return checks.season_rows(items, 1996).select("row_id", "reason", "violation")


@query("ordered_games", "games", """
SELECT game_id, CAST(start_time AS VARCHAR) AS start_time, home_key, away_key FROM games ORDER BY start_time, game_id""")
def _(t):
    return t.games().orderBy("start_time", "game_id").select(
        "game_id", F.col("start_time").cast("string").alias("start_time"), "home_key", "away_key")
