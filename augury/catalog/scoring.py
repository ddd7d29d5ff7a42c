"""Forecast scoring, common samples, paired comparison and bootstrap intervals."""

from pyspark.sql import functions as F

from ..functions import probability
from ..operators import idtree, matching, resample, scoring
from .registry import query, r6

BOUNDS = [("train", "1998-01-01"), ("validation", "1999-01-01"), ("test", "2001-01-01")]
SPLIT = ("CASE WHEN start_time < TIMESTAMP '1998-01-01' THEN 'train' WHEN start_time < TIMESTAMP '1999-01-01' "
         "THEN 'validation' WHEN start_time < TIMESTAMP '2001-01-01' THEN 'test' END")
P_LABEL = "CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END"
LOSS = f"-ln(least(greatest({P_LABEL}, 1e-12), 1))"
TOP = "greatest(p_home, p_draw, p_away)"
PICK = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END"
BRIER = ("pow(p_home - CASE WHEN outcome = 0 THEN 1 ELSE 0 END, 2) + pow(p_draw - CASE WHEN outcome = 1 THEN 1 ELSE 0 "
         "END, 2) + pow(p_away - CASE WHEN outcome = 2 THEN 1 ELSE 0 END, 2)")
FIRST = """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, model, seed
      ORDER BY saved_at, forecast_id) AS rn FROM forecasts WHERE outcome IS NOT NULL) WHERE rn = 1)"""


def metric_sql(by, source, having=""):
    return f"""SELECT {by}, CAST(sum(n) AS BIGINT) AS n, {r6("sum(hits) / sum(n)")} AS accuracy,
      {r6("sum(loss) / sum(n)")} AS log_loss, {r6("sum(squared) / sum(n)")} AS brier,
      {r6("sum(abs(hits - conf)) / sum(n)")} AS ece
    FROM (SELECT {by}, least(9, floor({TOP} * 10)) AS bin, count(*) AS n,
            sum(CASE WHEN {PICK} = outcome THEN 1.0::DOUBLE ELSE 0 END) AS hits, sum({TOP}) AS conf,
            sum({LOSS}) AS loss, sum({BRIER}) AS squared FROM {source} GROUP BY ALL) GROUP BY ALL"""


def rounded(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def finals(t):
    return t.forecasts().where("outcome is not null")


def firsts(t):
    return scoring.first_forecasts(finals(t), ["game_id", "model", "seed"])


@query("prob_metrics", "forecasts", metric_sql("sport, model", "(SELECT * FROM forecasts WHERE outcome IS NOT NULL)"))
def _(t):
    return rounded(scoring.outcome_metrics(finals(t), ["sport", "model"]), scoring.METRICS)


@query("calibration", "forecasts", f"""
SELECT sport, CAST(least(9, floor({TOP} * 10)) AS INTEGER) AS bin, count(*) AS n, {r6(f"avg({TOP})")} AS confidence,
  {r6(f"avg(CASE WHEN {PICK} = outcome THEN 1.0 ELSE 0 END)")} AS accuracy
FROM forecasts WHERE outcome IS NOT NULL GROUP BY ALL""")
def _(t):
    return rounded(scoring.reliability(finals(t), ["sport"]), ["confidence", "accuracy"])


_BLOSS = "-(y * ln(greatest(least({p}, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least({p}, 1 - 1e-12), 1e-12)))"


@query("binary_metrics", "binary_rows", f"""
SELECT lang, count(*) AS n, {r6("avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END)")} AS accuracy,
  {r6(f"avg({_BLOSS.format(p='p')})")} AS log_loss, {r6("avg(pow(p - y, 2))")} AS brier FROM binary_rows GROUP BY lang""")
def _(t):
    return rounded(scoring.binary_metrics(t.binary(), ["lang"]), ["accuracy", "log_loss", "brier"])


_SPREAD = ", ".join(f"{r6(f'{f}({m})')} AS {m}_{n}" for m in ("accuracy", "log_loss", "brier", "ece")
                    for f, n in (("avg", "mean"), ("min", "min"), ("max", "max")))
_SEEDS = f""", per_seed AS (SELECT model, sport, split, seed, sum(hits) / sum(n) AS accuracy, sum(loss) / sum(n) AS log_loss,
    sum(squared) / sum(n) AS brier, sum(abs(hits - conf)) / sum(n) AS ece
  FROM (SELECT model, sport, {SPLIT} AS split, seed, least(9, floor({TOP} * 10)) AS bin, count(*) AS n,
          sum(CASE WHEN {PICK} = outcome THEN 1.0::DOUBLE ELSE 0 END) AS hits, sum({TOP}) AS conf, sum({LOSS}) AS loss,
          sum({BRIER}) AS squared FROM firsts GROUP BY ALL) GROUP BY ALL)"""


def _with_split(df):
    return df.withColumn("split", resample.chronological_split(F.col("start_time"), BOUNDS))


@query("metrics_by_seed", "forecasts", f"""{FIRST}{_SEEDS}
SELECT model, sport, split, count(*) AS seeds, {_SPREAD} FROM per_seed GROUP BY ALL""")
def _(t):
    out = scoring.metrics_by_seed(_with_split(firsts(t)), ["model", "sport", "split"])
    return rounded(out, [c for c in out.columns if c not in ("model", "sport", "split", "seeds")])


@query("select_model", "forecasts", f"""{FIRST}{_SEEDS}
SELECT sport, split, model, seeds, {r6("log_loss")} AS log_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY sport, split ORDER BY log_loss, model) AS rn FROM (
    SELECT sport, split, model, count(*) AS seeds, avg(log_loss) AS log_loss FROM per_seed GROUP BY ALL)
  WHERE seeds = 3) WHERE rn = 1""")
def _(t):
    by_model = scoring.metrics_by_seed(_with_split(firsts(t)), ["sport", "split", "model"])
    candidates = by_model.select("sport", "split", "model", "seeds", F.col("log_loss_mean").alias("log_loss"))
    best = scoring.select_model(candidates, ["sport", "split"], F.col("seeds") == 3, ["log_loss", "model"])
    return rounded(best, ["log_loss"])


_Z = probability.Z95


@query("draw_bins", "forecasts", f""", bins AS (
  SELECT b.bin, count(p_draw) AS n, count(*) FILTER (outcome = 1) AS hits, avg(p_draw) AS mean_predicted
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b
  LEFT JOIN (SELECT * FROM forecasts WHERE sport = 'soccer' AND outcome IS NOT NULL) f
    ON least(9, floor(p_draw * 10)) = b.bin GROUP BY ALL),
 raw AS (SELECT *, hits / n AS rate, 1 + {_Z} * {_Z} / n AS scale FROM bins)
SELECT bin, n, hits, {r6("mean_predicted")} AS mean_predicted, CASE WHEN n > 0 THEN {r6("rate")} END AS observed,
  CASE WHEN n > 0 THEN {r6(f"greatest(0, ((rate + {_Z} * {_Z} / (2 * n)) / scale) - {_Z} * sqrt(rate * (1 - rate) / n + {_Z} * {_Z} / (4 * n * n)) / scale)")} END AS low,
  CASE WHEN n > 0 THEN {r6(f"least(1, ((rate + {_Z} * {_Z} / (2 * n)) / scale) + {_Z} * sqrt(rate * (1 - rate) / n + {_Z} * {_Z} / (4 * n * n)) / scale)")} END AS high
FROM raw""")
def _(t):
    rows = scoring.rate_bins(finals(t).where("sport = 'soccer'"), "p_draw", F.col("outcome") == 1)
    return rounded(rows, ["mean_predicted", "observed", "low", "high"])


@query("split_rates", "games", f"""
SELECT {SPLIT} AS split, sport, count(*) AS n, CAST(sum(CASE WHEN outcome = 1 THEN 1 ELSE 0 END) AS BIGINT) AS draws,
  {r6("avg(CASE WHEN outcome = 1 THEN 1.0 ELSE 0 END)")} AS draw_rate
FROM games WHERE outcome IS NOT NULL GROUP BY ALL""")
def _(t):
    rows = _with_split(t.games().where("outcome is not null"))
    draws = F.count_if(F.col("outcome") == 1)
    return rows.groupBy("split", "sport").agg(F.count("*").alias("n"), draws.alias("draws"),
                                              F.round(draws / F.count("*"), 6).alias("draw_rate"))


@query("chrono_split", "games", f"SELECT game_id, {SPLIT} AS split FROM games")
def _(t):
    return _with_split(t.games()).select("game_id", "split")


@query("partition_check", "games", f"""
SELECT CAST(sum(CASE WHEN flags = 1 THEN 1 ELSE 0 END) AS BIGINT) AS in_one_split, CAST(sum(CASE WHEN flags = 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_none,
  CAST(sum(CASE WHEN flags > 1 THEN 1 ELSE 0 END) AS BIGINT) AS in_several
FROM (SELECT CASE WHEN start_time < TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END + CASE WHEN start_time >= TIMESTAMP '1997-12-01'
  AND start_time < TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END + CASE WHEN start_time >= TIMESTAMP '1999-01-01' AND
  start_time < TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END AS flags FROM games)""")
def _(t):
    flags = F.expr("cast(start_time < TIMESTAMP_NTZ'1998-01-01 00:00:00' AS INT) + cast(start_time >= "
                   "TIMESTAMP_NTZ'1997-12-01 00:00:00' AND start_time < TIMESTAMP_NTZ'1999-01-01 00:00:00' AS INT) + "
                   "cast(start_time >= TIMESTAMP_NTZ'1999-01-01 00:00:00' AND start_time < "
                   "TIMESTAMP_NTZ'2001-01-01 00:00:00' AS INT)")
    return t.games().select(flags.alias("flags")).agg(
        F.count_if(F.col("flags") == 1).alias("in_one_split"), F.count_if(F.col("flags") == 0).alias("in_none"),
        F.count_if(F.col("flags") > 1).alias("in_several"))


@query("frequency_prior", "games", f"""
SELECT sport, {r6("(c0 + 1) / (c0 + 1 + d + c2 + 1)")} AS p_home, {r6("d / (c0 + 1 + d + c2 + 1)")} AS p_draw,
  {r6("(c2 + 1) / (c0 + 1 + d + c2 + 1)")} AS p_away
FROM (SELECT *, CASE WHEN sport = 'baseball' THEN 0 ELSE c1 + 1 END AS d FROM (
  SELECT sport, count(*) FILTER (outcome = 0) AS c0, count(*) FILTER (outcome = 1) AS c1,
    count(*) FILTER (outcome = 2) AS c2 FROM games WHERE start_time < TIMESTAMP '1998-01-01' GROUP BY sport))""")
def _(t):
    train = t.games().where("start_time < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    return rounded(scoring.frequency_prior(train, ["sport"]), ["p_home", "p_draw", "p_away"])


@query("ensemble", "forecasts", f"""{FIRST}
SELECT game_id, model, {r6("avg(p_home)")} AS p_home, {r6("avg(p_draw)")} AS p_draw, {r6("avg(p_away)")} AS p_away
FROM firsts GROUP BY ALL HAVING count(*) = 3 AND count(DISTINCT seed) = 3""")
def _(t):
    return rounded(scoring.ensemble(firsts(t), ["game_id", "model"], 3), ["p_home", "p_draw", "p_away"])


# Coverage of every model and every sportsbook; the book side uses the true event of each quote.
_COVERAGE = """, coverage AS (SELECT game_id, 'model:' || model AS source FROM forecasts WHERE sport = 'baseball' AND
    outcome IS NOT NULL UNION SELECT true_game_id, 'book:' || sportsbook FROM quotes JOIN games g ON
    g.game_id = true_game_id AND g.outcome IS NOT NULL),
 common AS (SELECT game_id FROM coverage GROUP BY game_id
            HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM coverage))"""


def coverage(t):
    models = finals(t).where("sport = 'baseball'").select("game_id", F.concat(F.lit("model:"), "model").alias("source"))
    done = t.games().where("outcome is not null").select("game_id")
    books = t.quotes().select(F.col("true_game_id").alias("game_id"),
                              F.concat(F.lit("book:"), "sportsbook").alias("source")).join(done, "game_id", "left_semi")
    return models.unionByName(books)


@query("common_sample", "forecasts quotes", f"{_COVERAGE} SELECT game_id FROM common")
def _(t):
    return scoring.common_sample(coverage(t), "game_id", "source")


@query("coverage_report", "forecasts quotes", f"""{_COVERAGE}
SELECT source, count(DISTINCT game_id) AS games, (SELECT count(*) FROM common) AS shared,
  count(DISTINCT game_id) - (SELECT count(*) FROM common) AS not_shared FROM coverage GROUP BY source""")
def _(t):
    rows = coverage(t).distinct()
    shared = scoring.common_sample(rows, "game_id", "source").agg(F.count("*")).scalar()
    return rows.groupBy("source").agg(F.count("*").alias("games")).select(
        "source", "games", shared.alias("shared"), (F.col("games") - shared).alias("not_shared"))


@query("sample_fingerprint", "games", """, leaves AS (
  SELECT substr(md5(CAST(game_id AS VARCHAR)), 1, 4) AS b4, sha256(string_agg(CAST(game_id AS VARCHAR), ',' ORDER BY
    CAST(game_id AS VARCHAR))) AS d, count(*) AS n FROM games WHERE outcome IS NOT NULL GROUP BY b4),
 halves AS (SELECT substr(b4, 1, 2) AS b2, sha256(string_agg(b4 || d, ',' ORDER BY b4 || d)) AS d, sum(n) AS n
            FROM leaves GROUP BY 1)
SELECT sha256(string_agg(b2 || d, ',' ORDER BY b2 || d)) AS fingerprint, CAST(sum(n) AS BIGINT) AS ids FROM halves""")
def _(t):
    return scoring.fingerprint(t.games().where("outcome is not null").select("game_id"), "game_id")


def _level(depth: int, deepest: int = 7) -> str:
    """One level of the digest tree: leaves where the tree ends here, folded children otherwise."""
    rows = f"""SELECT substr(h, 1, {depth}) AS prefix, sha256(string_agg(id, ',' ORDER BY id)) AS digest, count(*) AS n
  FROM ids WHERE (SELECT depth FROM deep) = {depth} GROUP BY 1"""
    if depth < deepest:
        rows += f""" UNION ALL SELECT substr(prefix, 1, {depth}), sha256(string_agg(prefix || digest, ',' ORDER BY prefix || digest)), sum(n)
  FROM l{depth + 1} GROUP BY 1"""
    return f"l{depth} AS ({rows})"


@query("sample_tree", "games", f""", ids AS (SELECT CAST(game_id AS VARCHAR) AS id, md5(CAST(game_id AS VARCHAR)) AS h
  FROM games WHERE outcome IS NOT NULL),
 deep AS (SELECT min(d) AS depth FROM range(8) r(d) WHERE 64 * pow(16, d) >= (SELECT count(*) FROM ids)),
 {", ".join(_level(d) for d in range(7, -1, -1))}
{" UNION ALL ".join(f"SELECT {d} AS level, prefix, digest, CAST(n AS BIGINT) AS n FROM l{d}" for d in range(8))}""")
def _(t):
    """Every node of the digest tree over the played events; the depth follows their number."""
    return idtree.hash_tree(t.games().where("outcome is not null").select("game_id"), "game_id", leaf_size=64)


@query("tree_difference", "games quotes", """, l AS (SELECT game_id AS id, count(*) AS n FROM games WHERE outcome IS NOT NULL GROUP BY 1),
 r AS (SELECT id, 1 AS n FROM (SELECT DISTINCT game_id AS id FROM quotes WHERE game_id IS NOT NULL))
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN coalesce(l.n, 0) > coalesce(r.n, 0) THEN 'left' ELSE 'right' END AS side,
  CAST(abs(coalesce(l.n, 0) - coalesce(r.n, 0)) AS BIGINT) AS copies FROM l FULL JOIN r USING (id) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def _(t):
    """Played events against quoted events, found leaf by leaf."""
    played = t.games().where("outcome is not null").select("game_id")
    return idtree.tree_difference(played, t.quotes().select("game_id").distinct(), "game_id", leaf_size=64)


@query("coverage_check", "forecasts", """, models AS (SELECT DISTINCT model FROM forecasts),
 side AS (SELECT model, game_id, count(*) AS n, min(outcome) AS o, min(CAST(fixture_start AS VARCHAR)) AS s FROM forecasts GROUP BY ALL),
 fixtures AS (SELECT model, game_id, outcome AS o, CAST(start_time AS VARCHAR) AS s FROM games, models)
SELECT model, game_id, CASE WHEN f.s IS NULL THEN 'only_left' WHEN n IS NULL THEN 'only_right' WHEN n > 1 THEN 'duplicate'
  WHEN p.o IS DISTINCT FROM f.o OR p.s IS DISTINCT FROM f.s THEN 'mismatch' ELSE 'matched' END AS state
FROM side p FULL JOIN fixtures f USING (model, game_id)""")
def _(t):
    """Every model's forecasts against all fixtures."""
    text = F.col("start_time").cast("string").alias("start_text")
    picks = t.forecasts().select("model", "game_id", "outcome", F.col("fixture_start").cast("string").alias("start_text"))
    models = t.forecasts().select("model").distinct().agg(F.collect_list("model")).scalar()
    fixtures = t.games().select("game_id", "outcome", text, models.alias("m")).select(F.explode("m").alias("model"), "game_id", "outcome", "start_text")
    return scoring.coverage_check(picks, fixtures, ["model", "game_id"], ["outcome", "start_text"])


_PAIRS = f"""{FIRST}, pairs AS (
  SELECT a.sport, a.game_id, a.seed, a.start_time, a.l - b.l AS difference
  FROM (SELECT *, {LOSS} AS l FROM firsts WHERE model = 'm0') a
  JOIN (SELECT *, {LOSS} AS l FROM firsts WHERE model = 'm1') b ON a.game_id = b.game_id AND a.seed = b.seed)"""


@query("paired_diff", "forecasts", f"""{_PAIRS}
SELECT sport, game_id, seed, true AS agreed, {r6("difference")} AS difference FROM pairs""")
def _(t):
    out = scoring.paired_differences(firsts(t), "m0", "m1", ["sport", "game_id"])
    return rounded(out, ["difference"]).drop("start_time")


#: Replicates as in the reference: paired calendar weeks, and ISO weeks.
REPS, ISO_REPS, SEED = 2000, 10000, 20260910


def _draws(blocks, by, totals, reps, seed, alpha=0.025):
    """SQL of the replicate table and its intervals over ``blocks`` (group, ix, n, totals)."""
    on = " AND ".join(f"b.{c} = s.{c}" for c in by)
    keys = ", ".join(f"s.{c}" for c in by)
    sums = ", ".join(f"sum(b.{c}) / sum(b.n) AS {c}" for c in totals)
    bounds = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{side}" for c in totals
                       for q, side in ((alpha, "low"), (1 - alpha, "high")))
    return f"""sizes AS (SELECT {", ".join(by)}, max(ix) + 1 AS weeks FROM {blocks} GROUP BY ALL),
 drawn AS (SELECT {", ".join(by)}, r.range AS rep, w.range AS j, weeks,
     CAST('0x' || substr(md5(concat_ws(':', {seed}, r.range, w.range)), 1, 15) AS BIGINT) % weeks AS ix
   FROM sizes, range({reps}) r, range(100000) w WHERE w.range < weeks),
 samples AS (SELECT {keys}, s.rep, {sums} FROM drawn s JOIN {blocks} b ON {on} AND b.ix = s.ix GROUP BY ALL
             HAVING sum(b.n) > 0),
 bounds AS (SELECT {", ".join(by)}, {bounds} FROM samples GROUP BY ALL)"""


@query("week_bootstrap", "forecasts", f"""{_PAIRS},
 entries AS (SELECT sport, game_id, max(start_time) AS start_time, avg(difference) AS difference FROM pairs GROUP BY ALL),
 weekly AS (SELECT sport, CAST(date_trunc('week', start_time) AS DATE) AS week, count(*) AS n, sum(difference) AS difference
            FROM entries GROUP BY ALL),
 ends AS (SELECT sport, min(week) AS first, max(week) AS last FROM weekly GROUP BY ALL),
 blocks AS (SELECT e.sport, i.range AS ix, coalesce(n, 0) AS n, coalesce(difference, 0) AS difference
   FROM ends e JOIN range(100000) i ON i.range <= date_diff('day', first, last) // 7
   LEFT JOIN weekly w ON w.sport = e.sport AND w.week = first + CAST(7 * i.range AS INTEGER)),
 {_draws("blocks", ["sport"], ["difference"], REPS, SEED)}
SELECT sport, CAST(sum(n) AS BIGINT) AS rows, count(*) AS weeks, count(*) FILTER (n = 0) AS empty_weeks,
  {r6("sum(difference) / sum(n)")} AS difference_mean, {r6("any_value(difference_low)")} AS difference_low,
  {r6("any_value(difference_high)")} AS difference_high, CASE WHEN any_value(difference_high) < 0 THEN 'better'
  WHEN any_value(difference_low) > 0 THEN 'worse' ELSE 'uncertain' END AS decision
FROM blocks JOIN bounds USING (sport) GROUP BY sport""")
def _(t):
    pairs = scoring.paired_differences(firsts(t), "m0", "m1", ["sport", "game_id"])
    entries = scoring.seed_averaged(pairs, ["sport", "game_id"])
    blocks = resample.week_blocks(entries, ["sport"], "start_time", ["difference"], keep_empty=True)
    out = resample.bootstrap(blocks, ["sport"], ["difference"], REPS, SEED)
    out = out.withColumn("decision", resample.decision("difference_low", "difference_high"))
    return rounded(out, ["difference_mean", "difference_low", "difference_high"])


_BIN = f""", entries AS (SELECT lang, day, CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END AS correct,
    {_BLOSS.format(p="p")} - {_BLOSS.format(p="0.5")} AS vs_uniform,
    {_BLOSS.format(p="p")} - {_BLOSS.format(p="p_rival")} AS vs_rival FROM binary_rows),
 blocks AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY week) - 1 AS ix, n, correct, vs_uniform, vs_rival
   FROM (SELECT lang, date_trunc('week', day) AS week, count(*) AS n, sum(correct) AS correct,
           sum(vs_uniform) AS vs_uniform, sum(vs_rival) AS vs_rival FROM entries GROUP BY ALL))"""
_TOTALS = ["correct", "vs_uniform", "vs_rival"]


@query("iso_week_bootstrap", "binary_rows", f"""{_BIN}, {_draws("blocks", ["lang"], _TOTALS, ISO_REPS, SEED)}
SELECT lang, CAST(sum(n) AS BIGINT) AS rows, count(*) AS weeks, {", ".join(f"{r6(f'sum({c}) / sum(n)')} AS {c}_mean, "
  f"{r6(f'any_value({c}_low)')} AS {c}_low, {r6(f'any_value({c}_high)')} AS {c}_high" for c in _TOTALS)},
  any_value(correct_low) > 0.5 AND any_value(vs_uniform_high) < 0 AND any_value(vs_rival_high) < 0 AS goal_passed
FROM blocks JOIN bounds USING (lang) GROUP BY lang""")
def _(t):
    loss = {n: probability.binary_loss(F.col("y"), c) for n, c in
            (("p", F.col("p")), ("uniform", F.lit(0.5)), ("rival", F.col("p_rival")))}
    entries = t.binary().select(
        "lang", "day", ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double").alias("correct"),
        (loss["p"] - loss["uniform"]).alias("vs_uniform"), (loss["p"] - loss["rival"]).alias("vs_rival"))
    blocks = resample.week_blocks(entries, ["lang"], "day", _TOTALS, keep_empty=False)
    out = resample.bootstrap(blocks, ["lang"], _TOTALS, ISO_REPS, SEED).drop("empty_weeks")
    goal = (F.col("correct_low") > 0.5) & (F.col("vs_uniform_high") < 0) & (F.col("vs_rival_high") < 0)
    out = out.withColumn("goal_passed", goal)
    return rounded(out, [f"{c}_{s}" for c in _TOTALS for s in ("mean", "low", "high")])


# Arms share one fixed procedure: m0 is the treated arm, m1 its matched twin, m2 the shuffled control.
_ARMS = f""", arms AS (SELECT sport, game_id, max(start_time) AS start_time, avg(CASE WHEN model = 'm0' THEN l END) AS l0,
    avg(CASE WHEN model = 'm1' THEN l END) AS l1, avg(CASE WHEN model = 'm2' THEN l END) AS l2
  FROM (SELECT *, {LOSS} AS l FROM firsts) GROUP BY ALL),
 entries AS (SELECT sport, start_time, l0 - l1 AS vs_twin, l2 - l1 AS control_vs_twin FROM arms
             WHERE l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL),
 blocks AS (SELECT sport, row_number() OVER (PARTITION BY sport ORDER BY week) - 1 AS ix, n, vs_twin, control_vs_twin
   FROM (SELECT sport, date_trunc('week', start_time) AS week, count(*) AS n, sum(vs_twin) AS vs_twin,
           sum(control_vs_twin) AS control_vs_twin FROM entries GROUP BY ALL))"""
_ARM_TOTALS = ["vs_twin", "control_vs_twin"]


@query("arm_compare", "forecasts", f"""{FIRST}{_ARMS}, {_draws("blocks", ["sport"], _ARM_TOTALS, ISO_REPS, SEED)}
SELECT sport, CAST(sum(n) AS BIGINT) AS rows, count(*) AS weeks, {", ".join(f"{r6(f'sum({c}) / sum(n)')} AS {c}_mean, "
  f"{r6(f'any_value({c}_low)')} AS {c}_low, {r6(f'any_value({c}_high)')} AS {c}_high" for c in _ARM_TOTALS)},
  any_value(vs_twin_high) < 0 AND any_value(control_vs_twin_high) >= 0 AS contributes
FROM blocks JOIN bounds USING (sport) GROUP BY sport""")
def _(t):
    entries = matching.same_events(firsts(t), ["sport", "game_id"], ["m0", "m1", "m2"]).select(
        "sport", "start_time", (F.col("m0") - F.col("m1")).alias("vs_twin"),
        (F.col("m2") - F.col("m1")).alias("control_vs_twin"))
    blocks = resample.week_blocks(entries, ["sport"], "start_time", _ARM_TOTALS, keep_empty=False)
    out = resample.bootstrap(blocks, ["sport"], _ARM_TOTALS, ISO_REPS, SEED).drop("empty_weeks")
    out = out.withColumn("contributes", (F.col("vs_twin_high") < 0) & (F.col("control_vs_twin_high") >= 0))
    return rounded(out, [f"{c}_{s}" for c in _ARM_TOTALS for s in ("mean", "low", "high")])


@query("model_compare", "forecasts", f"""{FIRST}, losses AS (SELECT sport, game_id, model, avg({LOSS}) AS l
    FROM firsts GROUP BY ALL),
 shared AS (SELECT game_id FROM losses GROUP BY ALL HAVING count(DISTINCT model) = 3)
SELECT sport, model, count(*) AS own_games, count(*) FILTER (s.game_id IS NOT NULL) AS shared_games,
  {r6("avg(l)")} AS own_loss, {r6("avg(l) FILTER (s.game_id IS NOT NULL)")} AS shared_loss
FROM losses LEFT JOIN shared s USING (game_id) GROUP BY ALL""")
def _(t):
    return rounded(matching.model_table(firsts(t), ["m0", "m1", "m2"]), ["own_loss", "shared_loss"])
