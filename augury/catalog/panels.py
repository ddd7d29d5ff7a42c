"""Experiment tables, windows, profiles and feature scaling."""

from pyspark.sql import functions as F

from ..operators import panel
from .registry import query, r6
from .scoring import rounded


def _round(df, keep):
    return rounded(df, [c for c in df.columns if c not in keep])


@query("phase_sums", "trials", """
SELECT unit, seed_set, round(coalesce(sum(value) FILTER (bin < 20), 0), 4) AS pre_onset, round(coalesce(sum(value) FILTER (bin >= 20 AND
  bin < 40), 0), 4) AS stimulus, round(coalesce(sum(value) FILTER (bin >= 40), 0), 4) AS post FROM trials GROUP BY ALL""")
def _(t):
    out = panel.phase_sums(t.trials(), ["unit", "seed_set"], "bin", "value", [("pre_onset", 20), ("stimulus", 40), ("post", 60)])
    return out.select("unit", "seed_set", *[F.round(c, 4).alias(c) for c in ("pre_onset", "stimulus", "post")])


def _sum(condition, compartment):
    return f"sum(value) FILTER (condition = '{condition}' AND bin % 2 = {compartment})"


_CELLS = ", ".join(f"{_sum(c, k)} AS {c}_{k}" for c in ("click", "purchase", "view") for k in (0, 1))
_WHOLE = " AND ".join(f"{c}_{k} IS NOT NULL" for c in ("click", "purchase", "view") for k in (0, 1))


@query("panel_effects", "trials", f""", wide AS (SELECT * FROM (SELECT unit, seed_set, {_CELLS} FROM trials GROUP BY ALL) WHERE {_WHOLE}),
 tall AS (SELECT seed_set, 'click' AS label, click_0 - view_0 AS effect, view_0 AS untaught, click_1 - view_1 AS leak FROM wide
   UNION ALL SELECT seed_set, 'purchase', purchase_1 - view_1, view_1, purchase_0 - view_0 FROM wide),
 agg AS (SELECT seed_set, label, count(*) AS units, avg(effect) AS me, stddev_samp(effect) AS se, count(*) FILTER (effect < 0) AS negative,
   avg(untaught) AS mu, stddev_samp(untaught) AS su, avg(leak) AS leak FROM tall GROUP BY ALL)
SELECT seed_set, label, units, {r6("me")} AS mean_effect, {r6("se")} AS sd_effect, negative, {r6("mu")} AS mean_untaught,
  {r6("su")} AS sd_untaught, {r6("leak")} AS leak, me < 0 AND abs(me) >= 3 * abs(mu) AS teaching_passed,
  abs(mu) <= 0.5 * coalesce(su, 0) AS guard_passed, abs(leak) <= 0.05 * abs(me) AS leak_passed FROM agg""")
def _(t):
    rows = t.trials().select("unit", "seed_set", "condition", (F.col("bin") % 2).alias("compartment"), "value")
    out = panel.panel_effects(rows, {"click": 0, "purchase": 1}, "view")
    return rounded(out, ["mean_effect", "sd_effect", "mean_untaught", "sd_untaught", "leak"])


@query("drift_limit", "trials", f"""
SELECT unit, {r6("arg_max(value, event_id)")} AS final, {r6("avg(value)")} AS mean, count(*) FILTER (value <= 1 OR value >= 90) AS bound_hits,
  abs(arg_max(value, event_id)) <= 1.5 * abs(avg(value)) AS passed FROM trials GROUP BY unit""")
def _(t):
    return rounded(panel.drift_limit(t.trials(), ["unit"], "event_id", "value", (1, 90), 1.5), ["final", "mean"])


@query("occupancy", "trials", f""", q AS (SELECT condition, list_transform(range(11), lambda i: i / 10.0) AS qs FROM trials GROUP BY condition),
 d AS (SELECT t.condition, {", ".join(f"quantile_cont(value, {i / 10}) AS d{i}" for i in range(11))}, count(*) AS n,
   avg(CASE WHEN value <= 1 THEN 1.0 ELSE 0 END) AS at_low, avg(CASE WHEN value >= 90 THEN 1.0 ELSE 0 END) AS at_high FROM trials t GROUP BY ALL)
SELECT condition, i.range / 10 AS q, n, {r6("at_low")} AS at_low, {r6("at_high")} AS at_high, {r6("[" + ", ".join(f"d{i}" for i in range(11))
  + "][i.range + 1]")} AS quantile FROM d, range(11) i""")
def _(t):
    shares, deciles = panel.occupancy(t.trials(), ["condition"], "value", 1, 90)
    return rounded(deciles.join(shares, "condition"), ["at_low", "at_high", "quantile"])


_ARM = """, r AS (SELECT condition AS arm, unit % 3 AS seed, bin % 2 AS cue, CASE WHEN hour(ts) < 12 THEN 'unit' ELSE 'end' END AS stage, value
    FROM trials),
 c AS (SELECT arm, seed, (avg(value) FILTER (cue = 0 AND stage = 'end') - avg(value) FILTER (cue = 0 AND stage = 'unit'))
    - (avg(value) FILTER (cue = 1 AND stage = 'end') - avg(value) FILTER (cue = 1 AND stage = 'unit')) AS contrast,
    avg(value) FILTER (cue = 0 AND stage = 'end') - avg(value) FILTER (cue = 0 AND stage = 'unit') AS target_change FROM r GROUP BY ALL)"""


def _arms(t):
    return t.trials().select(F.col("condition").alias("arm"), (F.col("unit") % 3).alias("seed"), (F.col("bin") % 2).alias("cue"),
                             F.when(F.hour("ts") < 12, "unit").otherwise("end").alias("stage"), "value", "unit")


@query("contrast_criteria", "trials", f"""{_ARM}, a AS (SELECT arm, avg(contrast) AS mean, bool_and(contrast < 0) AS all_negative,
    bool_and(contrast > 0) AS all_positive, bool_and(target_change < 0) AS target_depressed FROM c GROUP BY arm),
 s AS (SELECT max(abs(mean)) AS null_scale FROM a WHERE arm IN ('view', 'error'))
SELECT arm, {r6("mean")} AS mean, all_negative, all_positive, target_depressed, {r6("null_scale")} AS null_scale,
  all_negative AND abs(mean) >= 3 * null_scale AS acquired, all_positive AND abs(mean) >= 3 * null_scale AS mirrored FROM a, s""")
def _(t):
    return rounded(panel.contrast_criteria(_arms(t), ["view", "error"]), ["mean", "null_scale"])


@query("pairwise_jaccard", "trials", """, s AS (SELECT DISTINCT condition || '-' || seed_set AS name, unit FROM trials),
 n AS (SELECT name, count(*) AS size FROM s GROUP BY name),
 p AS (SELECT a.name AS a, b.name AS b, count(*) AS shared FROM s a JOIN s b ON a.unit = b.unit AND a.name < b.name GROUP BY ALL)
SELECT x.name AS a, y.name AS b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / greatest(x.size + y.size - coalesce(shared, 0), 1), 6)
  AS jaccard FROM n x JOIN n y ON x.name < y.name LEFT JOIN p ON p.a = x.name AND p.b = y.name""")
def _(t):
    rows = t.trials().select(F.concat_ws("-", "condition", "seed_set").alias("name"), "unit")
    return rounded(panel.pairwise_jaccard(rows, "name", "unit"), ["jaccard"])


@query("preference", "trials", """
SELECT unit, CAST(coalesce(sign(avg(value) FILTER (bin % 2 = 0) - avg(value) FILTER (bin % 2 = 1)), 0) AS INTEGER) AS preference
FROM trials GROUP BY unit""")
def _(t):
    return panel.preference(_arms(t), "unit")


@query("key_profile", sql=f"""
WITH m AS (SELECT l_partkey % 36 AS key, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
 r AS (SELECT *, rank() OVER (ORDER BY level) + (count(*) OVER (PARTITION BY level) - 1) / 2.0 AS rl,
   rank() OVER (ORDER BY key) AS rk FROM (SELECT *, (ln(1 + quantity) + ln(1 + price)) / 2 AS level FROM m))
SELECT key, {r6("quantity")} AS quantity, {r6("price")} AS price, {r6("(SELECT corr(rl, rk) FROM r)")} AS spearman FROM m""")
def _(t):
    rows = t.read("lineitem").select((F.col("l_partkey") % 36).alias("key"), F.col("l_quantity").alias("quantity"),
                                     F.col("l_extendedprice").alias("price"))
    return _round(panel.key_profile(rows, "key", ["quantity", "price"]), ["key"])


@query("condition_gates", "trials", f"""
SELECT condition, {r6("min(value)")} AS low, {r6("max(value)")} AS high, bool_and(value >= 0) AS all_nonnegative, bool_and(value < 95) AS all_bounded,
  bool_or(value >= 0) AS any_nonnegative, bool_or(value < 95) AS any_bounded FROM trials GROUP BY condition""")
def _(t):
    gates = {"nonnegative": F.col("value") >= 0, "bounded": F.col("value") < 95}
    return rounded(panel.condition_gates(t.trials(), "value", gates), ["low", "high"])


@query("entity_events", "trials", f""", p AS (SELECT unit, seed_set, count(*) AS events, count(*) FILTER (hour(ts) < 8) AS pre, sum(value) AS mass,
    coalesce(sum(value) FILTER (hour(ts) >= 8), 0) AS adm, min(value) AS least, max(value) AS most, arg_max(value, event_id) AS last
  FROM trials GROUP BY ALL)
SELECT unit, CAST(sum(events) AS BIGINT) AS events, CAST(sum(pre) AS BIGINT) AS pre_onset_events, CAST(sum(events) - sum(pre) AS BIGINT)
  AS admitted_events, round(sum(mass), 4) AS mass, round(sum(adm), 4) AS admitted_mass, {r6("min(least)")} AS minimum, {r6("max(most)")} AS maximum,
  {r6("min(last)")} AS end_min, {r6("max(last)")} AS end_max FROM p GROUP BY unit""")
def _(t):
    out = panel.entity_events(t.trials(), "unit", "seed_set", "event_id", F.hour("ts") < 8)
    return out.select("unit", "events", "pre_onset_events", "admitted_events", F.round("mass", 4).alias("mass"),
                      F.round("admitted_mass", 4).alias("admitted_mass"),
                      *[F.round(c, 6).alias(c) for c in ("minimum", "maximum", "end_min", "end_max")])


@query("mass_share", "trials", """, net AS (SELECT seed_set, unit, sum(value - 20) AS net FROM trials GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY seed_set ORDER BY net, unit) AS rank FROM net)
SELECT seed_set, round(sum(-least(net, 0)), 4) AS negative_mass, round(sum(greatest(net, 0)), 4) AS positive_mass, count(*) FILTER (net < 0) AS negative,
  count(*) FILTER (net > 0) AS positive, round(coalesce(sum(-least(net, 0)) FILTER (rank <= 10) / nullif(sum(-least(net, 0)), 0), 0), 6) AS top_share
FROM r GROUP BY seed_set""")
def _(t):
    rows = t.trials().select("seed_set", "unit", (F.col("value") - 20).alias("value"))
    out = panel.mass_share(rows, "seed_set", "unit")
    return out.select("seed_set", F.round("negative_mass", 4).alias("negative_mass"), F.round("positive_mass", 4).alias("positive_mass"),
                      "negative", "positive", F.round("top_share", 6).alias("top_share"))


@query("bin_attribution", "trials", f"""
SELECT condition, bin, count(*) AS trials, {r6("avg(v)", 9)} AS mean, {r6("stddev_samp(v)")} AS sd FROM (
  SELECT unit, seed_set, condition, bin, sum(value) AS v FROM trials GROUP BY ALL) GROUP BY ALL""")
def _(t):
    out = panel.bin_attribution(t.trials(), ["unit", "seed_set"], ["condition", "bin"])
    return out.select("condition", "bin", "trials", F.round("mean", 9).alias("mean"), F.round("sd", 6).alias("sd"))


@query("lag_corr", "trials", f""", s AS (SELECT seed_set, bin, coalesce(sum(value) FILTER (condition = 'view'), 0) AS x,
    coalesce(sum(value) FILTER (condition = 'click'), 0) AS y FROM trials GROUP BY ALL)
SELECT a.seed_set, k.range - 5 AS lag, count(*) AS overlap, {r6("coalesce(corr(a.x, b.y), 0)")} AS correlation
FROM s a JOIN range(11) k ON true JOIN s b ON b.seed_set = a.seed_set AND b.bin = a.bin + k.range - 5 GROUP BY ALL""")
def _(t):
    series = t.trials().groupBy("seed_set", "bin").agg(*[
        F.coalesce(F.sum(F.when(F.col("condition") == c, F.col("value"))), F.lit(0.0)).alias(n)
        for c, n in (("view", "x"), ("click", "y"))])
    return rounded(panel.lag_corr(series, ["seed_set"], range(-5, 6)), ["correlation"])


@query("day_rollup", "games edges", """
SELECT CAST(start_time AS DATE) AS day, count(*) AS games, count(outcome) AS updates, CAST(sum(coalesce(home_score, 0) + coalesce(away_score, 0)) AS
  BIGINT) AS points FROM games GROUP BY 1""")
def _(t):
    points = F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))
    return t.games().groupBy(F.col("start_time").cast("date").alias("day")).agg(
        F.count("*").alias("games"), F.count("outcome").alias("updates"), F.sum(points).alias("points"))


@query("baseline_delta", "trials", """, c AS (SELECT unit, CAST(ts AS DATE) AS day, sum(value) AS v FROM trials GROUP BY ALL),
 b AS (SELECT unit, arg_min(v, day) AS base FROM c GROUP BY unit)
SELECT day, count(*) AS units, round(sum(v - base), 4) AS change, round(sum(abs(v - base)), 4) AS absolute_change FROM c JOIN b USING (unit) GROUP BY day""")
def _(t):
    out = panel.baseline_delta(t.trials().withColumn("day", F.col("ts").cast("date")), "unit", "day", "value")
    return out.select("day", "units", F.round("change", 4).alias("change"), F.round("absolute_change", 4).alias("absolute_change"))


_WINDOWS = [("early_open", 0, 10, False), ("early_closed", 0, 10, True), ("late_open", 45, 60, False), ("beyond", 50, 70, True)]
_WIN_SQL = ", ".join(f"('{n}', {a}, {b}, {str(c).lower()})" for n, a, b, c in _WINDOWS)


@query("window_compare", "trials", f""", w AS (SELECT * FROM (VALUES {_WIN_SQL}) v("window", lo, hi, closed)),
 m AS (SELECT condition, seed_set, "window", count(*) FILTER (ok) AS samples, avg(value) FILTER (ok) AS mean, min(bin) FILTER (ok) AS first,
   max(bin) FILTER (ok) AS last, min(bin) <= max(lo) AND max(bin) >= max(hi) AS complete
  FROM (SELECT t.*, w.*, bin >= lo AND CASE WHEN closed THEN bin <= hi ELSE bin < hi END AS ok FROM trials t, w) GROUP BY ALL),
 z AS (SELECT *, (mean - min(mean) OVER p) / nullif(max(mean) OVER p - min(mean) OVER p, 0) AS z FROM m WINDOW p AS (PARTITION BY seed_set, "window")),
 n AS (SELECT condition, "window", avg(z) AS normal_mean, CASE WHEN count(z) > 1 THEN stddev_samp(z) / sqrt(count(z)) END AS normal_sem FROM z GROUP BY ALL)
SELECT condition, seed_set, "window", samples, {r6("mean")} AS mean, first, last, complete, {r6("normal_mean")} AS normal_mean,
  {r6("normal_sem")} AS normal_sem FROM m JOIN n USING (condition, "window")""")
def _(t):
    cells = panel.window_means(t.trials(), ["condition", "seed_set"], "bin", "value", _WINDOWS)
    tagged = cells.withColumn("pair", F.struct("condition", "window"))
    normal = panel.normalise_across(tagged, ["seed_set", "window"], "pair", "mean").select(
        "pair.condition", "pair.window", F.col("mean").alias("normal_mean"), F.col("sem").alias("normal_sem"))
    return rounded(cells.join(normal, ["condition", "window"]), ["mean", "normal_mean", "normal_sem"])


_TALL = """WITH x AS (SELECT vec_id, label, vec_id % 5 < 4 AS train, i.range AS channel, CAST(embedding[i.range + 1] AS DOUBLE) AS x
   FROM embeddings, range(64) i)"""


@query("scale_clip", sql=f"""{_TALL}, s AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS d FROM x WHERE train GROUP BY channel)
SELECT vec_id, channel, {r6("greatest(-8, least(8, (x - m) / greatest(d, 0.01)))")} AS scaled FROM x JOIN s USING (channel)""")
def _(t):
    rows = panel.scale_vectors(t.read("embeddings"), F.col("vec_id") % 5 < 4, "embedding", 64)
    return rows.select("vec_id", F.posexplode("scaled").alias("channel", "scaled")).withColumn("scaled", F.round("scaled", 6))


@query("scale_diagnostics", sql=f"""{_TALL}, s AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS d FROM x WHERE train GROUP BY channel),
 u AS (SELECT x.*, (x - m) / greatest(d, 0.01) AS u FROM x JOIN s USING (channel)),
 c AS (SELECT train, label % 2 AS side, channel, max(x) = min(x) AS flat, stddev_pop(x) < 0.01 AS low FROM u GROUP BY ALL),
 r AS (SELECT train, label % 2 AS side, vec_id, count(*) FILTER (abs(u) > 2) AS clipped, max(abs(u)) AS top FROM u GROUP BY ALL)
SELECT train, side, count(*) AS rows, (SELECT count(*) FILTER (flat) FROM c WHERE c.train = r.train AND c.side = r.side) AS constant_channels,
  (SELECT count(*) FILTER (low) FROM c WHERE c.train = r.train AND c.side = r.side) AS below_floor, {r6("sum(clipped) / (count(*) * 64)")} AS clipped_share,
  {r6("avg(CASE WHEN clipped > 0 THEN 1.0 ELSE 0 END)")} AS rows_clipped_share, {r6("max(top)")} AS largest FROM r GROUP BY train, side""")
def _(t):
    vectors = t.read("embeddings").withColumns({"train": F.col("vec_id") % 5 < 4, "side": F.col("label") % 2})
    scaled = panel.scale_vectors(vectors, F.col("train"), "embedding", 64)
    out = panel.scale_diagnostics(scaled, ["train", "side"], "embedding", 64, bound=2.0)
    return rounded(out, ["clipped_share", "rows_clipped_share", "largest"])


@query("window_pool", sql=f"""{_TALL}
SELECT label, channel % 16 AS channel, {r6("avg(x)")} AS whole, {", ".join(f"{r6(f'avg(x) FILTER (channel // 16 = {w})')} AS w{w}" for w in range(4))}
FROM x GROUP BY label, channel % 16""")
def _(t):
    out = panel.window_pool(t.read("embeddings"), ["label"], "embedding", 4, 16)
    return rounded(out, ["whole", "w0", "w1", "w2", "w3"])
