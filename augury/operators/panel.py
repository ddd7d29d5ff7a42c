"""Factorial experiment tables: matched effects, guard bands, windows, profiles and scaling.

Cells are pivoted with conditional sums in a single aggregation instead of joining treated rows to their controls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import clip_scale
from ..plans.ordered import exact_quantiles, first_rows, ranked
from ..plans.session import stable


def when_sum(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def phase_of(step: Column, bounds: list[tuple[str, int]]) -> Column:
    """First phase whose exclusive end is after ``step``."""
    head, *tail = bounds
    out = F.when(step < head[1], head[0])
    for name, end in tail:
        out = out.when(step < end, name)
    return out


def phase_sums(rows: DataFrame, by: list[str], step: str, value: str, bounds: list[tuple[str, int]]) -> DataFrame:
    """Sums of a binned value over the trial phases, as columns."""
    phase = phase_of(F.col(step), bounds)
    return rows.groupBy(*by).agg(*[F.coalesce(when_sum(phase == n, F.col(value)), F.lit(0.0)).alias(n) for n, _ in bounds])


def matched_cells(rows: DataFrame, unit: list[str], labels: dict[str, str], compartments: int, control: str) -> DataFrame:
    """Per unit: every condition's compartment sums as columns ``{condition}_{c}``; incomplete units are left out."""
    wanted = [*labels, control]
    sums = [when_sum((F.col("condition") == k) & (F.col("compartment") == c), F.col("value")).alias(f"{k}_{c}")
            for k in wanted for c in range(compartments)]
    wide = rows.where(F.col("condition").isin(wanted)).groupBy(*unit).agg(*sums)
    return wide.where(reduce(lambda a, b: a & b, [F.col(f"{k}_{c}").isNotNull() for k in wanted
                                                  for c in range(compartments)]))


def panel_effects(rows: DataFrame, labels: dict[str, int], control: str, effect_ratio: float = 3.0,
                  guard_ratio: float = 0.5, leak_ratio: float = 0.05) -> DataFrame:
    """Matched effects per (seed set, taught label): teaching, untaught guard band and leak into the other side.

    ``labels`` maps a taught condition to its own compartment; rows hold unit, seed_set, condition, compartment, value.
    """
    wide = matched_cells(rows, ["unit", "seed_set"], labels, len(labels), control)
    cells = []
    for name, own in labels.items():
        other = next(c for c in labels.values() if c != own)
        cells.append(F.struct(
            F.lit(name).alias("label"), (F.col(f"{name}_{own}") - F.col(f"{control}_{own}")).alias("effect"),
            F.col(f"{control}_{own}").alias("untaught"),
            (F.col(f"{name}_{other}") - F.col(f"{control}_{other}")).alias("leak")))
    tall = wide.select("seed_set", F.inline(F.array(*cells)))
    out = tall.groupBy("seed_set", "label").agg(
        F.count(F.lit(1)).alias("units"), F.avg("effect").alias("mean_effect"), F.stddev_samp("effect").alias("sd_effect"),
        F.count_if(F.col("effect") < 0).alias("negative"), F.avg("untaught").alias("mean_untaught"),
        F.stddev_samp("untaught").alias("sd_untaught"), F.avg("leak").alias("leak"))
    size, base = F.abs("mean_effect"), F.abs("mean_untaught")
    return out.select("*", ((F.col("mean_effect") < 0) & (size >= effect_ratio * base)).alias("teaching_passed"),
                      (base <= guard_ratio * F.coalesce("sd_untaught", F.lit(0.0))).alias("guard_passed"),
                      (F.abs("leak") <= leak_ratio * size).alias("leak_passed"))


def drift_limit(rows: DataFrame, by: list[str], order: str, value: str, bounds: tuple[float, float],
                ratio: float = 4.0) -> DataFrame:
    """Final value of a trajectory against a limit, and observations at or beyond the bounds."""
    low, high = bounds
    out = rows.groupBy(*by).agg(
        F.max_by(value, order).alias("final"), F.avg(value).alias("mean"),
        F.count_if((F.col(value) <= low) | (F.col(value) >= high)).alias("bound_hits"))
    return out.select("*", (F.abs("final") <= ratio * F.abs("mean")).alias("passed"))


def occupancy(rows: DataFrame, by: list[str], value: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """(share of values at the bounds per group, exact deciles per group)."""
    shares = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(value) <= low).cast("double")).alias("at_low"),
        F.avg((F.col(value) >= high).cast("double")).alias("at_high"))
    return shares, exact_quantiles(rows, by, value, [i / 10 for i in range(11)])


def contrasts(rows: DataFrame) -> DataFrame:
    """Per (arm, seed): change of the first cue minus change of the second, relative to the unit probes.

    Rows: arm, seed, cue (0/1), stage ('unit' or 'end'), value.
    """
    def mean(cue: int, stage: str) -> Column:
        return F.avg(F.when((F.col("cue") == cue) & (F.col("stage") == stage), F.col("value")))

    return rows.groupBy("arm", "seed").agg(
        ((mean(0, "end") - mean(0, "unit")) - (mean(1, "end") - mean(1, "unit"))).alias("contrast"),
        (mean(0, "end") - mean(0, "unit")).alias("target_change"))


def contrast_criteria(rows: DataFrame, null_arms: list[str], ratio: float = 3.0) -> DataFrame:
    """Arm means against the null scale (largest absolute null-arm mean): sign, size and mirror criteria."""
    arms = contrasts(rows).groupBy("arm").agg(
        F.avg("contrast").alias("mean"), F.bool_and(F.col("contrast") < 0).alias("all_negative"),
        F.bool_and(F.col("contrast") > 0).alias("all_positive"),
        F.bool_and(F.col("target_change") < 0).alias("target_depressed"))
    scale = arms.where(F.col("arm").isin(null_arms)).agg(F.max(F.abs("mean"))).scalar()
    large = F.abs("mean") >= ratio * F.col("null_scale")
    return arms.withColumn("null_scale", scale).select(
        "*", (F.col("all_negative") & large).alias("acquired"), (F.col("all_positive") & large).alias("mirrored"))


def pairwise_jaccard(members: DataFrame, set_name: str, member: str) -> DataFrame:
    """Overlap of every pair of declared sets; rows without a set or a member are left out.

    Members become bits of 4 KB bitmaps per (set, bucket of 32,768 members), built in the map tasks, so members are not
    shuffled and no row holds a set. Whole-number members are their own bit positions and should be dense; others get
    dense numbers first. Bitmaps meet by bucket, and the overlap is both sizes less the size of the union.
    """
    rows = members.select(F.col(set_name).alias("name"), F.col(member).alias("member")).where(
        "name is not null and member is not null")
    if dict(rows.dtypes)["member"] not in ("tinyint", "smallint", "int", "bigint"):
        numbers = ranked(rows.select("member").distinct(), [], [F.col("member")], rank="number")
        rows = rows.join(numbers, "member").select("name", F.col("number").alias("member"))
    place = F.col("member").cast("long")
    bits = rows.groupBy("name", F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).withColumn("size", F.bitmap_count("bits"))
    bits = stable(bits)
    sizes = bits.groupBy("name").agg(F.sum("size").alias("size"))
    left, right = (bits.select("bucket", F.col("name").alias(n), F.struct("bits", "size").alias(f"in_{n}")) for n in ("a", "b"))
    met = left.join(right, "bucket").where("a < b").select(
        "bucket", "a", "b", (F.col("in_a.size") + F.col("in_b.size")).alias("both"),
        F.explode(F.array("in_a.bits", "in_b.bits")).alias("bits"))
    unions = met.groupBy("a", "b", "bucket").agg((F.first("both") - F.bitmap_count(F.bitmap_or_agg("bits"))).alias("shared"))
    pairs = unions.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    names = sizes.agg(F.array_sort(F.collect_list("name"))).scalar()
    every = sizes.select(F.col("name").alias("a"), F.col("size").alias("size_a"), names.alias("names")).select(
        "a", "size_a", F.explode(F.filter("names", lambda x: x > F.col("a"))).alias("b"))
    rows = every.join(sizes.select(F.col("name").alias("b"), F.col("size").alias("size_b")), "b").join(
        pairs, ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    union = F.col("size_a") + F.col("size_b") - shared
    return rows.select("a", "b", shared.alias("shared"), (shared / F.greatest(union, F.lit(1))).alias("jaccard"))


def preference(rows: DataFrame, item: str) -> DataFrame:
    """Sign of the mean difference between the two cues per item."""
    mean = [F.avg(F.when(F.col("cue") == c, F.col("value"))) for c in (0, 1)]
    return rows.groupBy(item).agg(F.coalesce(F.signum(mean[0] - mean[1]), F.lit(0.0)).cast("int").alias("preference"))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank (ties share) over a bounded table."""
    order = Window.partitionBy().orderBy(column)
    ties = Window.partitionBy(column)
    return df.withColumn(out, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def key_profile(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Mean profile per key and the rank correlation of the mean log1p response with the key.

    Keys are buckets of a bounded code, so the ranking runs over the profile table, never over rows.
    """
    means = rows.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])
    level = reduce(lambda a, b: a + b, [F.log1p(v) for v in values]) / len(values)
    ranks = average_rank(average_rank(means.withColumn("level", level), "level", "r_level"), key, "r_key")
    return means.withColumn("spearman", ranks.agg(F.corr("r_level", "r_key")).scalar())


def condition_gates(rows: DataFrame, value: str, gates: dict[str, Column]) -> DataFrame:
    """Per condition: range of a value and whether every / any row passes each gate."""
    return rows.groupBy("condition").agg(
        F.min(value).alias("low"), F.max(value).alias("high"),
        *[F.bool_and(g).alias(f"all_{n}") for n, g in gates.items()],
        *[F.bool_or(g).alias(f"any_{n}") for n, g in gates.items()])


def entity_events(rows: DataFrame, entity: str, trial: str, order: str, onset: Column) -> DataFrame:
    """Event counts and mass by phase per entity, with the range of its end states over trials."""
    per_trial = rows.groupBy(entity, trial).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(onset).alias("pre"), F.sum("value").alias("mass"),
        F.sum(F.when(~onset, F.col("value")).otherwise(0.0)).alias("admitted_mass"), F.min("value").alias("least"),
        F.max("value").alias("most"), F.max_by("value", order).alias("end"))
    return per_trial.groupBy(entity).agg(
        F.sum("events").alias("events"), F.sum("pre").alias("pre_onset_events"),
        (F.sum("events") - F.sum("pre")).alias("admitted_events"), F.sum("mass").alias("mass"),
        F.sum("admitted_mass").alias("admitted_mass"), F.min("least").alias("minimum"), F.max("most").alias("maximum"),
        F.min("end").alias("end_min"), F.max("end").alias("end_max"))


def mass_share(rows: DataFrame, group: str, entity: str, top: int = 10) -> DataFrame:
    """Net mass per entity reduced to signs, totals and the share of the ``top`` most negative entities."""
    net = rows.groupBy(group, entity).agg(F.sum("value").alias("net"))
    lost = -F.least(F.col("net"), F.lit(0.0))
    totals = net.groupBy(group).agg(
        F.sum(lost).alias("negative_mass"), F.sum(F.greatest(F.col("net"), F.lit(0.0))).alias("positive_mass"),
        F.count_if(F.col("net") < 0).alias("negative"), F.count_if(F.col("net") > 0).alias("positive"))
    head = first_rows(net, [group], [F.col("net"), F.col(entity)], top, entity)
    worst = head.groupBy(group).agg(F.sum(lost).alias("top_mass"))
    return totals.join(worst, group).select(
        group, "negative_mass", "positive_mass", "negative", "positive",
        F.coalesce(F.try_divide("top_mass", "negative_mass"), F.lit(0.0)).alias("top_share"))


def bin_attribution(rows: DataFrame, trial: list[str], by: list[str]) -> DataFrame:
    """Mean and sample deviation over trials of the per-trial bin sums."""
    sums = rows.groupBy(*trial, *by).agg(F.sum("value").alias("value"))
    return sums.groupBy(*by).agg(F.count(F.lit(1)).alias("trials"), F.avg("value").alias("mean"),
                                 F.stddev_samp("value").alias("sd"))


def lag_corr(series: DataFrame, by: list[str], lags: range) -> DataFrame:
    """Pearson correlation of x(bin) with y(bin + lag) on each overlap; zero when degenerate.

    ``series`` is already one row per (group, bin).
    """
    moved = series.select(*by, F.col("x"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "bin")
    moved = moved.withColumn("bin", F.col("bin") + F.col("lag"))
    pairs = moved.join(series.select(*by, "bin", "y"), [*by, "bin"])
    flat = (F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))
    corr = F.when(flat, 0.0).otherwise(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)))
    return pairs.groupBy(*by, "lag").agg(F.count(F.lit(1)).alias("overlap"), corr.alias("correlation"))


def baseline_delta(rows: DataFrame, unit: str, label: str, value: str) -> DataFrame:
    """Per label: summed and absolute change of every unit against its first label."""
    cells = rows.groupBy(unit, label).agg(F.sum(value).alias("value"))
    first = cells.groupBy(unit).agg(F.min_by("value", label).alias("base"))
    change = F.col("value") - F.col("base")
    return cells.join(first, unit).groupBy(label).agg(
        F.count(F.lit(1)).alias("units"), F.sum(change).alias("change"), F.sum(F.abs(change)).alias("absolute_change"))


def window_means(rows: DataFrame, by: list[str], time: str, value: str,
                 windows: list[tuple[str, float, float, bool]]) -> DataFrame:
    """Mean of a value in declared windows (open or closed end), first and last sample, completeness.

    Rows fan out over the literal window list in place; the extent of each series decides completeness.
    """
    spec = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"),
                              F.lit(c).alias("closed")) for n, a, b, c in windows])
    t = F.col(time)
    spread = rows.select(*by, t.alias("_t"), F.col(value).alias("_v"), F.inline(spec))
    inside = (F.col("_t") >= F.col("lo")) & F.when(F.col("closed"), F.col("_t") <= F.col("hi")).otherwise(
        F.col("_t") < F.col("hi"))
    return spread.groupBy(*by, "window").agg(
        F.count_if(inside).alias("samples"), F.avg(F.when(inside, F.col("_v"))).alias("mean"),
        F.min(F.when(inside, F.col("_t"))).alias("first"), F.max(F.when(inside, F.col("_t"))).alias("last"),
        ((F.min("_t") <= F.max("lo")) & (F.max("_t") >= F.max("hi"))).alias("complete"))


def normalise_across(cells: DataFrame, preparation: list[str], condition: str, value: str) -> DataFrame:
    """Min-max normalise over conditions inside each preparation, then mean and standard error per condition."""
    span = cells.groupBy(*preparation).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = cells.join(span, preparation).withColumn(
        "_z", F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    n = F.count("_z")
    return scaled.groupBy(condition).agg(
        F.avg("_z").alias("mean"), F.when(n > 1, F.stddev_samp("_z") / F.sqrt(n)).alias("sem"))


# --- feature matrices -----------------------------------------------------------------------------------------

def tall(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    return vectors.select(*keep, F.posexplode(vector).alias("channel", "x"))


def channel_stats(vectors: DataFrame, vector: str, width: int) -> DataFrame:
    """One row with per-channel mean and population deviation arrays, from one pass without exploding."""
    parts = [f(F.col(vector)[i].cast("double")) for f in (F.avg, F.stddev_pop) for i in range(width)]
    return vectors.agg(F.array(*parts[:width]).alias("mean"), F.array(*parts[width:]).alias("std"))


def scale_vectors(vectors: DataFrame, train: Column, vector: str, width: int) -> DataFrame:
    """Standardise with training statistics (deviation floored at 0.01) and clip to +-8, vector by vector."""
    stats = channel_stats(vectors.where(train), vector, width)
    rows = vectors.select("*", stats.select("mean").scalar().alias("_m"), stats.select("std").scalar().alias("_s"))
    zipped = F.arrays_zip(F.col(vector).alias("x"), F.col("_m").alias("m"), F.col("_s").alias("s"))
    raw = F.transform(zipped, lambda z: (z["x"].cast("double") - z["m"]) / F.greatest(z["s"], F.lit(0.01)))
    scaled = F.transform(zipped, lambda z: clip_scale(z["x"].cast("double"), z["m"], z["s"]))
    return rows.select(*[c for c in vectors.columns], raw.alias("unbounded"), scaled.alias("scaled"))


def scale_diagnostics(scaled: DataFrame, by: list[str], vector: str, width: int, bound: float = 8.0) -> DataFrame:
    """Constant and below-floor channels, clipped share, rows with any clip and the largest value before clipping."""
    size = F.aggregate("unbounded", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    clipped = F.size(F.filter("unbounded", lambda x: F.abs(x) > bound))
    channel = [F.col(vector)[i].cast("double") for i in range(width)]
    constant = reduce(lambda a, b: a + b, [(F.max(c) == F.min(c)).cast("int") for c in channel])
    floor = reduce(lambda a, b: a + b, [(F.stddev_pop(c) < 0.01).cast("int") for c in channel])
    return scaled.withColumns({"_top": size, "_clipped": clipped}).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), constant.alias("constant_channels"), floor.alias("below_floor"),
        (F.sum("_clipped") / (F.count(F.lit(1)) * width)).alias("clipped_share"),
        F.avg((F.col("_clipped") > 0).cast("double")).alias("rows_clipped_share"), F.max("_top").alias("largest"))


def window_pool(vectors: DataFrame, by: list[str], vector: str, windows: int, channels: int) -> DataFrame:
    """Group means per channel: over all windows, and per window as columns. Vectors are window-major."""
    cells = tall(vectors, by, vector).select(
        *by, F.floor(F.col("channel") / channels).alias("window"), (F.col("channel") % channels).alias("channel"),
        F.col("x").cast("double").alias("x"))
    return cells.groupBy(*by, "channel").agg(
        F.avg("x").alias("whole"),
        *[F.avg(F.when(F.col("window") == w, F.col("x"))).alias(f"w{w}") for w in range(windows)])
