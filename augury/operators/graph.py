"""Weighted directed graph tables: import with loss accounting, summaries, role subgraphs, propagation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_sign
from ..plans.hubs import CELL_PAIRS, hub_join
from ..plans.ordered import ranked


def with_ends(edges: DataFrame, nodes: DataFrame, source: list[Column], target: list[Column]) -> DataFrame:
    """Inner join of both end points with chosen node columns."""
    left = nodes.select(F.col("id").alias("pre"), *source)
    right = nodes.select(F.col("id").alias("post"), *target)
    return edges.join(left, "pre").join(right, "post")


def import_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One-row accounting of what an import keeps and drops; kept + excluded equals the source by construction."""
    ids = nodes.select("id")
    known = edges.join(ids.select(F.col("id").alias("pre"), F.lit(True).alias("in_pre")), "pre", "left").join(
        ids.select(F.col("id").alias("post"), F.lit(True).alias("in_post")), "post", "left")
    kept = F.col("in_pre").isNotNull() & F.col("in_post").isNotNull()
    sign, uncertain = token_sign(F.col("transmitter"))
    facts = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(uncertain).alias("uncertain_nodes"),
                      F.count_if(sign < 0).alias("negative_nodes"))
    out = known.select("contacts", kept.alias("kept"), (F.col("pre") == F.col("post")).alias("own")).agg(
        F.count(F.lit(1)).alias("source_edges"), F.sum("contacts").alias("source_contacts"),
        F.count_if("kept").alias("edges"), F.sum(F.when(F.col("kept"), F.col("contacts"))).alias("contacts"),
        F.count_if(~F.col("kept")).alias("excluded_edges"),
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col("contacts"))), F.lit(0)).alias("excluded_contacts"),
        F.count_if(F.col("kept") & (F.col("contacts") == 1)).alias("weak_edges"),
        F.count_if(F.col("kept") & F.col("own")).alias("self_edges"))
    return out.select("*", *[facts.select(c).scalar().alias(c) for c in facts.columns])


def import_gates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counts that must be 0 before an import may claim to keep every edge: directed pairs given more than
    once (and their surplus rows), contact counts that are no whole number of 1 to 2**32 - 1, node ids that are given
    more than once, are missing or negative."""
    pairs = edges.groupBy("pre", "post").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(
        (F.col("contacts") == F.floor("contacts")) & F.col("contacts").between(1, 2 ** 32 - 1), F.lit(False))).alias("bad"))
    ids = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    edge_facts = pairs.agg(F.count_if(F.col("n") > 1).alias("repeated_pairs"),
                           F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_edges"),
                           F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_contacts"))
    node_facts = ids.agg(F.count_if(F.col("n") > 1).alias("repeated_ids"),
                         F.coalesce(F.sum(F.when(F.coalesce(F.col("id") < 0, F.lit(True)), F.col("n"))), F.lit(0)).alias("bad_ids"))
    return edge_facts.select("*", *[node_facts.select(c).scalar().alias(c) for c in node_facts.columns])


def retained(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are retained, with the sign of the source."""
    sign, _ = token_sign(F.col("transmitter"))
    return with_ends(edges, nodes, [sign.alias("sign")], [])


def annotation_align(nodes: DataFrame, raw: DataFrame, columns: list[str]) -> DataFrame:
    """Mismatch counts of retained against raw annotations; missing and repeated raw rows count too."""
    right = raw.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(f"raw_{c}") for c in columns])
    both = nodes.select("id", *columns).join(right, "id", "left")
    blank = F.lit("")
    checks = {"missing": F.col("copies").isNull(), "repeated": F.coalesce(F.col("copies") > 1, F.lit(False))}
    checks |= {c: F.col("copies").isNotNull() & (F.coalesce(c, blank) != F.coalesce(f"raw_{c}", blank)) for c in columns}
    totals = both.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("rows")) for k in checks])))


def reconcile(listed: DataFrame, nodes: DataFrame, required_class: dict[str, str]) -> DataFrame:
    """Match an external list (text id, kind) to nodes exactly; every row gets a state."""
    number = F.when(F.col("id_text").rlike("^[0-9]{1,18}$"), F.col("id_text").cast("long"))
    rows = listed.withColumn("id", number)
    copies = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    native = nodes.select("id", F.col("type").alias("native_type"), F.col("class").alias("native_class"))
    wanted = F.lit(None).cast("string")
    for kind, needed in required_class.items():
        wanted = F.when(F.col("kind") == kind, needed).otherwise(wanted)
    state = (F.when(F.col("id").isNull(), "invalid_id").when(F.col("copies") > 1, "duplicate")
             .when(F.col("native_type").isNull(), "unmatched").when(F.col("native_type") != F.col("kind"), "type_mismatch")
             .when(wanted.isNotNull() & (F.col("native_class") != wanted), "class_mismatch").otherwise("matched"))
    return rows.join(copies, "id", "left").join(native, "id", "left").select("id_text", "kind", state.alias("state"))


def role_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, label: str) -> DataFrame:
    """Edges from a source set to labelled targets; both sets are distinct id tables."""
    return (edges.join(sources.select(F.col("id").alias("pre")), "pre", "left_semi")
            .join(targets.select(F.col("id").alias("post"), label), "post"))


def node_totals(edges: DataFrame) -> DataFrame:
    """In/out degree, contacts and signed weight of every node, from one shuffle of two half rows per edge."""
    signed = F.col("contacts") * F.col("sign")
    half = edges.select(F.inline(F.array(
        F.struct(F.col("pre").alias("id"), F.lit(True).alias("out"), "contacts", signed.alias("signed")),
        F.struct(F.col("post").alias("id"), F.lit(False).alias("out"), "contacts", signed.alias("signed")))))

    def total(side: Column, value: Column) -> Column:
        return F.sum(F.when(side, value).otherwise(0))

    out, one = F.col("out"), F.lit(1)
    return half.groupBy("id").agg(
        total(~out, one).alias("in_degree"), total(out, one).alias("out_degree"),
        total(~out, F.col("contacts")).alias("in_contacts"), total(out, F.col("contacts")).alias("out_contacts"),
        total(~out, F.col("signed")).alias("in_signed"), total(out, F.col("signed")).alias("out_signed"))


def type_summary(edges: DataFrame, channels: list[str], eligible: Column) -> DataFrame:
    """Per source type: edges, contacts and eligible edges in every channel, as columns."""
    sums = []
    for name in channels:
        mine = F.col("channel") == name
        sums += [F.count_if(mine).alias(f"{name}_edges"),
                 F.sum(F.when(mine, F.col("contacts")).otherwise(0)).alias(f"{name}_contacts"),
                 F.count_if(mine & eligible).alias(f"{name}_eligible")]
    return edges.groupBy("type").agg(*sums)


def target_summary(edges: DataFrame, subset: Column) -> DataFrame:
    """Incoming totals per target node and per target type (id is null for the type row)."""
    return edges.groupingSets([["type"], ["type", "post"]], "type", "post").agg(
        F.count(F.lit(1)).alias("incoming_edges"), F.sum("contacts").alias("incoming_contacts"),
        F.count_if(subset).alias("subset_edges"),
        F.sum(F.when(subset, F.col("contacts")).otherwise(0)).alias("subset_contacts"))


def input_breakdown(inputs: DataFrame, grains: list[list[str]]) -> DataFrame:
    """Several group-bys in one pass; nulls in a column stay a group of their own."""
    names = list(dict.fromkeys(c for g in grains for c in g))
    return inputs.groupingSets(grains, *names).agg(
        F.grouping_id(*names).alias("grain"), F.count(F.lit(1)).alias("edges"), F.sum("contacts").alias("contacts"),
        F.sum(F.col("contacts") * F.col("sign")).alias("signed"))


def contact_scope(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Per channel: targets reached by any source, by all sources, by none. Edges are unique pairs."""
    per_target = edges.join(sources.select(F.col("id").alias("pre"), "channel"), "pre").join(
        targets.select(F.col("id").alias("post")), "post", "left_semi").groupBy("channel", "post").agg(
        F.count(F.lit(1)).alias("reached_by"), F.sum("contacts").alias("contacts"))
    n_sources = sources.groupBy("channel").agg(F.count(F.lit(1)).alias("sources"))
    n_targets = targets.agg(F.count(F.lit(1))).scalar()
    rows = n_sources.join(per_target, "channel", "left")
    return rows.groupBy("channel", "sources").agg(
        F.count("post").alias("by_any"), F.count_if(F.col("reached_by") == F.col("sources")).alias("by_all"),
        F.coalesce(F.sum("contacts"), F.lit(0)).alias("contacts")).withColumn("by_none", n_targets - F.col("by_any"))


def row_normalize(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Share of each source in a target's incoming contacts among members, without self edges."""
    ids = members.select("id")
    inside = (edges.where("pre <> post").join(ids.withColumnRenamed("id", "pre"), "pre", "left_semi")
              .join(ids.withColumnRenamed("id", "post"), "post", "left_semi")
              .groupBy("post", "pre").agg(F.sum("contacts").alias("contacts")))
    totals = inside.groupBy("post").agg(F.sum("contacts").alias("total"))
    return inside.join(totals, "post").select("post", "pre", (F.col("contacts") / F.col("total")).alias("share"))


def row_normalize_audit(edges: DataFrame, members: DataFrame) -> DataFrame:
    """How many pairs, self pairs and empty target rows the normalisation had."""
    ids = members.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "pre"), "pre", "left_semi").join(
        ids.withColumnRenamed("id", "post"), "post", "left_semi")
    own = F.col("pre") == F.col("post")
    facts = inside.agg(F.count_if(~own).alias("pairs"), F.count_if(own).alias("self_pairs"),
                       F.count_distinct(F.when(~own, F.col("post"))).alias("filled"))
    return facts.select("pairs", "self_pairs", (ids.agg(F.count(F.lit(1))).scalar() - F.col("filled")).alias("empty_rows"))


def pair_groups(edges: DataFrame, by: list[str]) -> DataFrame:
    """Dense ids (from 0) of the distinct type pairs in sorted order, with their sizes."""
    sizes = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edges"))
    return ranked(sizes, [], [F.col(c) for c in by], "_r").select(*by, (F.col("_r") - 1).alias("group_id"), "edges")


STRATUM = ["contacts", "sign", "source_role", "target_role"]


def with_strata(edges: DataFrame, nodes: DataFrame, source_classes: list[str], target_classes: list[str]) -> DataFrame:
    """Edges with their randomisation stratum: contacts, source sign and the roles of both ends."""
    sign, _ = token_sign(F.col("transmitter"))
    source = F.when(F.col("class").isin(source_classes), F.col("type")).otherwise("non-source")
    target = F.when(F.col("class").isin(target_classes), F.col("type")).otherwise("non-target")
    return with_ends(edges, nodes, [sign.alias("sign"), source.alias("source_role")], [target.alias("target_role")])


def edge_scale(edges: DataFrame, factor: Column, silence: Column, negative: Column) -> DataFrame:
    """Class-wide scaling, silencing and forced-negative variants of the signed weight."""
    weight = F.col("contacts") * F.col("sign") * factor
    scaled = F.when(silence, 0.0).when(negative, -F.abs(weight)).otherwise(weight)
    return edges.select("pre", "post", scaled.cast("double").alias("weight"))


def top_inputs(edges: DataFrame, k: int) -> DataFrame:
    """The k strongest inputs of every target; each map task already keeps only k rows per target."""
    order = Window.partitionBy("post").orderBy(F.desc("contacts"), "pre")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def strong_edges(edges: DataFrame, sample: DataFrame, minimum: int, k: int) -> DataFrame:
    ids = sample.select("id")
    inside = (edges.where(F.col("contacts") >= minimum).join(ids.withColumnRenamed("id", "pre"), "pre", "left_semi")
              .join(ids.withColumnRenamed("id", "post"), "post", "left_semi"))
    return inside.orderBy(F.desc("contacts"), F.desc("pre"), F.desc("post")).limit(k)


def even_sample(rows: DataFrame, group: list[str], order: list[Column], size: Column) -> DataFrame:
    """Rows at evenly spaced positions floor(i * (n - 1) / (k - 1)) of each ordered group; all rows when n <= k."""
    placed = ranked(rows, group, order, "_pos").withColumn("_pos", F.col("_pos") - 1)
    if group:
        counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        placed = placed.join(counts, group)
    else:
        placed = placed.withColumn("_n", rows.agg(F.count(F.lit(1))).scalar())
    placed = placed.withColumn("_k", F.least(size, F.col("_n")))
    step, span = F.expr("_k - 1"), F.expr("_n - 1")
    index = F.when(span > 0, F.ceil(F.col("_pos") * step / span)).otherwise(0)
    hit = F.when(F.col("_k") == 1, F.col("_pos") == 0).when(span == 0, True).otherwise(
        F.floor(index * span / step) == F.col("_pos"))
    return placed.where((F.col("_k") >= 1) & hit).drop("_pos", "_n", "_k")


def graph_sample(nodes: DataFrame, category: Column, per_category: int, size: int) -> DataFrame:
    """Category-covering node sample: evenly spaced rows of every named category, then of all remaining nodes."""
    rows = nodes.withColumn("category", category)
    named = rows.where("category <> 'other'")
    covered = even_sample(named, ["category"], [F.col("id")], F.lit(min(per_category, size // 4)))
    rest = rows.join(covered.select("id"), "id", "left_anti")
    room = F.greatest(F.lit(size) - covered.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    return covered.unionByName(even_sample(rest, [], [F.col("id")], room))


def normalised(points: DataFrame, axes: list[str]) -> DataFrame:
    """Centre coordinates on their bounding box and divide by half of the longest side (at least 1)."""
    box = points.agg(*[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes])
    half = F.greatest(*[(F.col(f"hi_{a}") - F.col(f"lo_{a}")) / 2 for a in axes], F.lit(1.0))
    facts = box.select(half.alias("half"), *[((F.col(f"hi_{a}") + F.col(f"lo_{a}")) / 2).alias(f"mid_{a}") for a in axes])
    return points.withColumns({a: (F.col(a) - facts.select(f"mid_{a}").scalar()) / facts.select("half").scalar()
                               for a in axes})


def pathway_support(edges: DataFrame) -> DataFrame:
    """Pairs, contacts and distinct connected sources per route."""
    return edges.groupBy("source_type", "target_type").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("contacts").alias("contacts"),
        F.count_distinct("pre").alias("sources"))


def node_atlas(nodes: DataFrame, roles: list[tuple[str, Column]], support: DataFrame, channels: list[str]) -> DataFrame:
    """Nodes with any role: roles joined by ';' in declared order and support edges per channel."""
    held = F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in roles])
    counts = support.groupBy(F.col("pre").alias("id")).agg(
        *[F.count_if(F.col("channel") == c).alias(f"{c}_edges") for c in channels])
    rows = nodes.withColumn("roles", held).where("roles <> ''").join(counts, "id", "left")
    return rows.select("id", "roles", *[F.coalesce(f"{c}_edges", F.lit(0)).alias(f"{c}_edges") for c in channels])


def edge_arrivals(emissions: DataFrame, edges: DataFrame, phases: list[tuple[str, int, int]], horizon: int, delay: int = 9,
                  refractory: int = 11, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Every emission crosses every outgoing edge and lands ``delay`` steps later.

    It is accepted when no event of the target lies less than ``refractory`` steps before it, and pending beyond the
    horizon. The steps of a (trial, node) travel as one list, bounded by the horizon: a list crosses an edge as one row and
    meets the target's own list in an equi-join, so neither the arrivals nor the events are sorted or added up one by one.
    A hub's emissions and edges meet in a grid of cells. Result: totals per (trial, phase, family, status).
    """
    steps = emissions.groupBy("trial", "node").agg(F.collect_list(F.struct("step")).alias("steps"))
    crossed = hub_join(steps.withColumnRenamed("node", "pre"), edges.select("pre", "post", "contacts", "family"), "pre",
                       ["trial"], ["post"], cell_pairs)
    own = emissions.groupBy(F.col("trial").alias("_trial"), F.col("node").alias("_node")).agg(
        F.collect_set("step").alias("_own"))
    met = crossed.join(own, F.col("trial").eqNullSafe(F.col("_trial")) & F.col("post").eqNullSafe(F.col("_node")), "left")
    due = F.col("due")
    seen = met.select("trial", "family", "contacts", "_own", F.explode("steps").alias("_s")).withColumn(
        "due", F.col("_s.step") + delay)
    refused = F.coalesce(F.exists("_own", lambda x: (x < due) & (x > due - refractory)), F.lit(False))
    here = F.coalesce(F.array_contains("_own", due), F.lit(False))
    status = (F.when(due >= horizon, "pending").when(refused, "rejected").when(here, "same_step").otherwise("accepted"))
    phase = reduce(lambda acc, p: F.when((due >= p[1]) & (due < p[2]), p[0]).otherwise(acc),
                   reversed(phases), F.lit("beyond"))
    return seen.groupBy("trial", phase.alias("phase"), "family", status.alias("status")).agg(
        F.count(F.lit(1)).alias("edge_events"), F.sum("contacts").alias("contact_events"))


def mean_over_trials(totals: DataFrame, by: list[str], value: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Mean and spread of ``value`` over the trials, with sums ``{output: input column}`` in the same pass."""
    return totals.groupBy(*by).agg(F.count(F.lit(1)).alias("trials"), F.avg(value).alias("mean"),
                                   F.stddev_samp(value).alias("sd"),
                                   *[F.sum(source).alias(name) for name, source in (sums or {}).items()])
