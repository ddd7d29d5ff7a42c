"""Degree-preserving randomisation of a directed weighted graph.

One sweep pairs edges at random inside every stratum and swaps the two destinations. A swap is refused when it makes
a self edge, repeats an existing edge, or proposes an edge that any other pair also proposes. A stratum may hold most
of the graph, so the random order is ranked in hash buckets, and acceptance is decided per proposed edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import hash_ranked
from ..plans.session import saved
from .graph import STRATUM, node_totals


def start(edges: DataFrame) -> DataFrame:
    """Give every edge its origin; self edges never move."""
    return edges.withColumns({"origin": F.col("post"), "fixed": F.col("pre") == F.col("post")})


def _digest(seed: int, sweep: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(sweep)), F.col("pre").cast("string"),
                             F.col("origin").cast("string")))


def _pairs(state: DataFrame, seed: int, number: int) -> DataFrame:
    """Pairs (a, b) of free edges that follow each other in the random order of their stratum; b is null for an edge left over."""
    free = state.where("NOT fixed").withColumn("_h", _digest(seed, number))
    me = F.struct("pre", "post", "origin")
    # repeated edges share a digest: the destination settles their order, so that a sweep has one result
    order = hash_ranked(free, STRATUM, "_h", ["pre", "origin", "post"], "_rank", following=me, packed=True)
    odd = F.col("_rank") % 2 == 1
    # An edge of odd rank has its partner next to it, unless a slice ends between the two.
    held = saved(order.where(odd | F.col("_opens")).select(
        *STRATUM, F.floor((F.col("_rank") - 1) / 2).alias("_place"), odd.alias("_odd"), me.alias("a"),
        F.when(odd, F.col("_next")).alias("b"), F.monotonically_increasing_id().alias("_pair")), "pairs")
    beside = held.where("_odd AND b IS NOT NULL").select(*STRATUM, "_pair", "a", "b")
    parted = held.where("NOT (_odd AND b IS NOT NULL)").groupBy(*STRATUM, "_place").agg(
        F.max("_pair").alias("_pair"), F.max(F.when(F.col("_odd"), F.col("a"))).alias("a"),
        F.max(F.when(~F.col("_odd"), F.col("a"))).alias("b"))
    return beside.unionByName(parted.drop("_place"))


def sweep(state: DataFrame, seed: int, number: int) -> DataFrame:
    """One sweep over ``state`` (pre, post, origin, fixed, stratum columns); adds whether an edge moved.

    The state is read several times: give one that is saved."""
    pairs = _pairs(state, seed, number)
    possible = ((F.col("a.pre") != F.col("b.post")) & (F.col("b.pre") != F.col("a.post"))
                & (F.col("a.pre") != F.col("b.pre")) & (F.col("a.post") != F.col("b.post")))
    proposals = pairs.where("b IS NOT NULL").select("_pair", F.inline(F.array(*[
        F.struct(F.col(f"{x}.pre").alias("pre"), F.col(f"{y}.post").alias("new")) for x, y in (("a", "b"), ("b", "a"))])))
    # A proposed edge is free when nobody else proposes it and it does not exist now; a swap needs both of its edges free.
    claims = proposals.select("pre", "new", "_pair", F.lit(1).alias("c")).unionByName(
        state.select("pre", F.col("post").alias("new"), F.lit(None).cast("long").alias("_pair"), F.lit(2).alias("c")))
    free_edges = claims.groupBy("pre", "new").agg(F.sum("c").alias("c"), F.max("_pair").alias("_pair")).where(
        "c = 1 AND pre IS NOT NULL AND new IS NOT NULL")
    free_pairs = free_edges.groupBy("_pair").agg(F.count(F.lit(1)).alias("_free")).where("_free = 2")
    moved = F.coalesce(possible & F.col("_free").isNotNull(), F.lit(False))
    judged = pairs.join(free_pairs, "_pair", "left").withColumn("moved", moved)

    def member(x: str, y: str):
        return F.struct(F.col(f"{x}.pre").alias("pre"), F.when(F.col("moved"), F.col(f"{y}.post")).otherwise(
            F.col(f"{x}.post")).alias("post"), F.col(f"{x}.origin").alias("origin"))

    both = F.when(F.col("b").isNull(), F.array(member("a", "a"))).otherwise(F.array(member("a", "b"), member("b", "a")))
    swapped = judged.select(*STRATUM, "moved", F.inline(both)).withColumn("fixed", F.lit(False))
    kept = state.where("fixed").select(*STRATUM, F.lit(False).alias("moved"), "pre", "post", "origin", "fixed")
    return swapped.unionByName(kept)


def rewire(edges: DataFrame, seed: int, sweeps: int) -> DataFrame:
    """``sweeps`` sweeps; lineage is cut after each one, so a lost executor never replays earlier sweeps."""
    state = saved(start(edges), "edges")
    for number in range(sweeps):
        state = saved(sweep(state, seed, number).drop("moved"), "edges")
    return state


def rewire_report(edges: DataFrame, seed: int, sweeps: int) -> DataFrame:
    """(sweep, proposed, accepted): swaps that every sweep tries, two free edges of a stratum each, and those it makes."""
    state = saved(start(edges), "edges")
    sizes = state.where("NOT fixed").groupBy(*STRATUM).agg(F.floor(F.count(F.lit(1)) / 2).alias("pairs"))
    parts = []
    for number in range(sweeps):
        after = saved(sweep(state, seed, number), "edges")
        made = after.agg(F.floor(F.count_if("moved") / 2).cast("long").alias("accepted"))
        parts.append(made.select(F.lit(number).alias("sweep"), F.coalesce(
            sizes.agg(F.sum("pairs")).scalar(), F.lit(0)).cast("long").alias("proposed"), "accepted"))
        state = after.drop("moved")
    return reduce(DataFrame.unionByName, parts)


def change_report(state: DataFrame) -> DataFrame:
    """Changed destinations per stratum (and overall: null stratum)."""
    changed = F.col("post") != F.col("origin")
    return state.groupingSets([[], STRATUM], *STRATUM).agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(changed).alias("changed"), F.count_if("fixed").alias("self_edges"))


def invariants(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that must all be zero: differing node totals, repeated edges, new self edges, changed stratum sizes."""
    totals = ["in_degree", "out_degree", "in_contacts", "out_contacts", "in_signed", "out_signed"]
    old, new = node_totals(before), node_totals(after)
    both = old.join(new.select("id", *[F.col(c).alias(f"n_{c}") for c in totals]), "id", "full_outer")
    facts = both.agg(F.count(F.lit(1)).alias("nodes"), *[
        F.count_if(~F.col(c).eqNullSafe(F.col(f"n_{c}"))).alias(c) for c in totals])
    repeated = after.groupBy("pre", "post").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)))
    selves = [df.where("pre = post").agg(F.count(F.lit(1))).scalar() for df in (before, after)]
    sizes = before.groupBy(*STRATUM).count().exceptAll(after.groupBy(*STRATUM).count()).agg(F.count(F.lit(1)))
    return facts.select("*", repeated.scalar().alias("repeated_edges"), (selves[1] - selves[0]).alias("new_self_edges"),
                        sizes.scalar().alias("changed_strata"))
