"""Digest trees, hub joins and bitmap overlaps against brute force."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from augury.operators import idtree, panel
from augury.plans.hubs import hub_join


def brute_tree(ids, depth):
    sha = lambda parts: hashlib.sha256(",".join(sorted(parts)).encode()).hexdigest()
    leaves = {}
    for i in ids:
        leaves.setdefault(hashlib.md5(i.encode()).hexdigest()[:depth], []).append(i)
    level = {p: (sha(v), len(v)) for p, v in leaves.items()}
    out = {(depth, p): v for p, v in level.items()}
    for up in range(depth - 1, -1, -1):
        above = {}
        for p, (d, n) in level.items():
            above.setdefault(p[:up], []).append((p + d, n))
        level = {p: (sha([c for c, _ in v]), sum(n for _, n in v)) for p, v in above.items()}
        out.update({(up, p): v for p, v in level.items()})
    return out


def test_tree_and_its_depth(spark):
    ids = [str(i * 7) for i in range(500)] + ["7", "ä"]
    rows = spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    for leaf, depth in ((1000, 0), (40, 1), (4, 2)):
        assert idtree.tree_depth(len(ids), leaf) == depth
        got = {(r["level"], r["prefix"]): (r["digest"], r["n"]) for r in idtree.hash_tree(rows, "id", leaf).collect()}
        assert got == brute_tree(ids, depth)
    assert idtree.hash_tree(rows.where("id = '-'"), "id").collect() == []


def test_ten_times_the_ids_keep_the_leaf(spark):
    for n in (3_000, 30_000):
        tree = idtree.hash_tree(spark.range(n), "id", leaf_size=100)
        deepest = tree.where(F.col("level") == idtree.tree_depth(n, 100))
        mean, most = deepest.selectExpr("avg(n)", "max(n)").first()
        assert mean <= 100 and most <= 200


def test_difference_reads_its_branch_only(spark):
    left = spark.range(20_000)
    right = left.where("id not in (17, 4711)").union(spark.createDataFrame([(99_999,), (5,)], "id long"))
    got = {(r["id"], r["side"], r["copies"]) for r in idtree.tree_difference(left, right, "id", 50).collect()}
    assert got == {("17", "left", 1), ("4711", "left", 1), ("99999", "right", 1), ("5", "right", 1)}
    depth = idtree.tree_depth(20_000, 50)
    trees = [idtree.hash_tree(df, "id", depth=depth) for df in (left, right)]
    assert 1 <= idtree.changed_leaves(*trees, depth).count() <= 4
    assert idtree.tree_difference(left, left, "id", 50).collect() == []
    empty = left.where("id < 0")
    assert idtree.tree_difference(empty, empty, "id").collect() == []
    assert idtree.tree_difference(left.limit(3), empty, "id").count() == 3


def test_hub_join_equals_the_plain_join_and_bounds_its_cells(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 97 == 0, None).otherwise(
        F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    right = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 89 == 0, None).otherwise(
        F.col("id") % 60).alias("k"), F.col("id").alias("y"))
    want = Counter(map(tuple, left.join(right, "k").groupBy("k").count().collect()))
    for limit, wide in ((10_000, 1_000_000), (10_000, 0), (10 ** 9, 1_000_000)):
        got = hub_join(left, right, "k", ["x"], ["y"], limit, wide, cell="cell")
        assert Counter(map(tuple, got.groupBy("k").count().collect())) == want
        assert got.select("x", "y").distinct().count() == got.count()
        assert got.groupBy("k", "cell").count().agg(F.max("count")).first()[0] <= 2 * limit
    # one node of half of all rows is dealt to many cells
    assert hub_join(left, right, "k", ["x"], ["y"], 10_000, cell="cell").where("k = 1").select("cell").distinct().count() > 200
    assert hub_join(left.where("k < 0"), right, "k", ["x"], ["y"]).count() == 0


def test_overlaps_of_numbers_and_texts(spark):
    pairs = [("a", i) for i in range(100_000)] + [("b", i) for i in range(50_000, 120_000)] + [("c", -3), ("c", 7), ("c", 7)]
    pairs += [("d", 500_000), (None, 1), ("a", None)]
    rows = spark.createDataFrame(pairs, "s string, m long")
    want = {("a", "b"): 50_000, ("a", "c"): 1, ("b", "c"): 0, ("a", "d"): 0, ("b", "d"): 0, ("c", "d"): 0}
    sizes = {"a": 100_000, "b": 70_000, "c": 2, "d": 1}
    for given in (rows, rows.select("s", F.col("m").cast("string").alias("m"))):
        for r in panel.pairwise_jaccard(given, "s", "m").collect():
            shared = want[r["a"], r["b"]]
            assert r["shared"] == shared
            assert abs(r["jaccard"] - shared / (sizes[r["a"]] + sizes[r["b"]] - shared)) < 1e-12
    assert panel.pairwise_jaccard(rows.where("m < -10"), "s", "m").collect() == []
