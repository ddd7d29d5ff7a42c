import random
from math import floor, isfinite

import numpy as np
import pytest
from compare import compare, duck
from conftest import SMALL

from augury.llm import negatives
from augury.llm.queries import QUERIES, SQL

NAMES = "anchor_id positive_id rank negative_id positive_score negative_score".split()


def brute(rows, anchor, positives=5, negatives=3):
    kept = [(i, y, [floor(256 * v) for v in x]) for i, y, x in rows
            if None not in (i, y, x) and all(v is not None and isfinite(v) for v in x)]
    out = []
    anchors = {}
    for i, y, x in kept:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (y, x)), (y, x))
    for a, (y, x) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(x, other)), i, label == y) for i, label, other in kept if i != a)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            found = [r for r in scored if not r[2] and -50 * s <= -100 * r[0] <= -95 * s][:negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **parameters):
    schema = "vec_id long, embedding array<double>, label int, x string, cell string"
    table = spark.createDataFrame([(i, x, y, "c", "d") for i, y, x in rows], schema).repartition(3)
    return sorted(tuple(r[n] for n in NAMES) for r in negatives.hard_negatives(negatives.usable(table), **parameters).collect())


@pytest.mark.parametrize("peak,size", [(1, 1), (159, 64), (4000, 16), (2 ** 20, 7), (2 ** 27, 3)])
def test_packed_products_are_exact(peak, size):
    rng = np.random.default_rng(peak)
    a, r = rng.integers(-peak, peak + 1, (9, size)), rng.integers(-peak, peak + 1, (101, size))
    a[0], r[0] = peak, -peak
    packed = negatives.Packed(size, peak)
    want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in r] for x in a]
    assert packed.scores(a, r).tolist() == want
    assert packed.fields > 1 or packed.bits > 26


def test_ties_nulls_and_repeats_equal_brute_force(spark):
    random.seed(1)
    rows = [(i, random.choice([0, 0, 0, 1, 2]), [random.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(3)]) for i in range(-60, 300)]
    rows += [(7, 1, None), (8, None, [1.0] * 3), (None, 0, [1.0] * 3), (50, 1, [1.0, None, 0.0]), (9, 1, [float("nan")] * 3),
             (10, 2, [float("inf"), 0.0, 0.0]), (100, 0, [1.0, 0.25, 0.5]), (11, 1, [1.0, 1.0, 1.0]), (11, 1, [1.0, 1.0, 1.0])]
    want = brute(rows, lambda i: i % 50 == 0)
    assert len(want) > 50 and mined(spark, rows) == want
    assert mined(spark, rows, block_rows=2, stripes=3) == want


def test_hot_label_and_small_tables(spark):
    rows = [(i, int(i % 40 == 0), [1.0 + i % 3, i % 5 / 4]) for i in range(150)]
    assert mined(spark, rows, stripes=2) == brute(rows, lambda i: i % 50 == 0)
    assert mined(spark, []) == [] and mined(spark, [(50, 1, [1.0])]) == [] and mined(spark, [(1, 1, [1.0]), (2, 0, [1.0])]) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 0, [])]) == [(0, 1, 1, 2, 0, 0)]


def test_large_components(spark):
    random.seed(2)
    rows = [(i, i % 3, [random.uniform(-2e5, 2e5) for _ in range(4)]) for i in range(120)]
    assert mined(spark, rows, stripes=2) == brute(rows, lambda i: i % 50 == 0)
    with pytest.raises(OverflowError):
        mined(spark, [(i, i % 2, [1e12, 1e12]) for i in range(60)])


def test_query_equals_sql(spark):
    ok, note = compare(spark, duck(SMALL), "op13_negatives", QUERIES["op13_negatives"], SQL["op13_negatives"], SMALL)
    assert ok, note
