"""Hard negatives: rows of another label that score close below an anchor's positives, by exact integer products.

Components are whole numbers. Biased by the largest magnitude they are not negative, and so several candidates' components
fit side by side into one wide integer, each in a field broad enough for a whole inner product (Kronecker packing). One
multiplication by an anchor's component then serves all of them; fields never carry into each other, and the bias is taken
off after unpacking. Fields that fit into 53 bits ride in doubles, where sums of products are exact and matrix products
fast; broader ones ride in Python integers.

Anchors meet all rows in cells: a block of anchors and a stripe of the rows. A cell is a partition that holds its anchors
and lets the rows of its stripe stream by, so memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, saved

#: Rows that are scored at a time against the anchors of a cell.
CHUNK = 512


class Packed:
    """Exact inner products of whole-number vectors of ``size`` components, none beyond ``peak`` in magnitude."""

    def __init__(self, size: int, peak: int):
        self.size, self.peak = size, peak
        self.bits = max(1, (size * (2 * peak) ** 2).bit_length())
        self.fields = 53 // self.bits
        self.wide = self.fields == 0
        if self.wide:
            self.fields = 8

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Integer products, one line per anchor."""
        kind = object if self.wide else np.float64
        number = np.vectorize(int, otypes=[object]) if self.wide else (lambda x: x)
        a, r = number(anchors.astype(np.float64)).astype(kind), number(rows.astype(np.float64)).astype(kind)
        room = ceil(len(r) / self.fields)
        packed = np.zeros((room, self.size), kind)
        for f in range(self.fields):
            part = r[f * room: (f + 1) * room]
            packed[:len(part)] += (part + self.peak) * (1 << f * self.bits)
        product = (a + self.peak) @ packed.T
        if not self.wide:
            product = product.astype(np.int64)
        fields = [(product >> f * self.bits) & ((1 << self.bits) - 1) for f in range(self.fields)]
        whole = np.concatenate(fields, axis=1)[:, :len(r)]
        bias = self.peak * (a.sum(1)[:, None] + r.sum(1)[None, :]) + self.size * self.peak ** 2
        return (whole - (bias if self.wide else bias.astype(np.int64))).astype(np.int64)


NONE = np.iinfo(np.int64).min


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each line: higher scores first, then smaller ids. NONE marks what does not count.

    The columns come in the order of ids. Scores above a line's k-th best are all taken, then the first equal ones.
    """
    if scores.shape[1] > 4 * k:
        kth = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, equal = scores > kth, scores == kth
        take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1)[:, None]))
        at = np.nonzero(take)[1].reshape(-1, k)
        scores = np.take_along_axis(scores, at, 1)
        ids = ids[at]
    else:
        ids = np.broadcast_to(ids, scores.shape)
    return best_of(scores, ids, k)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line of (score, id), in order."""
    order = np.lexsort((ids, ~scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def usable(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """(vec_id, label, x): rows with an id, a label and a vector whose components are all present and finite.

    A component becomes floor(scale * x), with x as double.
    """
    x = col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(col(id_col).isNotNull() & col(label_col).isNotNull() & x.isNotNull() & fine).select(
        col(id_col).cast("long").alias("vec_id"), col(label_col).cast("int").alias("label"),
        F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as lines of a matrix; shorter ones end in zeros."""
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(width) and (width == size).all():
        return flat.reshape(len(width), size)
    out = np.zeros((len(width), size))
    out[np.arange(size) < width[:, None]] = flat
    return out


class PositiveCell:
    """Best rows of the anchors' own labels."""

    out = "anchor_id long, partner long, score long"

    def __init__(self, packed: Packed, k: int):
        self.packed, self.k = packed, k

    def start(self, ids, labels, vectors, bounds):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.score = np.full((len(ids), self.k), NONE)
        self.partner = np.full((len(ids), self.k), NONE)

    def see(self, ids, labels, vectors):
        for label in np.intersect1d(labels, self.labels):
            mine, own = np.nonzero(self.labels == label)[0], np.nonzero(labels == label)[0]
            scores = self.packed.scores(self.vectors[mine], vectors[own])
            scores[self.ids[mine][:, None] == ids[own][None, :]] = NONE
            top, who = top_of(scores, ids[own], self.k)
            self.score[mine], self.partner[mine] = best_of(np.concatenate([self.score[mine], top], 1),
                                                           np.concatenate([self.partner[mine], who], 1), self.k)

    def rows(self):
        a, p = np.nonzero(self.score != NONE)
        return [self.ids[a], self.partner[a, p], self.score[a, p]]


class NegativeCell:
    """Best rows of other labels within the bounds that each positive sets."""

    out = "anchor_id long, place int, partner long, score long"

    def __init__(self, packed: Packed, k: int, positives: int):
        self.packed, self.k, self.positives = packed, k, positives

    def start(self, ids, labels, vectors, bounds):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low = np.full((len(ids), self.positives), 1)
        self.high = np.full((len(ids), self.positives), 0)
        for i, own in enumerate(bounds):
            for p, (low, high) in enumerate(own):
                self.low[i, p], self.high[i, p] = low, high
        self.score = np.full((len(ids), self.positives, self.k), NONE)
        self.partner = np.full((len(ids), self.positives, self.k), NONE)

    def see(self, ids, labels, vectors):
        scores = self.packed.scores(self.vectors, vectors)
        scores[(self.labels[:, None] == labels[None, :]) | (self.ids[:, None] == ids[None, :])] = NONE
        for p in range(self.positives):
            inside = (scores >= self.low[:, p, None]) & (scores <= self.high[:, p, None])
            mine = np.nonzero(inside.any(1))[0]
            if not len(mine):
                continue
            top, who = top_of(np.where(inside[mine], scores[mine], NONE), ids, self.k)
            self.score[mine, p], self.partner[mine, p] = best_of(np.concatenate([self.score[mine, p], top], 1),
                                                                 np.concatenate([self.partner[mine, p], who], 1), self.k)

    def rows(self):
        a, p, r = np.nonzero(self.score != NONE)
        return [self.ids[a], p.astype(np.int32), self.partner[a, p, r], self.score[a, p, r]]


def in_cells(anchors: DataFrame, rows: DataFrame, blocks: int, stripes: int, size: int, make) -> DataFrame:
    """Run a cell object over every (block of anchors, stripe of rows); ``anchors`` has ``bounds`` besides the rows' columns."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at, held, ready = None, None, [], False

        def start():
            nonlocal held, ready
            parts = [np.concatenate(c) if i < 3 else [v for part in c for v in part] for i, c in enumerate(zip(*held))]
            cell.start(*parts)
            held, ready = [], True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cell.rows()], names=[n.split()[0] for n in cell.out.split(", ")])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            marks = numbers.astype(np.int64) * 2 + kinds
            edges = [0, *(np.nonzero(np.diff(marks))[0] + 1).tolist(), len(marks)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if numbers[a] != at:
                    if ready:
                        yield done()
                    at, cell, held, ready = numbers[a], make(), [], False
                for first in range(a, b, CHUNK):
                    part = batch.slice(first, min(CHUNK, b - first))
                    ids, labels = part.column(2).to_numpy(), part.column(3).to_numpy()
                    vectors = matrix(part.column(4), size)
                    if kinds[a] == 0:
                        held.append((ids, labels, vectors, [[(x["low"], x["high"]) for x in row or []]
                                                           for row in part.column(5).to_pylist()]))
                        continue
                    if held:
                        start()
                    if not ready:  # a block that got no anchor
                        break
                    order = np.argsort(ids, kind="stable")
                    cell.see(ids[order], labels[order], vectors[order])
        if ready:
            yield done()

    cells = blocks * stripes
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    stripe = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(stripes)).cast("int")
    every_stripe = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = anchors.select("vec_id", "label", "x", "bounds", block.alias("b"), every_stripe.alias("s"))
    right = rows.select("vec_id", "label", "x", F.lit(None).cast("array<struct<low:long,high:long>>").alias("bounds"),
                        every_block.alias("b"), stripe.alias("s"))
    both = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)))
    dealt = both.select((F.col("b") * stripes + F.col("s")).cast("int").alias("cell"), "kind", "vec_id", "label", "x", "bounds")
    return dealt.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "kind").mapInArrow(work, make().out)


def hard_negatives(rows: DataFrame, anchor: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, block_rows: int = 8192, stripes: int = 24) -> DataFrame:
    """For every anchor and each of its first positives, the first negatives whose score lies in the given share of it.

    ``rows`` as from ``usable`` (vec_id, label, x with whole numbers). A row's score is its inner product with the anchor;
    higher scores come first, smaller ids break ties. Positives are other rows of the anchor's label; negatives have
    another label and low * positive_score <= 100 * score <= high * positive_score. Rows with the anchor's own id are
    never its partners. Repeated rows count each time as partners; a repeated anchor id counts once, with its smallest
    (label, vector). Shorter vectors count as ending in zeros. No anchor or no positive gives no row. Scores beyond 64 bits
    are an error. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    kept = saved(rows.select("vec_id", "label", "x"), "negatives-rows")
    size, peak = kept.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    size, peak = max(1, size or 0), max(1, int(peak or 0))
    if size * (2 * peak) ** 2 >= 1 << 62 and size * peak ** 2 >= 1 << 56:
        raise OverflowError("inner products do not fit into 64 bits")
    first = kept.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("own")).select("vec_id", "own.*")
    anchors = saved(first, "negatives-anchors")
    blocks = max(1, ceil(anchors.count() / block_rows))
    plain = anchors.withColumn("bounds", F.lit(None).cast("array<struct<low:long,high:long>>"))
    near = in_cells(plain, kept, blocks, stripes, size, lambda: PositiveCell(Packed(size, peak), positives))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "partner")))
    chosen = saved(near.groupBy("anchor_id").agg(F.slice(ordered, 1, positives).alias("chosen")), "negatives-positives")
    bounds = F.transform("chosen", lambda c: F.struct(
        F.ceil(-c["down"] * F.lit(low).cast("decimal(5,0)") / 100).cast("long").alias("low"),
        F.floor(-c["down"] * F.lit(high).cast("decimal(5,0)") / 100).cast("long").alias("high")))
    bounded = anchors.join(chosen.select(F.col("anchor_id").alias("vec_id"), bounds.alias("bounds")), "vec_id")
    far = in_cells(bounded, kept, blocks, stripes, size, lambda: NegativeCell(Packed(size, peak), negatives, positives))
    best = far.groupBy("anchor_id", "place").agg(F.slice(ordered, 1, negatives).alias("found"))
    listed = best.select("anchor_id", "place", F.posexplode("found").alias("at", "n"))
    named = chosen.select("anchor_id", F.posexplode("chosen").alias("place", "p"))
    return listed.join(named, ["anchor_id", "place"]).select(
        "anchor_id", F.col("p.partner").alias("positive_id"), (F.col("at") + 1).alias("rank"),
        F.col("n.partner").alias("negative_id"), (-F.col("p.down")).alias("positive_score"),
        (-F.col("n.down")).alias("negative_score"))
