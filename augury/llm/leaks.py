"""Benchmark passages in documents: whole pieces on near diagonals (exact filter), exact edit distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, small_batches

LONGEST = 8  # characters of a piece at most
SPARE = 4  # pieces that should survive all edits, where the item is long enough
COUNTED = 5  # characters of the grams counted in a place before its distance is taken
BITS = 22
STRIDE = 16  # characters between two looks at whether a distance can still be small enough
CHUNK, SLICE = 8_000_000, 300_000
A = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    """Characters as numbers."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters at every position."""
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size if n else 0):
        out += data[i: i + n]
        out *= A
    return out


def growing_hashes(data: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """``gram_hashes`` for rising sizes, each from the one before; the array belongs to the caller until the next one."""
    out, done = np.zeros(len(data), np.uint64), 0
    for size in sizes:
        for i in range(done, size):
            out = out[: max(0, len(data) - i)]
            out += data[i:]
            out *= A
        done = size
        yield out


def piece_size(length: int, edits: int) -> int:
    """Largest piece of which SPARE at least stay whole under ``edits`` edits; failing that, one at least."""
    sizes = range(LONGEST, 0, -1)
    return next((s for s in sizes if s > 3 and length // s - edits >= SPARE), None) or next(s for s in sizes if length // s > edits)


def edit_distance(item: str, text: str, most: int) -> int:
    """Smallest edit distance of ``item`` to any part of ``text`` (bit-parallel); ``most + 1`` if it is larger."""
    if item in text:
        return 0
    size = len(item)
    full, high = (1 << size) - 1, 1 << (size - 1)
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    plus, minus, score, best, known = full, 0, size, size, bits.get
    for start in range(0, len(text), STRIDE):
        if best > most and score - (len(text) - start) > most:  # a character lowers the distance by one at most
            return most + 1
        for c in text[start: start + STRIDE]:
            x = known(c, 0) | minus
            d = (((x & plus) + plus) ^ plus) | x
            up, down = minus | (full & ~(d | plus)), plus & d
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < best:
                    best = score
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | (full & ~(d | up)), up & d
    return best if best <= most else most + 1


class Items:
    """Benchmark items ready for search: every item is cut into pieces of equal size, kept as hashes by that size."""

    def __init__(self, rows: list[tuple[int, str]], max_edit: float):
        if not 0 <= max_edit < 1:
            raise ValueError("max_edit is a share of an item's characters: 0 or more, less than 1")
        known = [(i, plain(t)) for i, t in rows]
        known = [(i, t) for i, t in known if t]
        self.ids, self.texts = [i for i, _ in known], [t for _, t in known]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([int(max_edit * len(t)) for t in self.texts], np.int64)
        sizes = np.array([piece_size(n, k) for n, k in zip(self.lengths.tolist(), self.edits.tolist())], np.int64)
        #: Pieces that must be whole: an edit changes one piece at most.
        self.least = self.lengths // np.maximum(sizes, 1) - self.edits
        self.grams = [np.unique(gram_hashes(codes(t), COUNTED), return_counts=True) for t in self.texts]
        self.groups = [self.pieces(np.flatnonzero(sizes == s), int(s)) for s in np.unique(sizes)]

    def pieces(self, own: np.ndarray, size: int) -> tuple:
        """(size, bitmap, sorted different hashes, start and number of their entries, items, offsets) of the items ``own``."""
        hashes = [gram_hashes(codes(self.texts[i]), size)[::size] for i in own]
        gram, item = np.concatenate(hashes), np.repeat(own, [len(h) for h in hashes])
        offset = np.concatenate([np.arange(len(h)) for h in hashes]) * size
        order = np.argsort(gram, kind="stable")
        seen = np.zeros(1 << BITS, bool)
        seen[gram >> np.uint64(64 - BITS)] = True
        known, first, many = np.unique(gram[order], return_index=True, return_counts=True)
        return size, seen, known, first, many, item[order].astype(np.int64), offset[order].astype(np.int64)

    def windows(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to): every part of the texts that can hold an item within its edits.

        Whole pieces of a passage lie on diagonals that differ by its edits at most, so as many hits as pieces must be
        whole, that close together, miss no passage.
        """
        every = growing_hashes(data, [group[0] for group in self.groups])
        for (size, seen, known, first, many, items, offsets), hashes in zip(self.groups, every):
            at = np.flatnonzero(seen[hashes >> np.uint64(64 - BITS)])
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            fine = known[place] == hashes[at]
            at, place = at[fine], place[fine]
            doc = np.searchsorted(ends, at, "right") - 1
            fine = at + size <= ends[doc + 1]
            at, doc, place = at[fine], doc[fine], place[fine]
            lo, count = first[place], many[place]
            entry = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            item, doc = items[entry], np.repeat(doc, count)
            diagonal = np.repeat(at, count) - offsets[entry]
            order = np.argsort(item * (2 * len(data) + 2 * int(self.lengths.max())) + diagonal)
            item, doc, diagonal = item[order], doc[order], diagonal[order]
            last = np.arange(len(item)) + self.least[item] - 1
            there = np.minimum(last, len(item) - 1)
            good = (last < len(item)) & (item[there] == item) & (diagonal[there] - diagonal <= self.edits[item])
            item, doc, diagonal = item[good], doc[good], diagonal[good]
            if not len(item):
                continue
            start = np.maximum(diagonal - self.edits[item], ends[doc])
            stop = np.minimum(diagonal + self.lengths[item] + self.edits[item], ends[doc + 1])
            order = np.lexsort((start, doc, item))
            item, doc, start, stop = item[order], doc[order], start[order], stop[order]
            # parts that overlap are read once; stops grow with the starts of an item and text
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
            head = np.flatnonzero(new)
            final = np.append(head[1:], len(item)) - 1
            yield from zip(doc[head].tolist(), item[head].tolist(), start[head].tolist(), stop[final].tolist())

    def matches(self, text: str, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, distance) of confirmed passages; texts lie end to end in ``text``."""
        data = codes(text).astype(np.uint64)
        counted = None
        for doc, item, start, stop in self.windows(data, ends):
            most, (grams, times) = int(self.edits[item]), self.grams[item]
            kept = int(self.lengths[item]) - COUNTED + 1 - COUNTED * most  # grams that no edit touches, at least
            if kept > 0:
                counted = gram_hashes(data, COUNTED) if counted is None else counted
                own = counted[start: max(start, stop - COUNTED + 1)]
                place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                place = place[grams[place] == own]
                # every untouched gram has a place of its own, so a gram counts as often as the item has it
                if len(place) < kept or np.minimum(np.bincount(place, minlength=len(grams)), times).sum() < kept:
                    continue
            distance = edit_distance(self.texts[item], text[start:stop], most)
            if distance <= most:
                yield doc, item, distance


def benchmark_leaks(docs: DataFrame, items: DataFrame, max_edit: float = 0.15, text_col: str = "text", id_col: str = "item_id",
                    item_col: str = "text", out: str = "leaks", keep: list[str] | None = None, part_chars: int = 32_000_000) -> DataFrame:
    """Add the array column ``out``: (item_id, distance, item_chars) of every item that a document contains.

    An item is contained if some part of the document, both in lower case with single blanks, is within ``max_edit`` times
    the item's characters of it by edit distance. Items travel to the tasks in parts of about ``part_chars``
    characters; a larger benchmark takes more passes. Documents do not move.

    No passage is missed: an item of n pieces with k edits keeps n - k of them whole, and every place with so many whole
    pieces gets the exact distance.

    Null, empty or blank texts contain nothing, and null, empty or blank items are in nothing. Repeated items are reported once each; the array is in item order. All
    columns ``keep`` (default: all) stay.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    plain_items = items.select(col(id_col).cast("long").alias("i"), col(item_col).cast("string").alias("t")).where(
        "t is not null")
    total = plain_items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, ceil(total / part_chars))
    kind = "array<struct<item_id: long, distance: int, item_chars: int>>"
    result = docs.select(*map(col, kept), col(text_col).cast("string").alias(fresh(docs.columns, "_scanned")))
    scanned, found = result.columns[-1], []
    for part in range(parts):
        rows = [(r["i"], r["t"]) for r in plain_items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()]
        shared = docs.sparkSession.sparkContext.broadcast((rows, max_edit))
        name = fresh(result.columns, f"_part{part}")
        result, found = _scan(result, shared, scanned, name, kind), [*found, name]
    merged = F.array_sort(F.flatten(F.array(*[F.col(n) for n in found])))
    return result.select(*map(col, kept), merged.alias(out))


def _scan(docs: DataFrame, shared, scanned: str, name: str, kind: str) -> DataFrame:
    at = docs.columns.index(scanned)
    names = [*docs.columns, name]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        long_ = int(2 * items.lengths.max() + 8) if len(items.lengths) else 0
        for batch in small_batches(batches, at):
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            texts = [plain(t) for t in batch.column(at).to_pylist()]
            pieces, size = [], 0
            for row, text in enumerate(texts):
                for c in range(0, max(1, len(text)), CHUNK):
                    pieces.append((row, text[c: c + CHUNK + long_]))
                    size += len(pieces[-1][1])
                if size > SLICE or row == len(texts) - 1:
                    ends = np.concatenate([[0], np.cumsum([len(p) for _, p in pieces])]).astype(np.int64)
                    whole = "".join(p for _, p in pieces)
                    for piece, item, distance in items.matches(whole, ends) if len(whole) else ():
                        own = found[pieces[piece][0]]
                        own[item] = min(distance, own.get(item, distance))
                    pieces, size = [], 0
            values = [[{"item_id": items.ids[i], "distance": d, "item_chars": len(items.texts[i])} for i, d in own.items()] for own in found]
            column = pa.array(values, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_chars", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(scan, ", ".join([*fields, f"`{name}` {kind}"]))
