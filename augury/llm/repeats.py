"""Removal of every byte covered by a 100-byte string that also starts earlier in the corpus.

Sorting all suffixes of a corpus in one array is no Spark job, so the windows (100-byte strings) are first dealt to groups
that equal windows cannot leave: every window chooses its smallest 20-byte gram by hash, and neighbouring windows with
one choice form a run of at most 81 windows. Equal runs are one entry. Runs that share their gram with a different run
go, with their bytes, to suffix arrays built by two-stage sorting; adjacent common prefixes of 100 bytes name the
repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix, saved, utf8_parts
from .suffixes import repeated_windows

WINDOW, GRAM = 100, 20
CHOICES = WINDOW - GRAM + 1
SLICE, CHUNK = 1_500_000, 8_000_000
#: Bits of a place: windows 7, offset of the gram 7, start 34, tie 15; the sign marks a known repeat.
N_BITS, O_BITS, S_BITS = 7, 7, 34
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: One random 64-bit value per byte, from the finaliser (a rule, not a table).
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
CONTEXT = (WINDOW - GRAM) // 2
NULL_DOC = -(1 << 63)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(SLICE + 1, BASE), powers(SLICE + 1, INVERSE)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global UP, DOWN
    if n > len(UP):
        UP, DOWN = powers(n, BASE), powers(n, INVERSE)
    return UP[:n], DOWN[:n]


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows over texts laid end to end (``ends``: n + 1 offsets): gram hash, run hash, begin, offset of the
    gram, number of windows."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if n < WINDOW:
        return none
    up, down = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size * 2 <= CHOICES:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    count = n - WINDOW + 1
    least = np.minimum(least[:count], least[CHOICES - size: CHOICES - size + count])
    valid = np.zeros(n + 1, np.int64)
    long = ends[1:] - ends[:-1] >= WINDOW
    np.add.at(valid, ends[:-1][long], 1)
    np.add.at(valid, ends[1:][long] - WINDOW + 1, -1)
    valid = np.cumsum(valid[:count]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    inner = ends[1:-1]
    inner = inner[inner < count]
    new[inner] = valid[inner]
    begin = np.flatnonzero(new)
    if not len(begin):
        return none
    stop = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1
    windows = stop - begin
    at = (least[begin] & low).astype(np.int64)
    until = begin + windows - 1 + WINDOW
    whole = mix((total[until] - total[begin]) * down[begin] + windows.astype(np.uint64))
    return gram[at].view(np.int64), whole.view(np.int64), begin, at - begin, windows


def place(tie: np.ndarray, start: np.ndarray, offset: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (((tie << S_BITS | start) << O_BITS | offset) << N_BITS) | windows


def parts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tie, start, offset, windows."""
    rest = (packed & ((1 << 63) - 1)) >> N_BITS
    return rest >> (O_BITS + S_BITS), rest >> O_BITS & ((1 << S_BITS) - 1), rest & ((1 << O_BITS) - 1), packed & ((1 << N_BITS) - 1)


def text_runs(docs: DataFrame) -> DataFrame:
    """(gram, run, doc, place) of all texts; repeats inside one Arrow batch are found at once and marked by the sign."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            tie = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = utf8_parts(batch.column(2))
            pieces = []  # (row, first byte in the text, begin, end); long texts in overlapping chunks
            for row in range(len(doc)):
                a, b = int(offsets[row]), int(offsets[row + 1])
                pieces += [(row, c, a + c, min(b, a + c + CHUNK + WINDOW - 1))
                           for c in range(0, max(1, b - a - WINDOW + 1), CHUNK)] if b - a >= WINDOW else []
            found = []
            first = 0
            while first < len(pieces):
                size, last = 0, first
                while last < len(pieces) and (last == first or size + pieces[last][3] - pieces[last][2] <= SLICE):
                    size += pieces[last][3] - pieces[last][2]
                    last += 1
                own = pieces[first:last]
                ends = np.concatenate([[0], np.cumsum([p[3] - p[2] for p in own])])
                gram, run, begin, offset, windows = runs(np.concatenate([data[p[2]: p[3]] for p in own]), ends)
                piece = np.searchsorted(ends, begin, "right") - 1
                row = np.array([p[0] for p in own])[piece]
                start = begin - ends[piece] + np.array([p[1] for p in own])[piece]
                found.append((gram, run, doc[row], place(tie[row], start, offset, windows)))
                first = last
            if not found:
                continue
            gram, run, owner, where = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((where, owner, run, gram))
            gram, run, owner, where = gram[order], run[order], owner[order], where[order]
            same = (gram[1:] == gram[:-1]) & (run[1:] == run[:-1])
            keep = np.concatenate([[True], ~(same & (owner[1:] == owner[:-1]) & (where[1:] == where[:-1]))])[: len(gram)]
            again = np.concatenate([[False], same])[: len(gram)]
            where = np.where(again, where | np.int64(-(1 << 63)), where)
            gram = np.where(again, mix(owner.astype(np.uint64) + where.astype(np.uint64)).view(np.int64), gram)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, run, owner, where)],
                                             names=["gram", "run", "doc", "place"])

    return docs.select("doc", "tie", "text").mapInArrow(cut, "gram long, run long, doc long, place long")


def resolve(found: DataFrame) -> DataFrame:
    """(doc, place, gram): known repeats with a null gram; first runs that share their gram with a different run with it.

    Rows arrive sorted by gram, run and place. Only one row is held back between batches.
    """
    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_gram = last_run = last_doc = last_place = None
        kinds, pending = 0, None  # runs seen of the last gram; its first row while it is the only run
        for batch in batches:
            gram, run, doc, where = (c.to_numpy() for c in batch.columns)
            known = where < 0
            out = [(doc[known], where[known] & ((1 << 63) - 1), np.zeros(known.sum(), np.int64), np.zeros(known.sum(), bool))]
            gram, run, doc, where = gram[~known], run[~known], doc[~known], where[~known]
            if len(gram):
                new_gram = np.concatenate([[gram[0] != last_gram], gram[1:] != gram[:-1]])
                new_run = new_gram | np.concatenate([[run[0] != last_run], run[1:] != run[:-1]])
                same = np.concatenate([[doc[0] == last_doc and where[0] == last_place], (doc[1:] == doc[:-1]) & (where[1:] == where[:-1])])
                repeat = ~new_run & ~(same & ~new_run)
                out.append((doc[repeat], where[repeat], np.zeros(repeat.sum(), np.int64), np.zeros(repeat.sum(), bool)))
                group = np.cumsum(new_gram)  # 0: goes on from the batch before
                number = np.bincount(group[new_run], minlength=group[-1] + 1)
                if number[0] and pending is not None:
                    out.append(tuple(np.array([x]) for x in (*pending, True)))
                    pending = None
                number[0] += kinds if not new_gram[0] else 0
                several = new_run & (number[group] > 1)
                out.append((doc[several], where[several], gram[several], np.ones(several.sum(), bool)))
                if group[-1] > 0:
                    kinds, pending = 0, None
                kinds = int(number[group[-1]])
                if kinds == 1 and new_run[group == group[-1]].any():
                    at = np.flatnonzero((group == group[-1]) & new_run)[0]
                    pending = (doc[at], where[at], gram[at])
                last_gram, last_run, last_doc, last_place = gram[-1], run[-1], doc[-1], where[-1]
            owner, places, grams, needed = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(places), pa.array(grams, mask=~needed.astype(bool))],
                                             names=["doc", "place", "gram"])

    ordered = found.repartition("gram").sortWithinPartitions("gram", "run", "doc", "place")
    return ordered.mapInArrow(sift, "doc long, place long, gram long")


def joined_by_document(texts: DataFrame, rows: DataFrame, value: str, items: str) -> DataFrame:
    """``texts`` with the list of the rows that belong to each of them (by document and tie).

    Both steps that need this ask for the same columns of the texts, so these are dealt by name, and kept on disk, once.
    """
    tie = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << 63) - 1)), N_BITS + O_BITS + S_BITS)
    lists = rows.withColumn("_tie", tie.cast("long")).groupBy("doc", "_tie").agg(F.expr(f"collect_list({value})").alias(items)).select(
        F.xxhash64("doc", "_tie").alias("_name"), items)
    return texts.join(lists, texts["name"] == lists["_name"], "left")


def run_bytes(texts: DataFrame, needed: DataFrame, frequent: int) -> DataFrame:
    """(part, doc, place, bytes): runs cut in two where the gram's 40 bytes to the left or to the right name the part.

    Equal windows have equal parts. Runs of a gram with more than ``frequent`` different runs are cut into single
    windows, whose part is the window's hash, so that no part of theirs has more than a few different strings.
    """
    common = needed.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > frequent).select("gram", F.lit(True).alias("hot"))
    marked = needed.join(common, "gram", "left")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def name(*text: bytes) -> int:
            return int.from_bytes(hashlib.blake2b(b"".join(text), digest_size=8).digest(), "little", signed=True)

        for batch in batches:
            out, size = [], 0
            for doc, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                items = items.values
                where = items.field("place").to_numpy()
                hot = items.field("hot").fill_null(False).to_numpy(zero_copy_only=False)
                tie, start, offset, windows = parts(where)
                for t, s, o, w, h in zip(tie.tolist(), start.tolist(), offset.tolist(), windows.tolist(), hot.tolist()):
                    cuts = [(i, i + 1) for i in range(w)] if h else []
                    if not h:
                        left = min(w, max(0, o - CONTEXT + 1))  # windows with at least 40 bytes before the gram
                        cuts = [c for c in ((0, left), (left, w)) if c[0] < c[1]]
                    for a, b in cuts:
                        own = data[s + a: s + b - 1 + WINDOW]
                        g = s + o
                        part = name(own) if h else (
                            name(b"l", data[g - CONTEXT: g + GRAM]) if o - a >= CONTEXT else name(b"r", data[g: g + GRAM + CONTEXT]))
                        out.append((part, doc, (((t << S_BITS | s + a) << O_BITS) << N_BITS) | b - a, own))
                        size += len(own)
                if size > 8_000_000:
                    yield run_batch(out)
                    out, size = [], 0
            if out:
                yield run_batch(out)

    rows = joined_by_document(texts, marked, "struct(place, hot)", "items").where("items is not null")
    doc = F.coalesce("doc_id", F.lit(NULL_DOC)).alias("doc")
    return rows.select(doc, "text", "items").mapInArrow(cut, "part long, doc long, place long, bytes binary")


def run_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "doc", "place", "bytes"])


def sorted_repeats(cut: DataFrame, block_bytes: int = 6_000_000) -> DataFrame:
    """(doc, place) of windows that start earlier too, from suffix arrays over blocks of whole parts.

    A part larger than a block goes through in several; entries with a first window are carried on, the others are done.
    """
    def block(rows: list[tuple]) -> tuple[pa.RecordBatch | None, list[bool]]:
        packed = np.array([r[2] for r in rows], np.int64)
        tie, start, _, windows = parts(packed)
        owner = np.stack([np.array([r[1] for r in rows], np.int64), tie], 1)
        rank = np.unique(owner, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int64) << S_BITS | start
        again = repeated_windows([r[3] for r in rows], windows, rank)
        docs, places = [], []
        for r, t, s, flags in zip(rows, tie.tolist(), start.tolist(), again):
            if flags.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    docs.append(r[1])
                    places.append((((t << S_BITS | s + a) << O_BITS) << N_BITS) | b - a)
        found = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64())], names=["doc", "place"]) if docs else None
        return found, [not f.all() for f in again]

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # sorted by part; the last part may go on
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] == held[-1][:3]:
                    continue  # the same run of a repeated row
                if held and row[0] != held[-1][0]:
                    if len(held) == 1 or held[-2][0] != held[-1][0]:
                        size -= len(held.pop()[3])  # alone in its part: nothing to compare with
                    if size > block_bytes:
                        found, _ = block(held)
                        if found is not None:
                            yield found
                        held, size = [], 0
                elif size > 2 * block_bytes:
                    found, first = block(held)
                    if found is not None:
                        yield found
                    held = [r for r, f in zip(held, first) if f and r[0] == row[0]]
                    size = sum(len(r[3]) for r in held)
                held.append(row)
                size += len(row[3])
        if len(held) > 1:
            found, _ = block(held)
            if found is not None:
                yield found

    dealt = cut.repartition("part").sortWithinPartitions("part", "doc", "place")
    return dealt.mapInArrow(order, "doc long, place long")


def without_repeats(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): texts without the bytes of the repeated windows."""
    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
        for batch in batches:
            out, size = [], 0
            for doc, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans, kept = [], [data]
                if items.is_valid:
                    _, start, _, windows = parts(items.values.to_numpy())
                    stop = start + windows - 1 + WINDOW
                    by = np.argsort(start, kind="stable")
                    start, reach = start[by], np.maximum.accumulate(stop[by])
                    new = np.concatenate([[True], start[1:] > reach[:-1]])
                    first = start[new]
                    until = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                    spans = [{"start": a, "stop": b} for a, b in zip(first.tolist(), until.tolist())]
                    kept = [data[a:b] for a, b in zip([0, *until.tolist()], [*first.tolist(), len(data)])]
                own = b"".join(kept)
                out.append((doc, len(data), len(data) - len(own), spans, own))
                size += len(own)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = joined_by_document(texts, repeats, "place", "items").select("doc_id", "text", "items")
    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, "
                                   "spans array<struct<start: long, stop: long>>, kept binary")


def remove_repeats(docs: DataFrame, frequent: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (start, stop), kept (UTF-8 bytes that stay).

    A byte goes if a 100-byte string that covers it also starts earlier: in a document with a smaller id, or earlier in
    the same one. Strings are judged on the input. Null text counts as empty; texts under 100 bytes stay whole. A null id
    is the smallest. Rows that repeat an id with other texts are ordered by a hash of the text; rows that repeat an id
    and its text are one document and get that document's result each. An empty table gives no row; other columns are
    ignored.
    """
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))
    tie = F.xxhash64("text").bitwiseAND(F.lit((1 << 15) - 1))
    texts = texts.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_DOC)))
    found = saved(resolve(text_runs(texts.select("doc", tie.alias("tie"), "text"))), "runs")
    named = texts.select("doc_id", "text", F.xxhash64("doc", tie).alias("name"))
    cut = run_bytes(named, found.where("gram is not null").select("doc", "place", "gram"), frequent)
    repeats = found.where("gram is null").select("doc", "place").unionByName(sorted_repeats(cut))
    return without_repeats(named, repeats)
