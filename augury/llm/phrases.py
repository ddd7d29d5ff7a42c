"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, mix

SLICE = 500_000  # code points parsed at a time
STEP = np.uint64(0x9E3779B97F4A7C15)
FIRST_LEVEL = 2  # phrases of about nine characters and more make the fingerprint
LEVELS = 14
SIZE = 96
POWERS = np.multiply.accumulate(np.full(4096, STEP, np.uint64))
LEAST_ID = -(1 << 63)


def _coin(previous: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: place of the lowest bit that differs from the name before, and its value."""
    differ = previous ^ own
    place = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1)).astype(own.dtype)
    return (place * own.dtype.type(2) + ((own >> np.minimum(place, own.dtype.type(own.dtype.itemsize * 8 - 1))) & own.dtype.type(1))).astype(np.uint8)


_PAIR = np.arange(256 * 256)
NEXT = _coin((_PAIR >> 8).astype(np.uint8), (_PAIR & 255).astype(np.uint8))


def phrases(names: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and owners of the next level's phrases.

    Runs of one name become one name. Three rounds of coin tossing turn names into labels of a small alphabet that differ
    between neighbours; a phrase starts at every local maximum, so its borders depend on a few neighbours only.
    """
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(names))).astype(np.uint64)
    names, owner = names[start], owner[start]
    names = np.where(length > 1, mix(names + length * STEP), names)
    n = len(names)
    head = np.ones(n, bool)
    head[1:] = owner[1:] != owner[:-1]
    label = (names & np.uint64(1)).astype(np.uint8)
    label[1:] = np.where(head[1:], label[1:], _coin(names[:-1], names[1:]))
    for _ in range(2):
        after = label & np.uint8(1)
        after[1:] = np.where(head[1:], after[1:], NEXT[(label[:-1].astype(np.uint16) << np.uint16(8)) | label[1:]])
        label = after
    top = head.copy()
    if n > 2:
        top[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~head[2:]
    start = np.flatnonzero(top)
    at = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    total = np.add.reduceat(names * POWERS[at & 4095], start)
    size = np.diff(np.append(start, n)).astype(np.uint64)
    return mix(total + (size * np.uint64(64) + np.uint64(level)) * STEP), owner[start]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The SIZE smallest 32-bit hashes of every text's phrase names from FIRST_LEVEL on (all, where they are fewer).

    A text that is one phrase before that level has that phrase alone; an empty text has none.
    """
    out = []
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > SLICE or i == len(texts) - 1:
            out += _sketches(texts[first: i + 1])
            first, size = i + 1, 0
    return out


def _sketches(texts: list[str]) -> list[np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    names, found = mix(points.astype(np.uint64) + np.uint64(1)), []
    for level in range(1, LEVELS + 1):
        if not len(names):
            break
        names, owner = phrases(names, owner, level)
        alone = np.ones(len(names), bool)
        alone[1:] &= owner[1:] != owner[:-1]
        alone[:-1] &= owner[1:] != owner[:-1]
        taken = np.ones(len(names), bool) if level >= FIRST_LEVEL else alone
        found.append((owner[taken].astype(np.uint64) << np.uint64(32)) | (mix(names[taken]) >> np.uint64(32)))
        names, owner = names[~alone], owner[~alone]
    if not found:
        return [np.zeros(0, np.uint32)] * len(texts)
    keys = np.unique(np.concatenate(found))
    ends = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = keys.astype(np.uint32)
    return [low[a: min(b, a + SIZE)] for a, b in zip(ends[:-1], ends[1:])]


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Estimated share of phrases in common, 2 |both| / (|left| + |right|), from the smallest hashes of the union."""
    if not len(left) or not len(right):
        return 1.0 if len(left) == len(right) else 0.0
    union = np.union1d(left, right)
    if len(left) >= SIZE or len(right) >= SIZE:
        union = union[:SIZE]
    both = np.intersect1d(left, right, assume_unique=True)
    share = int((both <= union[-1]).sum()) / len(union)
    return 2 * share / (1 + share)


def printed(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text; null counts as empty. Equal texts have equal fingerprints."""
    @F.pandas_udf("string")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series([printed(s) for s in sketches([t or "" for t in texts])])

    return docs.withColumn(out, print_of(col(text_col).cast("string")))


def blocks(rows: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """Smallest and largest id of contiguous blocks of about ``block_bytes`` of text: two numbers for each block."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cut = rows.select("doc").repartitionByRange(max(1, ceil(size / block_bytes)), "doc").groupBy(F.spark_partition_id().alias("_part")).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    return sorted((r["lo"], r["hi"]) for r in cut.collect())


def compared_with_edits(docs: DataFrame, block_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of edited texts, with their likenesses.

    The next document is the one with the next smaller id; after the smallest id comes the largest. The edited text keeps
    the first half and takes as many characters as it lost (or all) from the start of the next text. Returns doc_id,
    n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    Documents move once, in blocks of neighbouring ids; the first document of a block is also sent to the block before,
    whose last document needs it. Null text is empty and a null id is the smallest. Rows with equal ids follow one
    another by text. A single row is its own next document. An empty table gives no row; other columns are ignored.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LEAST_ID)))
    cuts = blocks(rows, block_bytes)
    low, high = np.array([c[0] for c in cuts], np.int64), {c[1]: i for i, c in enumerate(cuts)}

    @F.pandas_udf("array<int>")
    def block_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(low, ids.to_numpy(), "right") - 1
        # the largest id of block b begins it (descending ids) and ends block b + 1, the last block's ends block 0
        return pd.Series([[b, (high[i] + 1) % len(low)] if i in high else [b] for i, b in zip(ids.tolist(), own.tolist())])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
                            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

        def results(part: list[tuple]) -> pa.RecordBatch | None:
            """Rows of ``part`` but the last, each with the row after it."""
            texts = [r[3] for r in part]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
            prints, others = sketches(texts), sketches(edited)
            out = [(r[2], len(r[3]), e, printed(p), printed(q), likeness(p, q), likeness(p, following))
                   for r, e, p, q, following, after in zip(part, edited, prints, others, prints[1:], part[1:])
                   if not r[1] and r[0] == after[0]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else None

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > 2_000_000:
                    found = results(held)
                    if found is not None:
                        yield found
                    held, size = held[-1:], len(row[3])
        found = results(held) if len(held) > 1 else None
        if found is not None:
            yield found

    sent = rows.select("doc_id", "doc", "text", F.posexplode(block_of("doc")).alias("copy", "block"))
    dealt = sent.repartition(max(1, len(cuts)), "block").sortWithinPartitions("block", "copy", F.desc("doc"), "text")
    return dealt.select("block", "copy", "doc_id", "text").mapInArrow(
        compare, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")


