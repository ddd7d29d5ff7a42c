"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, held, saved, small_batches

BITS = np.uint64(21)  # a code point has at most 21 bits, so three of them fit in one unsigned 64-bit gram
BLANK = ord(" ")
SLICE = 100_000  # characters that are counted at a time
UNDETERMINED = "und"


def letters() -> np.ndarray:
    """Code point to itself for letters, to a blank for anything else."""
    return held("letters", _letters)


def _letters() -> np.ndarray:
    points = np.arange(0x110000, dtype=np.uint32)
    alpha = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(alpha, points, np.uint32(BLANK))


def gram_counts(texts: list[str], groups: np.ndarray, longest: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count) of all 1- to ``longest``-grams, sorted by group, then gram.

    Texts are lower-cased, runs of other characters become one blank, and a blank stands before and after every text.
    A gram of a blank alone, or starting or ending in a blank pair, does not count.
    """
    low = [" " + t.lower() + " " for t in texts]
    points = letters()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    first = np.ones(len(points), bool)
    first[1:] = owner[1:] != owner[:-1]
    keep = (points != BLANK) | first
    keep[1:] |= points[:-1] != BLANK
    points, owner = points[keep], owner[keep]
    alphabet, symbols = np.unique(points, return_inverse=True)
    width = np.uint64(max(1, int(len(alphabet)).bit_length()))
    symbols = symbols.astype(np.uint64) + np.uint64(1)
    keys, shift = [], np.uint64(longest) * width
    group = groups[owner].astype(np.uint64) << shift
    gram = np.zeros(len(points), np.uint64)
    blank = points == BLANK
    for n in range(1, longest + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        gram = (gram[:size] << width) | symbols[n - 1:]
        fine = owner[:size] == owner[n - 1:]
        if n == 1:
            fine &= ~blank
        keys.append((group[:size] | gram)[fine])
    joined = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(joined)), bool), joined[1:] != joined[:-1]]))
    unique = joined[start]
    counts = np.diff(np.append(start, len(joined)))
    mask = (np.uint64(1) << width) - np.uint64(1)
    codes = np.zeros(len(unique), np.uint64)
    for n in range(longest - 1, -1, -1):
        symbol = (unique >> (np.uint64(n) * width)) & mask
        point = np.where(symbol > 0, alphabet[np.maximum(symbol, 1).astype(np.int64) - 1], 0).astype(np.uint64)
        codes = (codes << BITS) | point
    return (unique >> shift).astype(np.int64), codes, counts


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > SLICE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def profiles(labelled: DataFrame, profile_size: int = 400, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank): the ``profile_size`` most frequent n-grams of every language over all given texts.

    Rank 0 is the most frequent; ties go to the smaller gram. Rows without text or language are left out.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            langs, index = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                group, gram, n = gram_counts(texts[a:b], index[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[group], pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"])

    rows = labelled.select(col(text_col).alias("text"), col(lang_col).alias("lang")).where(
        "text is not null and lang is not null")
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The filter stands on the bare row number, so map tasks already cut every language to its first grams.
    first = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    return first.select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class RankModel:
    """Profiles of all languages side by side: a row per gram, a column per language."""

    def __init__(self, rows: list, profile_size: int):
        self.size = profile_size
        self.langs = sorted({r["lang"] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64).astype(np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), profile_size, np.int32)  # last row: unknown gram
        for r in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(r["gram"])), place[r["lang"]]] = r["rank"]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Nearest language and 1 - distance / largest possible distance; ``und`` and 0 without a letter."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for a, b in slices(texts):
            doc, gram, n = gram_counts(texts[a:b], np.arange(b - a))
            if not len(doc):
                continue
            order = np.argsort((doc << 40) - n, kind="stable")  # by document, most frequent first, then by gram
            doc, gram = doc[order], gram[order]
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            rank = np.arange(len(doc)) - np.repeat(start, np.diff(np.append(start, len(doc))))
            top = rank < self.size
            doc, gram, rank = doc[top], gram[top], rank[top]
            at = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
            at = np.where(self.grams[at] == gram, at, len(self.grams))
            known = self.ranks[at]
            off = np.where(known < self.size, np.abs(known - rank[:, None]), self.size)
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total = np.add.reduceat(off, start, axis=0)
            best = total.argmin(axis=1)
            most = np.diff(np.append(start, len(doc))) * self.size
            for d, i, s in zip(doc[start], best, 1 - total[np.arange(len(best)), best] / most):
                names[a + d], scores[a + d] = self.langs[i], s
        return names, scores


def fit(labelled: DataFrame, profile_size: int = 400, most_languages: int = 5000, text_col: str = "text",
        lang_col: str = "lang") -> RankModel:
    """The model is (languages x profile size) numbers; more languages than ``most_languages`` is refused."""
    kept = saved(profiles(labelled, profile_size, text_col, lang_col), "profiles")
    if kept.select("lang").distinct().count() > most_languages:
        raise ValueError(f"more than {most_languages} languages: is the label column right?")
    return RankModel(kept.collect(), profile_size)


def identify(docs: DataFrame, model: RankModel, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language and its score to the columns ``keep`` (all by default; one named like an output is
    replaced).

    Null text and text without a letter get ``und`` and 0, as does every text under a model without languages. Equal
    texts get equal results. A tie goes to the language first in order.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (lang_out, score_out)]

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            names, scores = model.predict([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores)],
                                             names=[*kept, lang_out, score_out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*map(col, kept)).schema]
    return docs.select(col(text_col).cast("string").alias(fresh(docs.columns, "_text")), *map(col, kept)).mapInArrow(
        label, ", ".join([*fields, f"`{lang_out}` string", f"`{score_out}` double"]))


def fold(id_column: Column, folds: int = 4) -> Column:
    """Fold of a row: CRC-32 of its id in decimal digits, modulo ``folds``; a null id counts as no digits."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds
