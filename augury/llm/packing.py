"""Token sequences of bounded length from documents, packed by bounded-space best fit."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, held, saved, small_batches

#: White space other than space, tab and line ends: a tokenizer may not treat these as a word's end.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: Words that normalisation leaves alone but for case, and the tokenizer's own split of them (fixed values).
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level alphabet of the model for the second bytes of Latin letters and for the first (fixed rule: printable
#: bytes stand for themselves, others are moved up from 256 in order).
STAND = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_CHAR = [chr(256 + STAND.index(b)) if b in STAND else chr(b) for b in range(256)]


class Remembered(dict):
    """A mapping that computes what it lacks and keeps it while there is room."""

    def __init__(self, compute, most: int, longest: int):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, word: str) -> bytes:
        value = self.compute(word)
        if len(self) < self.most and len(word) <= self.longest:
            self[word] = value
        return value


class WordIds:
    """Token ids of whole texts as little-endian 32-bit bytes, with a bounded memory of words and word parts.

    The tokenizer's pre-tokenizer never joins across white space, so a text's ids are the ids of its words. A word of
    plain Latin characters is split as the tokenizer does and its parts go to the tokenizer's model; any other word, and
    texts with unusual white space, go through the whole tokenizer.
    """

    def __init__(self, path: str, words: int = 300_000, parts: int = 100_000, longest: int = 40):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Remembered(self.word, words, longest)
        self.parts = Remembered(self.part, parts, longest)

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, part: str) -> bytes:
        known = part if part.isascii() else "".join([BYTE_CHAR[b] for b in part.encode()])
        ids = [t.id for t in self.model.tokenize(known)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word) or "<|" in word or len(word) > 1000:
            return self.encode(word)
        return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets into them. Each distinct word is looked up once."""
        column = column.cast(pa.large_string())
        odd = {i: self.encode(t) for i, t in enumerate(column.to_pylist()) if ODD_SPACE.search(t)}
        if odd:
            column = pa.array(["" if i in odd else t for i, t in enumerate(column.to_pylist())], pa.large_string())
        words = pc.ascii_split_whitespace(column)
        coded = words.flatten().dictionary_encode()
        own = list(map(self.words.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(own), "<u4")
        word = coded.indices.to_numpy()
        count = size[word]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(start[word] - ends[:-1], count) + np.arange(ends[-1])]
        offsets = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        if odd:
            parts = [np.frombuffer(odd[i], "<u4") if i in odd else ids[offsets[i]: offsets[i + 1]] for i in range(len(column))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets


def encoder(path: str) -> WordIds:
    """One encoder for each worker process."""
    return held(("encoder", path), lambda: WordIds(path))


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts, end each with ``end_id``, and cut only what is longer than ``max_tokens``.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit). Null or empty text is the end id alone. Repeated rows give repeated pieces; an empty table gives
    no row. Other columns are ignored.
    """
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids", pa.binary())])
        for batch in small_batches(batches, 1, 2_000_000):
            ids, at = ids_of.texts(batch.column(1).fill_null(""))
            out = []
            for doc, first, last in zip(batch.column(0).to_pylist(), at[:-1], at[1:]):
                own = ids[first:last].tobytes() + end
                for piece, cut_at in enumerate(range(0, len(own), 4 * max_tokens)):
                    part = own[cut_at: cut_at + 4 * max_tokens]
                    out.append((doc, piece, cut_at // 4, len(part) // 4, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


class OpenBins:
    """Bounded-space online best fit. Open bins are found by a bitset whose bit f says: a bin with f places is open."""

    def __init__(self, size: int, most: int, first_id: int, step: int = 1):
        self.size, self.most, self.next, self.step = size, most, first_id, step
        self.bits, self.by_free, self.open = 0, {}, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the fullest open bin that has room; else of a new one, for which the fullest may close."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, free = self.next, self.size
            self.next += self.step
        if free > length:
            self.by_free.setdefault(free - length, []).append(bin_id)
            self.bits |= 1 << (free - length)
            self.open += 1
        return bin_id, self.size - free


def pack(pieces: DataFrame, max_tokens: int = 4096, open_bins: int = 1024, pieces_per_task: int = 150_000) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``max_tokens``; other columns are kept.

    Columns of the input named ``sequence_id`` or ``offset`` are replaced. Rows whose length is null or outside that range
    are kept with a null place. Repeated rows are placed one by one; an empty table gives an empty result.

    Rows are dealt by hash to tasks of about ``pieces_per_task`` rows and arrive there in hash order; every task packs
    its own stream with ``open_bins`` open bins at most, so memory is bounded and a lost task is simply packed again.
    Offsets within a sequence have no gaps. Sequence numbers are unique; they hold the task in the high bits.
    """
    kept = saved(pieces.drop("sequence_id", "offset"), "pieces")
    tasks = max(1, ceil(kept.count() / pieces_per_task))
    names, at = kept.columns, kept.columns.index("length")
    spread = F.xxhash64(*[F.col(f"`{n}`") for n in names])
    order = fresh(names, "_order")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        bins = OpenBins(max_tokens, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) if n is not None and 0 < n <= max_tokens else (None, None)
                      for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array([p[0] for p in placed], pa.int64()),
                 pa.array([p[1] for p in placed], pa.int64())], names=[*names, "sequence_id", "offset"])

    dealt = kept.withColumn(order, spread).repartition(tasks, order).sortWithinPartitions(order)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], "sequence_id long, offset long"])
    return dealt.mapInArrow(fill, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of every packed sequence (binary, little-endian 32-bit); the input needs ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.size("parts").alias("pieces"),
        F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"))
