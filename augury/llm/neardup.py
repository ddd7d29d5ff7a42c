"""Near-duplicate classes by an inverted join over MinHash signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, held, mix, saved, small_batches, spans_of, utf8_parts
from .components import smallest_reachable

WIDTH = 5
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Multiplier of byte and word positions (an odd constant, fixed) and the largest block of a hot posting list.
BASE, BLOCK = 0x9E3779B97F4A7C15, 256


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all five-word shingles of texts laid end to end, and the text each belongs to (sorted).

    Words are runs of other bytes than space and 0x09-0x0D, with A-Z lower-cased; a text of one to four words has its
    whole sequence as its only shingle.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[data]
    word = ~BLANKS[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = word[edge]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's hash: sum of byte values times powers of the position, bytes between words count nothing
    run = np.cumsum(first)
    at = (np.arange(len(low)) - start[np.maximum(run, 1) - 1])[word]
    longest = int(at.max()) + 1
    value = (low[word].astype(np.uint64) + np.uint64(1)) * powers(longest)[at]
    begin = np.concatenate([[0], np.cumsum(word)])[start]
    words = mix(np.add.reduceat(value, begin))
    owner = np.searchsorted(offsets, start, "right") - 1
    per_text = np.bincount(owner, minlength=n)
    base = powers(WIDTH)
    total = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        total += words[k: k + len(total)] * base[k]
    whole = np.zeros(0, bool) if not len(total) else owner[: len(total)] == owner[WIDTH - 1:]
    hashes, owners = [mix(total[whole])], [owner[: len(total)][whole]]
    short = np.flatnonzero((per_text > 0) & (per_text < WIDTH))
    if len(short):
        firsts = np.cumsum(per_text) - per_text
        for t in short:
            own = words[firsts[t]: firsts[t] + per_text[t]]
            hashes.append(mix((own * base[: len(own)]).sum(keepdims=True) + np.uint64(len(own))))
            owners.append(np.array([t]))
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(column: pa.Array, limit: int = 250_000) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    data, offsets = utf8_parts(column)
    for a, b in spans_of(offsets, limit):
        hashes, owner = shingle_hashes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(b - a + 1))
        hashes = hashes[order]
        for i in range(b - a):
            yield np.unique(hashes[ends[i]: ends[i + 1]])


class MinHash:
    """``size`` coordinates: minima of multiplied and shifted hashes."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 2 ** 63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(values), 2048):
            product = values[a: a + 2048, None] * self.factors
            product ^= product >> np.uint64(29)
            out = np.minimum(out, ((product * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32).min(axis=0))
        return out


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature): set_hash names the shingle set; null without shingles."""
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        coordinate = held(("minhash", size), lambda: MinHash(size))
        for batch in small_batches(batches, 1):
            count, name, signature = [], [], []
            for own in shingle_sets(batch.column(1)):
                count.append(len(own))
                name.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signature.append(coordinate(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(name, pa.binary()), pa.array(signature, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "signature"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_hash binary, signature binary")


def codes(classes: DataFrame) -> DataFrame:
    """(rep, code): one row per coordinate; a code holds the coordinate's number and value."""
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).astype(np.int64)
                size = len(flat) // batch.num_rows
                code = flat | (np.tile(np.arange(size), batch.num_rows) << 32)
                rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(code)], names=["rep", "code"])

    return classes.select("rep", "signature").mapInArrow(spread, "rep long, code long")


def postings(classes: DataFrame, size: int, matches: int, frequent: int, most_common: int = 2_000_000) -> DataFrame:
    """(code, rep, number, mask): each class under its size - matches + 1 rarest coordinates.

    Two signatures that agree in ``matches`` coordinates share one of these prefixes under any one order of all codes.
    The order puts codes of more than ``frequent`` classes last, by count, so lists of common passages are skipped
    until a pair already agrees elsewhere. ``mask`` has the bits of the prefix coordinates, ``number`` the coordinate.
    Up to ``most_common`` such codes (32 MB) travel to the tasks as one table; more are joined to the codes.
    """
    prefix = size - matches + 1
    common = saved(codes(classes).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > frequent), "common-codes")
    rows = classes.select("rep", "signature")
    if common.count() <= most_common:  # 16 bytes each travel to every task
        table = np.array(sorted((r["code"], r["n"]) for r in common.toLocalIterator()), np.int64).reshape(-1, 2)
        shared = classes.sparkSession.sparkContext.broadcast(table)
        rows = rows.withColumn("hot", F.lit(None).cast("array<struct<code: long, n: long>>"))
    else:
        hot = codes(classes).join(common, "code").groupBy("rep").agg(F.collect_list(F.struct("code", "n")).alias("hot"))
        rows, shared = rows.join(hot, "rep", "left").select("rep", "signature", "hot"), None

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, numbers, values, masks = [], [], [], []
            table = np.zeros((0, 2), np.int64) if shared is None else shared.value
            for rep, signature, hot_codes in zip(*(c.to_pylist() for c in batch.columns)):
                code = np.frombuffer(signature, np.uint32).astype(np.int64) | (np.arange(size) << 32)
                count = np.zeros(size, np.int64)
                if len(table):
                    at = np.minimum(np.searchsorted(table[:, 0], code), len(table) - 1)
                    count = np.where(table[at, 0] == code, table[at, 1], 0)
                for h in hot_codes or ():
                    count[h["code"] >> 32] = h["n"]
                chosen = np.lexsort((code, count))[:prefix]
                reps.append(np.full(prefix, rep))
                numbers.append(chosen)
                values.append(code[chosen])
                mask = sum(1 << int(c) for c in chosen)
                masks.append(np.full(prefix, mask - (1 << 64) if mask >> 63 else mask))
            if reps:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (values, reps, numbers, masks)],
                    names=["code", "rep", "number", "mask"])

    return rows.mapInArrow(choose, "code long, rep long, number long, mask long")


def agreeing(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least ``matches`` coordinates."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                               for c in ("sa", "sb"))
                keep = pa.array((left == right).sum(axis=1) >= matches)
                yield batch.select(["a", "b"]).filter(keep)

    side = classes.select("rep", "signature")
    both = pairs.join(side.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(
        side.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def shingles_of(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(rep, shingles) of the texts whose rep is in ``needed``; the ids grow with the corpus, so they are never broadcast."""
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            own = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["rep", "shingles"])

    chosen = texts.join(needed.hint("merge"), "rep", "left_semi").select("rep", "text")
    return saved(chosen.mapInArrow(sets, "rep long, shingles binary"), "shingles")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet 100 * intersection >= percent * union. Only texts that occur in a pair are shingled."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in both), percent)
                    for both in zip(batch.column("sa"), batch.column("sb"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    shingled = shingles_of(texts, needed)
    both = pairs.join(shingled.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(
        shingled.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def star_pairs(posted: DataFrame) -> DataFrame:
    """Every member of a posting list with the list's smallest member: linear in the list."""
    heads = posted.groupBy("code").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return posted.join(heads, "code").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def blocks_of(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of posting lists that are in different components so far, dealt to pairs of blocks (code, i, j).

    Lists whose members are all in one component need nothing more. Others are cut into blocks of about 256 members,
    and every two blocks meet in a task of their own, so no list is gathered whole.
    """
    own = posted.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = own.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where(
        "_lo <> _hi").select("code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = own.join(mixed, "code").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "label", "number",
        "mask")


def meeting_pairs(table: pa.Table, i: int, j: int, matches: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) of two blocks with different labels and agreeing signatures, in the list of the pair's first
    shared coordinate only."""
    rep, label, block, mask = (table.column(c).to_numpy() for c in ("rep", "label", "block", "mask"))
    number = table.column("number")[0].as_py()
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(rep), -1)
    coordinate = np.arange(signature.shape[1])
    right = np.flatnonzero(block == j)
    for row in np.flatnonzero(block == i):
        agree = signature[right] == signature[row]
        good = (agree.sum(axis=1) >= matches) & (label[right] != label[row])
        if i == j:
            good &= rep[right] > rep[row]
        if good.any():
            both = (mask[right[good]] & mask[row])[:, None] >> coordinate & 1
            earlier = (agree[good] & (both == 1))[:, :number].any(axis=1)
            if not earlier.all():
                yield row, right[good][~earlier]


def remaining_links(posted: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (a, b) between components that the stars have left apart.

    Signatures tell first which members of two blocks meet anyone; only those come again with their full sets. Inside a
    block pair a link joins its two components, so links stay fewer than members however many pairs are similar.
    """
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        rows: set[int] = set()
        for row, others in meeting_pairs(table, key[1].as_py(), key[2].as_py(), matches):
            rows.add(int(row))
            rows.update(others.tolist())
        return table.select(names).take(pa.array(sorted(rows), pa.int64()))

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")]
        rep, parent = table.column("rep").to_pylist(), {}

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        label, links = table.column("label").to_pylist(), []
        for row, others in meeting_pairs(table, key[1].as_py(), key[2].as_py(), matches):
            for other in others.tolist():
                a, b = top(label[row]), top(label[other])
                if a != b and similar(sets[row], sets[other], percent):
                    parent[a] = b
                    links.append((rep[row], rep[other]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    names = ["code", "i", "j", "block", "rep", "label", "number", "mask"]
    sign = classes.select("rep", "signature")
    met = saved(blocks_of(posted, labels).join(sign, "rep").groupBy("code", "i", "j").applyInArrow(
        meet, "code long, i int, j int, block int, rep long, label long, number long, mask long"), "met")
    sets = shingles_of(texts, met.select("rep").distinct())
    return met.join(sign, "rep").join(sets, "rep").groupBy("code", "i", "j").applyInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 64, matches: int = 33, frequent: int = 24,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Documents with one shingle set are one class. Classes are posted under signature coordinates; a list first links its
    members to its smallest one, then compares what is still in different components. Every link is confirmed on full
    sets. ``matches`` of ``size`` coordinates is 4.5 standard deviations below the expectation at the threshold:
    about 1 in 69,000 pairs just at the threshold is missed.

    Null, empty or blank text has no shingles and is linked with nothing. Rows that repeat an id are one document with
    several texts: they count as linked, and each row is returned. Null ids form one such document. An empty table
    gives no row; other columns are ignored.
    """
    members = saved(signatures(docs, size, id_col, text_col), "signatures")
    null_safe = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = members.withColumn("doc", null_safe)
    classes = saved(rows.where("set_hash is not null").groupBy("set_hash").agg(
        F.min("doc").alias("rep"), F.min_by("signature", "doc").alias("signature")), "classes")
    # two sets can share a smallest id only where ids repeat: the smallest name then stands for the id
    named = rows.where("set_hash is not null").select("doc", "set_hash").join(
        classes.select("set_hash", F.col("rep").alias("_rep")), "set_hash")
    alone = classes.groupBy("rep").agg(F.min_by("signature", "set_hash").alias("signature"), F.min("set_hash").alias("set_hash"))
    ids = named.where("doc <> _rep").select(F.col("_rep").alias("a"), F.col("doc").alias("b")).distinct()
    texts = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63))).alias("rep"), col(text_col).cast("string").alias("text"))
    posted = saved(postings(alone, size, matches, frequent), "postings")
    posted = posted.join(posted.groupBy("code").count().where("count > 1").select("code"), "code", "left_semi")

    star = saved(agreeing(star_pairs(posted), alone, matches), "star")
    first = saved(confirmed(star, texts, percent), "links-star")
    labels = smallest_reachable(first)
    rest = saved(remaining_links(posted, alone, labels, texts, matches, percent), "links-rest")
    whole = smallest_reachable(first.unionByName(rest).unionByName(ids))
    out = rows.join(whole.withColumnRenamed("rep", "doc"), "doc", "left").withColumn("component", F.coalesce("label", "doc"))
    nullable = F.when(F.col("component") != -(1 << 63), F.col("component"))
    return out.select("doc_id", "n_shingles", nullable.alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
