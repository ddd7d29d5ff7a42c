"""Spelling variants: word counts of a corpus, words one edit apart, and the chain from a word to its usual form.

Words one edit apart are found in a trie of letter counts. The code points of a word are dealt to groups (code point
modulo the number of groups); the levels of the trie are the counts of group 0, 1, 2 and so on, and a leaf holds the words
with the same counts. One edit changes the counts by one surplus at most and one deficit at most, so a depth-first search
that may spend each once reaches every word one edit away; the words at a leaf are verified.

The upper levels of the trie are Spark's shuffle key. A word waits at its node, the uppermost one at depth ``top`` or more
that holds ``most`` words or fewer, and visits the nodes that its budget reaches; below a node the search goes on in the task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, saved

#: Runs of letters in UTF-8 after lower-casing A to Z: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
GROUPS = 12


def shortened(word: bytes, h: int) -> str:
    """The word without its code point ``h`` modulo its length."""
    text = word.decode()
    at = h % len(text)
    return text[:at] + text[at + 1:]


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, modulus: int = 199,
                id_col: str = "doc_id", text_col: str = "text", most_held: int = 200_000) -> DataFrame:
    """(word, n) of every word of at least ``least_length`` code points that occurs ``least_count`` times or more.

    Runs of letters are lower-cased (A-Z only). Where ``modulus`` divides h, the crc32 of "<id>:<run>", the run loses the
    code point h modulo its length (planted misspellings). A null text has no words; a null id is written as nothing.
    Repeated rows count each time. Tasks add up before the shuffle and hold ``most_held`` words at most.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                             names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                text = text.as_buffer()
                if text is None:
                    continue
                start = zlib.crc32(b":", zlib.crc32(name.as_py().encode() if name.is_valid else b""))
                for word, n in Counter(RUN.findall(text.to_pybytes().lower())).items():
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word, start)
                    run = shortened(word, h) if h % modulus == 0 else word.decode()
                    if len(run) >= least_length:
                        total[run] += n
                if len(total) >= most_held:
                    yield rows()
        yield rows()

    rows = docs.select(col(id_col).cast("string"), col(text_col).cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def counts_of(word: str, groups: int) -> list[int]:
    """How many code points of the word fall into each group."""
    out = [0] * groups
    for c in word:
        out[ord(c) % groups] += 1
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def upper(counts: list[int], depth: int) -> list[int]:
    """Ways into the nodes at ``depth`` that can hold a later word one edit away: nothing spent, or a surplus first.

    A word looks for longer words, and for words of its own length whose counts are the same or greater at the first
    difference; the other words find it. So a surplus comes before any deficit.
    """
    own = counts[:depth]
    yield own
    for i in range(depth):
        more = own[:i] + [own[i] + 1] + own[i + 1:]
        yield more
        for j in range(i + 1, depth):
            if own[j]:
                yield more[:j] + [own[j] - 1] + more[j + 1:]


def key_of(counts: list[int]) -> str:
    return ",".join(map(str, counts))


class Leaf(dict):
    """Many words with the same counts, by half: one edit leaves the first or the last half of the shorter word alone."""

    def put(self, entry: tuple) -> None:
        word = entry[0]
        size = len(word)
        for half in {(size - 1) // 2, size // 2}:
            self.setdefault((size, half, word[:half]), []).append(entry)
            self.setdefault((size, -half, word[size - half:]), []).append(entry)

    def alike(self, word: str) -> dict[str, tuple]:
        size, half = len(word), len(word) // 2
        keys = [(n, h, part) for n in (size, size + 1) for h, part in ((half, word[:half]), (-half, word[size - half:]))]
        return {e[0]: e for key in keys for e in self.get(key, ())}


class Trie:
    """The words of one node by their counts below it. A branch of few words is a list; it grows into a level."""

    def __init__(self, depth: int, groups: int, few: int = 12):
        self.depth, self.groups, self.few = depth, groups, few
        self.root: dict | list = []

    def add(self, word: str, n: int) -> None:
        self.root = self._with(self.root, self.depth, (word, n, counts_of(word, self.groups)))

    def _with(self, at: dict | list, level: int, entry: tuple) -> dict | list:
        if isinstance(at, list):
            at.append(entry)
            if len(at) <= self.few:
                return at
            grown: dict = Leaf() if level == self.groups else {}
            for e in at:
                self._put(grown, level, e)
            return grown
        self._put(at, level, entry)
        return at

    def _put(self, at: dict, level: int, entry: tuple) -> None:
        if isinstance(at, Leaf):
            at.put(entry)
        else:
            c = entry[2][level]
            at[c] = self._with(at.get(c, []), level + 1, entry)

    def near(self, word: str, own: list[int], node: list[int]) -> Iterator[tuple[str, int]]:
        """Words one edit away in this node that come after ``word``: longer, or greater in (counts, word)."""
        spent = [a - b for a, b in zip(node, own)]
        todo = [(self.root, self.depth, 1 not in spent, -1 not in spent)]
        size = len(word)
        first, last = word[:size // 2], word[size - size // 2:]
        while todo:
            at, level, surplus, deficit = todo.pop()
            if isinstance(at, list) or level == self.groups:
                near = at if isinstance(at, list) else at.alike(word).values()
                for other, n, counts in near:
                    if (other.startswith(first) or other.endswith(last)) and one_edit(word, other) and (
                            len(other) > size or (len(other) == size and (counts, other) > (own, word))):
                        yield other, n
                continue
            c = own[level]
            if c in at:
                todo.append((at[c], level + 1, surplus, deficit))
            if surplus:
                if c + 1 in at:
                    todo.append((at[c + 1], level + 1, False, deficit))
            elif deficit and c - 1 in at:
                todo.append((at[c - 1], level + 1, False, False))


def near_words(words: DataFrame, groups: int = GROUPS, top: int = 4, most: int = 50_000) -> DataFrame:
    """(a, na, b, nb): every pair of different words one edit apart, once. ``words`` has distinct ``word`` and ``n``.

    A node of ``most`` words or fewer is one trie in a task. A leaf with more words is split by hash, and visitors go to
    every part, so memory stays bounded and no word is left out. Null words are ignored; an empty table gives no pair.
    """
    spark = words.sparkSession
    rows = words.where("word IS NOT NULL").select("word", "n")
    depths = list(range(top, groups + 1))

    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[key_of(c[:d]) for d in depths] for c in (counts_of(w, groups) for w in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.string()))],
                                             names=["word", "n", "path"])

    path = saved(rows.mapInArrow(paths, "word string, n long, path array<string>"), "variant-paths")
    # How many words there are below each node; the uppermost node that is small enough (or the leaf) is a word's place.
    nodes = path.select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    small = path.select("word", "n", F.posexplode("path").alias("i", "node")).join(nodes, "node").where(
        (F.col("size") <= most) | (F.col("i") == len(depths) - 1))
    placed = small.groupBy("word").agg(F.first("n").alias("n"), F.min_by(F.struct("node", "size", "i"), "i").alias("at"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("at.size") / most)).cast("int")
    places = saved(placed.select("word", "n", F.col("at.node").alias("node"), parts.alias("parts"), F.col("at.i").alias("i")),
                   "variant-places")
    used = sorted(r["i"] for r in places.select("i").distinct().collect())

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, node = [], [], []
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = counts_of(w, groups)
                keys = [key_of(v) for i in used for v in upper(counts, depths[i])]
                word += [w] * len(keys)
                n += [k] * len(keys)
                node += keys
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(node, pa.string())],
                                             names=["word", "n", "node"])

    there = places.groupBy("node").agg(F.max("parts").alias("parts"))
    going = places.select("word", "n").mapInArrow(visits, "word string, n long, node string").join(there, "node")
    part: Column = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    visiting = going.select("word", "n", "node", part, F.lit(1).alias("visits"))
    waiting = places.select("word", "n", "node", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"),
                            F.lit(0).alias("visits"))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, trie, at = None, None, None
        for batch in batches:
            found: list[tuple[str, int, str, int]] = []
            fields = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for (node, number), members in groupby(fields, key=lambda r: (r[2], r[3])):
                if (node, number) != here:
                    here, at = (node, number), [int(c) for c in node.split(",")]
                    trie = Trie(len(at), groups)
                for word, n, _, _, visitor in members:
                    if visitor:
                        found += [(word, n, other, m) for other, m in trie.near(word, counts_of(word, groups), at)]
                    else:
                        trie.add(word, n)
            columns = zip(*found) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["a", "na", "b", "nb"])

    dealt = waiting.unionByName(visiting).repartition("node", "part").sortWithinPartitions("node", "part", "visits")
    return dealt.mapInArrow(search, "a string, na long, b string, nb long")


def variant_forms(words: DataFrame, ratio: int = 5, **trie) -> DataFrame:
    """For every (word, n): its usual form, the root that forms lead to, and how many words are one edit away.

    The form is the near word of largest n (ties: smallest in code-point order), where that n is at least ``ratio`` times
    the word's own; else null. n grows along a chain of forms, so chains end; the root is found by doubling the step.
    """
    spark = words.sparkSession
    pairs = near_words(words, **trie)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("b", "nb"), F.struct(-F.col("nb"), "b")).alias("top"))
    joined = saved(words.where("word IS NOT NULL").select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("top.nb") >= ratio * F.col("n"), F.col("top")).alias("top")), "variant-forms")
    step = joined.where("top IS NOT NULL").select("word", F.col("top.b").alias("root"))
    if ratio > 1:
        step = saved(step, "variant-steps")
        while True:
            nxt = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = saved(step.join(nxt, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-steps")
            step = moved.select("word", "root")
            if not moved.where("moved").limit(1).count():
                break
    else:
        raise ValueError("ratio must be at least 2, or forms could lead in circles")
    return joined.join(step, "word", "left").select(
        "word", "n", F.col("top.b").alias("form"), F.coalesce("root", "word").alias("root"), "n_near",
        F.col("top.nb").alias("form_n"))
