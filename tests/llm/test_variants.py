import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL

from augury.llm import variants
from augury.llm.queries import QUERIES


def brute_counts(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute_forms(count):
    by_gap = {}
    for w in count:
        for i in range(len(w) + 1):
            by_gap.setdefault((w[:i], w[i:]), set()).add(w)
            if i < len(w):
                by_gap.setdefault((w[:i], w[i + 1:], "r"), set()).add(w)
    near = {w: set() for w in count}
    for w in count:
        for i in range(len(w)):
            near[w] |= by_gap[w[:i], w[i + 1:], "r"] | by_gap.get((w[:i], w[i + 1:]), set())
        near[w].discard(w)
    for w in list(near):
        for o in near[w]:
            near[o].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (count[w], form[w], root, len(near[w]), count[form[w]] if form[w] else None)
    return out


def forms(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in rows}


def test_one_edit():
    assert variants.one_edit("abcdef", "abcde") and variants.one_edit("abcdef", "abXdef") and variants.one_edit("abc", "xabc")
    assert not variants.one_edit("abc", "abc") and not variants.one_edit("abcd", "ab") and not variants.one_edit("abcd", "abdc")
    assert variants.one_edit("aaa", "aa") and not variants.one_edit("abcx", "abyz")


@pytest.mark.parametrize("shape", [{}, {"most": 3}, {"groups": 3, "top": 1, "most": 2}, {"groups": 2, "top": 2, "most": 1}])
def test_forms_equal_brute_force(spark, shape):
    """Small nodes, split leaves and short tries find the same pairs."""
    random.seed(5)
    count = {}
    while len(count) < 600:
        word = "".join(random.choice("abcé") for _ in range(random.randint(6, 8)))
        count[word] = random.choice([5, 6, 25, 30, 125, 700, 700])
    words = spark.createDataFrame([*count.items(), (None, 9)], "word string, n long").repartition(4)
    assert forms(variants.variant_forms(words, **shape)) == brute_forms(count)


def test_counts_equal_brute_force(spark, make):
    texts = ["Straße straÞe÷x " * 9, "ABCDEFG abcdefg, Abcdefg\U0001F600abcdefg日abcdefg", "", None, "x" * 70_000, "Éa" * 5000]
    rows = [(i % 5, t) for i, t in enumerate(texts * 40)] + [(None, "nothing nothing nothing nothing nothing")]
    got = {r["word"]: r["n"] for r in variants.word_counts(make(rows), most_held=2).collect()}
    assert got == brute_counts(rows) and len(got) > 4


def test_planted_misspellings_are_counted(spark, make):
    rows = [(i, "frequency") for i in range(4000)]
    got = {r["word"]: r["n"] for r in variants.word_counts(make(rows), least_count=1).collect()}
    want = Counter()
    for i, w in rows:
        h = zlib.crc32(f"{i}:{w}".encode())
        want[w if h % 199 else w[:h % 9] + w[h % 9 + 1:]] += 1
    assert got == want
    assert len(got) > 3


def test_no_rows(spark, make):
    assert variants.variant_forms(variants.word_counts(make([(1, "a"), (2, None)]))).count() == 0
    with pytest.raises(ValueError):
        variants.variant_forms(spark.createDataFrame([("abcdef", 5)], "word string, n long"), ratio=1)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert forms(QUERIES["op12_variants"](spark, SMALL)) == brute_forms(brute_counts(docs))
