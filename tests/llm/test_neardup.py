import random
import re

import numpy as np
import pyarrow as pa
import pytest

from augury.llm.components import smallest_reachable
from augury.llm.neardup import near_duplicates, shingle_sets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) >= 5:
        return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    group = {d: d for d, _ in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                group[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (len(s), top(d)) for d, s in sets}


def test_sets_are_exact():
    texts = ["A b\tc  d\x0be", "a B c d e f", "x", "", None, "  ", "É é É", "one two three four", "a a a a a a a", "n\xa0o w\x85x y z t"]
    for text, own in zip(texts, shingle_sets(pa.array(texts))):
        assert len(own) == len(shingles(text)) and (np.diff(own.astype(object)) > 0).all()
    same = list(shingle_sets(pa.array(["A  b c d e", "a b C d\ne"])))
    assert same[0].tolist() == same[1].tolist()


@pytest.mark.parametrize("frequent,most", [(24, 2_000_000), (3, 0)])
def test_components_match_brute_force(make, monkeypatch, frequent, most):
    from augury.llm import neardup
    post = neardup.postings
    monkeypatch.setattr(neardup, "postings", lambda *a: post(*a, most_common=most))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    word = [f"w{i}" for i in range(900)]
    base = [rng.choice(word) for _ in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(90):  # one large group of copies from light to heavy edits
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(word)
        rows.append((400 - i, " ".join(own)))
    passage = " ".join(base[:30])
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(word) for _ in range(rng.randrange(5, 90)))) for i in range(60)]
    rows += [(2000 + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "two words", "x y z u v", "x y z u w", passage, passage])]
    want = brute(rows)
    got = near_duplicates(make(rows), frequent=frequent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_repeated_and_null_ids_and_empty_table(make):
    rows = [(7, "a b c d e"), (7, "f g h i j"), (9, "f g h i j"), (None, "q r s t u"), (3, "q r s t u"), (7, "a b c d e")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_duplicates(make(rows)).collect())
    assert got == [(0, 0), (3, 0), (7, 7), (7, 7), (7, 7), (9, 7)]
    assert near_duplicates(make(rows).where("doc_id > 99")).collect() == []


def test_smallest_reachable(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 95)]
    got = {r["rep"]: r["label"] for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
