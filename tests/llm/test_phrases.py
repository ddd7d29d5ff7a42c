import random

import pytest
from conftest import FOLDER

from augury.llm import phrases
from augury.llm.queries import QUERIES


def names_of(text):
    import numpy as np
    names, owner, found = phrases.mix(np.array([ord(c) for c in text], np.uint64) + np.uint64(1)), np.zeros(len(text), int), []
    for level in (1, 2, 3):
        names, owner = phrases.phrases(names, owner, level)
        found.append(set(names.tolist()))
    return found


def test_equal_substrings_share_interior_phrases_at_any_offset():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    shared = " ".join(rng.choice(words) for _ in range(200))
    for lead in range(7):
        left, right = names_of("x" * lead + "q" + shared), names_of("completely " * lead + "other " + shared + " tail")
        for a, b in zip(left, right):
            assert len(a & b) > 0.8 * len(a) - 12


def test_likeness_estimates_the_share_in_common():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(700))
    other = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(700))
    near = lambda a, b: phrases.likeness(*phrases.sketches([a, b]))
    assert near(text, text) == 1.0 and near("", "") == 1.0 and near(text, "") == 0.0 and near("ab", "ab") == 1.0
    assert near(text, other) < 0.15
    for share in (0.25, 0.5, 0.75):
        cut = int(len(text) * share)
        assert abs(near(text, text[:cut] + other[cut:]) - share) < 0.2


@pytest.mark.parametrize("block", [50, 10_000_000])
def test_edited_texts_and_next_documents(make, block):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(1, 60)] + [(500, "é日本\U0001F600x"), (501, None), (None, "null id"), (30, "twice"), (77, "s" * 3000)]
    got = phrases.compared_with_edits(make(rows), block_bytes=block).collect()
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        u = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        want.append((d, len(t), t[: len(t) - half] + u[:half]))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["n_chars"], r["edited"]) for r in got) == sorted(want)


def test_one_row_no_row_and_query(spark, make):
    one = phrases.compared_with_edits(make([(1, "alone here")])).collect()
    assert [(r["edited"], r["near_next"]) for r in one] == [("alonealone", 1.0)] or one[0]["edited"] == "alone" + "alone"
    assert phrases.compared_with_edits(make([(1, "a")]).where("doc_id > 1")).collect() == []
    got = QUERIES["op1_fingerprints"](spark, FOLDER).toPandas()
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > 0.35 and got.near_next.mean() < 0.1
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").toPandas().merge(got, on="doc_id")
    assert (texts.groupby("text").fingerprint.nunique() == 1).all()


def test_fingerprint_column(make):
    got = {r["doc_id"]: r["fingerprint"] for r in phrases.with_fingerprints(make([(1, "same"), (2, "same"), (3, None), (4, "")])).collect()}
    assert got[1] == got[2] != got[3] and got[3] == got[4] == ""
