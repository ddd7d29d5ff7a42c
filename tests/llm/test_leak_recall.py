import random

import pytest

from augury.llm.leaks import benchmark_leaks, edit_distance, plain


@pytest.mark.parametrize("share", [0.10, 0.12, 0.15])
def test_no_passage_is_missed(spark, make, share):
    rng = random.Random(int(share * 100))
    words = ["".join(rng.choice("etaoinshrü") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, plain(prose(rng.choice([3, 9, 16, 45, 80])))) for i in range(30)] + [(30, "abcdefgh"), (31, "some words")]
    rows = []
    for i in range(160):
        letters = list(bench[i % 32][1])
        edits = int(len(letters) * share)
        places = sorted(rng.sample(range(len(letters)), edits), reverse=True) if i % 2 else [int((e + 0.5) * len(letters) / edits) for e in range(edits)][::-1]
        for at in places:  # at random and evenly spaced
            letters[at: at + 1] = rng.choice([[], ["x"], [letters[at], "z"]])
        rows.append((i, prose(rng.randrange(0, 60)) + " " + "".join(letters) + " " + prose(rng.randrange(0, 60))))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"]: x["distance"] for x in r["leaks"]} for r in benchmark_leaks(make(rows), items).collect()}
    want = {}
    for d, t in rows:  # every item against every whole text
        all_ = {i: edit_distance(u, plain(t), int(0.15 * len(u))) for i, u in bench}
        want[d] = {i: e for i, e in all_.items() if e <= int(0.15 * len(dict(bench)[i]))}
    assert got == want and sum(i % 32 in want[i] for i in range(160)) > 150
