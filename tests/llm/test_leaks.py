import random

from conftest import FOLDER

from augury.llm.leaks import benchmark_leaks, codes, edit_distance, gram_hashes, growing_hashes, plain
from augury.llm.queries import QUERIES


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_hashes_grow_from_size_to_size():
    data = codes("some text, and é more" * 9)
    for size, got in zip([1, 4, 5, 8], growing_hashes(data, [1, 4, 5, 8])):
        assert got.tolist() == gram_hashes(data, size).tolist()
    assert [len(h) for h in growing_hashes(data[:3], [2, 5])] == [2, 0]


def test_a_distance_out_of_reach_ends_the_search():
    class Counted(str):
        read = 0

        def __getitem__(self, at):
            Counted.read += at.stop - at.start
            return str.__getitem__(self, at)

    assert edit_distance("b" * 200, Counted("a" * 260), 30) == 31 and Counted.read < 120
    rng = random.Random(5)
    for _ in range(60):
        item = "".join(rng.choice("ab") for _ in range(rng.randrange(30, 90)))
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) + item[rng.randrange(9):] + "ba" * rng.randrange(30)
        want = brute_distance(item, text)
        assert all(edit_distance(item, text, most) == min(want, most + 1) for most in (0, 2, 5, 20, len(item)))


def test_edit_distance_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        item, text = ("".join(rng.choice("abcé") for _ in range(rng.randrange(1, n))) for n in (70, 90))
        want = brute_distance(item, text)
        assert edit_distance(item, text, len(item)) == want
        assert edit_distance(item, text, 3) == min(want, 4)


def test_copies_and_edits_are_found_and_clean_texts_left(spark, make):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, prose(40)) for i in range(20)] + [(20, None), (21, ""), (22, "short one"), (23, bench_twice := prose(30)), (24, bench_twice)]
    rows, want = [], {}
    for i in range(60):
        item = bench[i % 20][1]
        letters = list(item)
        for _ in range(int(len(item) * rng.choice([0, 0.03, 0.08]))):
            at = rng.randrange(len(letters))
            letters[at: at + 1] = rng.choice([[], [rng.choice("xyz")], [letters[at], "q"]])
        rows.append((i, prose(rng.randrange(0, 60)) + "\n " + "".join(letters).upper() + " " + prose(rng.randrange(0, 60))))
        want[i] = i % 20
    clean = [(100 + i, prose(150)) for i in range(60)] + [(200, None), (201, ""), (202, bench[3][1][:60])]
    special = [(300, "a Short\tONE b"), (301, bench_twice), (None, bench[0][1]), (302, prose(30_000) + bench[1][1])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"]: x["distance"] for x in r["leaks"]} for r in benchmark_leaks(make(rows + clean + special), items).collect()}
    missed = [i for i, item in want.items() if item not in got[i]]
    assert len(missed) <= 3  # recall of the bit sampling at up to 8 % scattered edits
    assert not any(plain(bench[want[i]][1]) in plain(rows[i][1]) for i in missed)
    for i, item in want.items():
        if item in got[i]:
            assert got[i][item] == brute_distance(plain(bench[item][1]), plain(rows[i][1]))
    assert not any(got[d] for d, _ in clean)
    assert got[300] == {22: 0} and got[301] == {23: 0, 24: 0} and got[None] == {0: 0} and got[302] == {1: 0}
    split = benchmark_leaks(make(special), items, part_chars=1000).collect()
    assert {r["doc_id"]: {x["item_id"]: x["distance"] for x in r["leaks"]} for r in split} == {d: got[d] for d, _ in special}
    assert benchmark_leaks(make(rows).where("doc_id > 999"), items).count() == 0
    assert {len(r["leaks"]) for r in benchmark_leaks(make(rows), items.where("item_id > 99")).collect()} == {0}


def test_query_finds_every_exact_copy(spark):
    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, FOLDER).collect()}
    assert {(d, i) for d, t in docs for i, u in items if u in t} <= got
