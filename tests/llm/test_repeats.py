import random

import numpy as np
import pytest

from augury.llm import repeats
from augury.llm.suffixes import common_prefixes, repeated_windows, suffix_order


def brute(rows):
    seen, out = set(), []
    for doc, text in sorted({(d if d is not None else -(1 << 63), t or "") for d, t in rows}, key=lambda r: r[0]):
        data = text.encode()
        hit = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                hit[i:i + 100] = b"\1" * 100
            seen.add(data[i:i + 100])
        out.append((doc, len(data), sum(hit), (b"\0" + bytes(hit)).count(b"\0\1"), bytes(b for b, h in zip(data, hit) if not h)))
    return out


def result(frame):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in frame.collect())


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefé \n") for _ in range(n))
    passage, line = make(400), make(70)
    rows = [(i, make(rng.randrange(0, 300)) + rng.choice([passage, line, passage[50:170], passage[:99], ""]) + make(rng.randrange(0, 300))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "a" * 250), (102, "a" * 100), (103, "a" * 99), (104, None), (105, ""), (106, passage), (107, passage), (108, passage[:100]),
             (109, "x" + "ab" * 80), (None, passage[100:300]), (110, make(100) * 3), (111, "\0" * 300), (112, "\0" * 120 + "b")]
    return rows


@pytest.mark.parametrize("frequent", [20_000, 2])
def test_against_brute_force(make, frequent):
    rows = corpus(frequent)
    assert result(repeats.remove_repeats(make(rows), frequent=frequent)) == brute(rows)


def test_long_texts_in_chunks_and_small_blocks(make, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 150)
    monkeypatch.setattr(repeats, "SLICE", 400)
    rows = corpus(9)
    docs = make(rows)
    assert result(repeats.remove_repeats(docs)) == brute(rows)


def test_repeated_rows_and_empty_table(make):
    text = "some words that go on " * 9
    got = repeats.remove_repeats(make([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in got) == [(1, False), (1, False), (2, True)]
    assert repeats.remove_repeats(make([(1, text)]).where("doc_id > 1")).collect() == []


def test_two_stage_order_is_the_order_of_windows():
    rng = random.Random(1)
    entries = [bytes(rng.choice(b"ab\0c") for _ in range(100 + rng.randrange(0, 80))) for _ in range(40)]
    entries += [entries[0], b"a" * 180, b"a" * 150 + b"b" * 10, b"ab" * 70]
    windows = np.array([len(e) - 99 for e in entries])
    begin = np.cumsum([0] + [len(e) + 104 for e in entries])[:-1]
    text = np.frombuffer(b"".join(e + bytes(104) for e in entries), np.uint8)
    order = suffix_order(text, begin, windows)
    assert len(order) == windows.sum() == len(set(order.tolist()))
    strings = [text[i:i + 100].tobytes() for i in order]
    assert strings == sorted(strings)
    assert ((common_prefixes(text, order) == 100)[1:] == [a == b for a, b in zip(strings, strings[1:])]).all()
    seen, want = set(), []
    for e in entries:
        for i in range(len(e) - 99):
            want.append(e[i:i + 100] in seen)
            seen.add(e[i:i + 100])
    assert np.concatenate(repeated_windows(entries, windows, np.arange(len(entries)) << 34)).tolist() == want


def test_sorted_repeats_in_several_blocks_of_one_part(spark):
    rng = random.Random(2)
    base = bytes(rng.choice(b"abcd") for _ in range(100))
    rows = [(7, i, (((0 << 34 | 5) << 7) << 7) | 1, base if i % 3 else bytes([65 + i % 26]) + base[1:]) for i in range(200)]
    cut = spark.createDataFrame(rows, "part long, doc long, place long, bytes binary")
    got = {r["doc"] for r in repeats.sorted_repeats(cut, block_bytes=1500).collect()}
    seen, want = set(), set()
    for _, doc, _, data in rows:
        want |= {doc} if data in seen else set()
        seen.add(data)
    assert got == want
