import struct

import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from augury.llm.packing import OpenBins, WordIds, pack, sequences, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_ids_are_the_ids_of_whole_texts(spark, tokenizer):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(300).collect()]
    texts += ["", "It's we'll a\x1cb c\x85d", "İstanbul ΑΣ Σ. é ́x", "<|endoftext|> a<|endoftext|>b", "1234 !?_x 日本語 🙂👍", "a b\x0bc"]
    texts += ["the's they've ''t I'LL x''s 're're", "Àß ÿ × ÷ ª º µ Öl-Ärger_9é9", "a" * 1500, "\u00e9" * 50 + "!" * 60]
    ids_of = WordIds(PATH, words=50, parts=50)
    ids, at = ids_of.texts(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i]: at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark, make, tokenizer):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word of it " * 60), (4, "same text"), (5, "same text")]
    pieces = token_pieces(make(rows), PATH, max_tokens=16)
    packed = pack(pieces, max_tokens=16, open_bins=4, pieces_per_task=1000)
    got = packed.collect()
    text = {}
    for r in sorted(got, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        if r["doc_id"] in (1, 3, 4):
            assert len(text.setdefault(r["doc_id"], b"")) == 4 * r["start"]
            text[r["doc_id"]] += r["ids"]
    for doc, t in ((1, ""), (3, rows[4][1]), (4, "same text")):
        want = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        assert text[doc] == struct.pack(f"<{len(want)}I", *want)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 16
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in sequences(packed).collect()} == filled
    assert pack(pieces.where("doc_id > 99")).count() == 0


def test_best_fit_and_closing():
    bins = OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (7, 6, 4, 3)] == [(0, 0), (1, 0), (1, 6), (0, 7)]
    bins = OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the bin with 7 of 10 was closed
    assert bins.place(4) == (0, 6)


def test_clashing_names_and_lengths_without_a_place(spark):
    rows = spark.createDataFrame(
        [(1, 4, "old", 7), (2, None, "old", 7), (3, 17, "old", 7), (4, 0, None, 7), (1, 4, "old", 7)],
        "doc_id long, length long, offset string, sequence_id int")
    got = sorted(pack(rows, max_tokens=16).collect(), key=lambda r: r["doc_id"])
    assert got[0].asDict().keys() == {"doc_id", "length", "sequence_id", "offset"}
    assert [r["offset"] is None for r in got] == [False, False, True, True, True]
    assert {r["offset"] for r in got[:2]} == {0, 4}


def naive_best_fit(lengths, size, most):
    """Lists instead of bit sets: the fullest bin with room, else a new one; the fullest closes when too many are open."""
    bins, out, made = [], [], 0
    for n in lengths:
        fitting = [b for b in bins if b[1] + n <= size]
        if fitting:
            chosen = max(fitting, key=lambda b: (b[1], b[2]))
            bins.remove(chosen)
        else:
            if len(bins) >= most:
                bins.remove(max(bins, key=lambda b: (b[1], b[2])))
            chosen = [made, 0, 0]
            made += 1
        out.append((chosen[0], chosen[1]))
        chosen[1] += n
        chosen[2] = len(out)  # of equally full bins, the one filled last is taken
        if chosen[1] < size:
            bins.append(chosen)
    return out


def test_places_against_a_naive_best_fit():
    import random
    draw = random.Random(5)
    for size, most in ((20, 3), (64, 8), (64, 1)):
        lengths = [draw.randint(1, size) for _ in range(2000)]
        bins = OpenBins(size, most, 0)
        assert [bins.place(n) for n in lengths] == naive_best_fit(lengths, size, most)


def test_few_more_sequences_than_the_lower_bound(spark):
    """On the given documents, 2 % above the tokens alone at most."""
    pieces = token_pieces(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH).select("doc_id", "piece", "length")
    packed = pack(pieces, 4096)
    tokens, made = packed.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert made <= 1.02 * -(-tokens // 4096) + 1
