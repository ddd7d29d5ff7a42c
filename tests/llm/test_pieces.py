import hashlib
import random

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from augury.llm import sentencepieces
from augury.llm.queries import QUERIES, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.PieceEncoder(MODEL, words=1000, pairs=5000)


def test_hard_texts_equal_the_library(encoder):
    random.seed(7)
    pieces = sorted(encoder.ids)
    makers = [lambda: "".join(random.choice(pieces) for _ in range(10)).replace("▁", " "),
              lambda: "".join(random.choice("aeinst ") for _ in range(60)),
              lambda: "".join(random.choice("ab\n\t\r  e.é日本語\U0001F600▁\x00") for _ in range(40)),
              lambda: " " * random.randint(0, 70) + random.choice(pieces) + random.choice(["<s>", "<0x0A>", "<unk>"]) + " " * 33,
              lambda: (p := random.choice(pieces)) + p[1:] + p[:-1] + p * 2]
    for k in range(4000):
        text = makers[k % len(makers)]()
        assert encoder.encode(text) == encoder.model.encode(text), repr(text)


def test_long_texts_without_blanks(encoder):
    for text in ("a" * 20_000, "ab" * 9_999, "the" * 5_000, "日本" * 5_000, " " * 5_001, "\n" * 999, "xyzzy1" * 3_000):
        assert encoder.encode(text) == encoder.model.encode(text)


def test_positions_are_tried_again_after_a_dead_end(encoder):
    """Plain merging and backtracking agree where the longest piece must be given up."""
    random.seed(3)
    given_up = 0
    for _ in range(3000):
        text = "".join(random.choice("erstina") for _ in range(12))
        got = encoder.stretch(text)
        assert got == encoder.merged(text)
        given_up += len(got[0]) < max(len(p) for p in encoder.ids if text.startswith(p))
    assert given_up > 50


def test_nulls_copies_and_clashing_names(spark, make):
    rows = make([(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x\U0001F600")]).withColumnRenamed("n", "a.b")
    coded = sentencepieces.encode_pieces(rows, MODEL)
    assert coded.columns == [*rows.columns, "ids"]
    read = sentencepieces.decode_pieces(coded, MODEL).select("doc_id", "text", "ids", "decoded", "`a.b`").collect()
    assert len(read) == 5 and all(r["decoded"] == (r["text"] or "") and r["a.b"] == "v" for r in read)
    assert all(r["ids"] == [] for r in read if not r["text"])
    assert sentencepieces.encode_pieces(rows.where("doc_id > 9"), MODEL).count() == 0
    with pytest.raises(ValueError):
        sentencepieces.encode_pieces(coded, MODEL)


def test_query_equals_the_library(spark, encoder):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_pieces"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = encoder.model.encode(text)
        assert got[doc] == (len(ids), sha(",".join(map(str, ids))), sha(encoder.model.decode(ids)))
