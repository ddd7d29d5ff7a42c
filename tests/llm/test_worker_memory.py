"""A worker's arrays follow slices of a batch, not the batch: Spark hands over 10,000 rows at a time."""
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from augury.llm import leaks, packing
from augury.llm.common import small_batches
from augury.llm.language import RankModel, identify
from augury.llm.neardup import signatures

LANGS = RankModel([{"lang": lang, "gram": ord(c), "rank": k} for lang, own in (("x", "abc"), ("y", "bcd")) for k, c in enumerate(own)], 400)


class Step:
    """Stands in for a table: gives the function that a worker runs."""
    columns, schema = ["text"], []

    def __init__(self, shared=None):
        self.value = shared

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    words = ["".join(w) for w in rng.choice(list("abcdefghij"), (400, 6))]
    return [" ".join(rng.choice(words, 300)) for _ in range(1500)]  # 3 MB


def batch_of(texts, *first):
    columns = [*first, pa.array(texts)]
    return pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])


def test_slices_hold_every_row_once():
    texts = ["a" * 30, None, "", "b" * 300, "é" * 10, None]
    batch = batch_of(texts, pa.array(range(6)))
    got = list(small_batches([batch.slice(0, 0), batch, batch.slice(3, 2)], 1, 50))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts + texts[3:5]
    assert [i for b in got for i in b.column(0).to_pylist()] == [*range(6), 3, 4]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 50 for b in got)


@pytest.mark.parametrize("step", ["language", "signatures", "leaks", "tokens"])
def test_a_large_batch_needs_little_memory(spark, texts, step):
    ids = pa.array(range(len(texts)))
    if step == "language":
        run, batch = identify(Step(), LANGS, keep=[]), batch_of(texts)
    elif step == "signatures":
        run, batch = signatures(Step(), 64, "doc_id", "text"), batch_of(texts, ids)
    elif step == "leaks":
        run, batch = leaks._scan(Step(), Step(([(1, texts[7][:90])], 0.15)), "text", "out", "string"), batch_of(texts)
    else:
        run, batch = packing.token_pieces(Step(), public_tokenizers.path("word_bpe_49k.json")), batch_of(texts, ids)
    rows = sum(b.num_rows for b in run([batch.slice(0, 20)]))  # what a worker keeps is made before
    assert rows >= 20
    tracemalloc.start()
    rows = sum(b.num_rows for b in run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= len(texts)
    print(step, most >> 20)
    assert most < 30 << 20


def test_words_kept_by_a_worker_are_few():
    ids_of = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert ids_of.words.most + ids_of.parts.most <= 400_000
