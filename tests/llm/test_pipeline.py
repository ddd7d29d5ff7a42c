import zlib

from conftest import FOLDER

import corpus_pipeline
from augury.llm.common import saved
from augury.llm.leaks import plain
from test_neardup import brute


def test_stages_keep_what_is_clean_and_their_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    frames, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = frames[name] = saved(stage(spark, now, FOLDER), f"test-{name}")
    columns = docs.columns
    assert all(frames[n].columns == columns for n in ("language", "near_duplicates", "leaks", "private"))
    ids = {n: {r["doc_id"] for r in f.select("doc_id").collect()} for n, f in frames.items()}
    assert ids["language"] == {d for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    components = brute([(d, texts[d]) for d in ids["language"]])
    assert ids["near_duplicates"] == {d for d, (_, c) in components.items() if c == d}
    items = [plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids["leaks"] == {d for d in ids["near_duplicates"] if not any(i in plain(texts[d]) for i in items)}
    changed = {r["doc_id"]: r for r in frames["private"].collect()}
    assert ids["private"] == ids["leaks"] == ids["packing"]
    assert all(r["n_chars"] == len(r["text"]) for r in changed.values())
    assert 0 < sum(r["text"] != texts[d] for d, r in changed.items()) < len(changed) / 2
    filled = {}
    for r in sorted(frames["packing"].collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096 and zlib.crc32(b"") == 0


def test_rejected_documents_go(spark):
    docs = spark.createDataFrame([(1, "the one and the other", "en", "s", 21), (2, None, "en", "s", 0), (3, "12 34", None, "s", 5)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, FOLDER).collect()] == [1]


def test_unlabelled_documents_with_letters_stay(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "words", None, "s", 5), (2, "12 %", None, "s", 4), (3, None, None, "s", 0), (4, "é", None, "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]
