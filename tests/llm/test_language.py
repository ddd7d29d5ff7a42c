import numpy as np
from conftest import SMALL

from augury.llm import language
from augury.llm.queries import QUERIES


def brute(text, size):
    import collections
    low = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in low:
        low = low.replace("  ", " ")
    grams = collections.Counter(low[i:i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1) if low[i:i + n] != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_counts_match_brute_force():
    texts = ["Ab ab, ba!", "", "123 ..", "Ünï ñ ñ ß \U0001F600 日本", "x" * 50]
    doc, gram, n = language.gram_counts(texts, np.arange(len(texts)))
    for i, text in enumerate(texts):
        own = sorted(zip(-n[doc == i], gram[doc == i]))
        assert [int(g) for _, g in own][:20] == [g for g in brute(text, 20) if g != 32 and g != (32 << 21 | 32)]


def test_prediction_is_the_nearest_profile(spark, make):
    rows = [("the one and the other and the", "en"), ("der die das und der die", "de"), ("the and", None), (None, "fr")]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(labelled, profile_size=30)
    assert model.langs == ["de", "en"]
    docs = [(1, "and the one"), (2, "das und die"), (3, None), (4, "12 %"), (5, ""), (None, "and the one"), (1, "and the one")]
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language.identify(make(docs), model).collect()}
    assert got[1, "and the one"][0] == "en" and got[2, "das und die"][0] == "de"
    assert got[3, None] == got[4, "12 %"] == got[5, ""] == ("und", 0.0)
    for text in ("and the one", "das und die"):
        own = brute(text, 30)
        far = {}
        for lang, source in (("en", rows[0][0]), ("de", rows[1][0])):
            place = {g: i for i, g in enumerate(brute(source, 30))}
            far[lang] = sum(abs(place[g] - i) if g in place else 30 for i, g in enumerate(own))
        best = min(far, key=lambda k: (far[k], k))
        found = next(v for k, v in got.items() if k[1] == text)
        assert found[0] == best and abs(found[1] - (1 - far[best] / (30 * len(own)))) < 1e-12


def test_no_labels_and_no_rows(spark, make):
    model = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert [r["lang_pred"] for r in language.identify(make([(1, "word")]), model).collect()] == ["und"]
    assert language.identify(make([(1, "word")]).where("doc_id > 1"), model).count() == 0


def test_held_out_accuracy(spark):
    got = QUERIES["op9_language"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    right, n = got.where("held_out").selectExpr("avg(cast(lang = lang_pred as double))", "count(*)").first()
    assert n > 200 and right > 0.98
