"""Folding of every Unicode code point against the rule it stands for."""

import sys
import unicodedata

from pyspark.sql import functions as F

from augury.functions import text


def test_every_code_point(spark):
    codes = spark.range(1, sys.maxunicode + 1).where("id not between 55296 and 57343").select(
        F.col("id"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = codes.select("id", text.ascii_fold(F.col("c")).alias("f")).where("f <> ''")
    want = {}
    for code in range(1, sys.maxunicode + 1):
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if folded and not 0xD800 <= code <= 0xDFFF:
            want[code] = folded
    assert {r["id"]: r["f"] for r in got.collect()} == want


def test_mixed_texts(spark):
    samples = ["Real Sociedad ½ ﬁnal", "𝐁𝐚𝐫𝐜𝐞𝐥𝐨𝐧𝐚", "①②⑳ FC", "İstanbul ⑽ ㎞", "", None, "東京 ＦＣ"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r["f"] for r in rows.select("i", text.ascii_fold(F.col("s")).alias("f")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == (None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())
