"""From raw documents to packed token sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm import language, leaks, neardup, packing, private
from augury.llm.common import col, saved
from augury.llm.queries import tokenizer_path

KEY = "surrogates-1"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language profiles from the labelled documents; documents that have no language (no letter at all) go.

    Without any labelled document there is no profile, and texts with a letter stay."""
    model = language.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model, lang_out="_found", score_out="_score")
    return found.where(F.col("_found") != language.UNDETERMINED).select(*map(col, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays. Rows that repeat an id stay or go together."""
    kept = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.benchmark_leaks(docs, items, out="_leaks").where(F.size("_leaks") == 0).select(*map(col, docs.columns))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data and secrets; ``n_chars`` follows the new text."""
    found = private.replace_private(docs, KEY, count_out="_replaced", kinds_out="_kinds")
    changed = F.when(F.col("_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*map(col, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 4096."""
    pieces = packing.token_pieces(docs, tokenizer_path(), 4096, 1)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 4096)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("leaks", drop_leaks),
          ("private", replace_private), ("packing", pack_sequences)]

#: Tokens, signatures and edit distances have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
