"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ranked
from .common import col


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows to ``shards`` contiguous runs of the id order with nearly equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1. Rows are range partitioned by id, every partition adds up its
    sizes, and the running totals of the partitions turn local sums into global ones. A row belongs to the shard in
    which the middle of its bytes falls, so a shard is off by at most half of its two border rows. Only ids, sizes and
    checksums are shuffled, never texts.

    Null text has size 1 and the checksum of no bytes. Null ids come first; rows with equal ids are ordered by size,
    then checksum, and repeated rows take neighbouring slots. An empty table gives an empty result. Columns besides
    the two named ones are ignored, so their names cannot clash.
    """
    rows = docs.select(
        col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = ranked(rows, [], [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")],
                    rank="_rank", sums={"_end": "size"})
    totals = placed.groupBy().agg(F.max("_end").alias("_total"))
    # doubled sizes keep the middle a whole number
    middle = F.col("_end") * 2 - F.col("size")
    dealt = placed.join(F.broadcast(totals)).withColumn(
        "shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / (F.col("_total") * 2))).cast("int"))
    firsts = dealt.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return dealt.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).cast("long").alias("slot"))
