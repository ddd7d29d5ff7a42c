"""Sinks: spreadsheet-safe text, partitioned features, prediction tables, archive names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import spreadsheet_safe


def safe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed column order; text cells that a spreadsheet would evaluate get a leading quote; missing columns are empty."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for name in columns:
        cell = F.col(name) if name in types else F.lit("")
        cells.append((spreadsheet_safe(cell) if isinstance(types.get(name), T.StringType) else cell).alias(name))
    return df.select(*cells)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    safe_columns(df, columns).write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    """One folder per sport; rows of a sport are spread over tasks by event so a busy sport is not one file."""
    rows = df.withColumn("updated_at", F.current_timestamp())
    rows.repartition("sport", "game_id").write.mode("overwrite").partitionBy("sport").parquet(path)


def prediction_table(df: DataFrame, keys: list[str], method: str, probability: Column, methods: list[str]) -> DataFrame:
    """One row per event with every method's probability as a column."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(method) == m, probability)).alias(f"p_{m}") for m in methods])


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_folders(df: DataFrame, path: str, folder: str, value: str, tasks: int = 64) -> None:
    """One text file in a folder per value of ``folder``. Files are made by ``tasks`` tasks, which also move their own files
    in place: one task, or the driver renaming folder after folder at the end, would take them one by one."""
    placed = df.select(folder, value).repartition(tasks, folder)
    placed.write.partitionBy(folder).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def archive_name(fetched_at: Column, source: Column, url: Column, suffix: str) -> Column:
    """Landing file name: compact fetch time, source and the first twelve digits of the address digest."""
    stamp = F.regexp_replace(fetched_at, "[-:]", "")
    return F.concat(stamp, F.lit("-"), source, F.lit("-"), F.substring(F.sha2(url, 256), 1, 12), F.lit(suffix))
