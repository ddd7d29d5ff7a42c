"""Helpers shared by the text operators: column picking, saved tables, Arrow access, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared_folder

#: Odd constants of the 64-bit finaliser used for every hash below (fixed values).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def col(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], base: str) -> str:
    """A column name that none of ``taken`` clashes with."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: lineage is cut and any executor can read it.

    The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    drop_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


_HELD: dict = {}


def held(name, make):
    """One large helper per worker process at a time: asking for another lets the last one go."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling of an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and n + 1 offsets into them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def spans_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``limit`` bytes (one row at least), so that work arrays stay small."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, min(last, len(offsets) - 1))
        yield first, last
        first = last


def small_batches(batches: Iterable[pa.RecordBatch], at: int, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``limit`` bytes in the string column ``at`` (one row at least).

    A worker's memory then follows the slice, not the session's batch size, and what it returns goes out in small parts.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in spans_of(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), limit):
            yield batch.slice(a, b - a)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
