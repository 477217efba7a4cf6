"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 4 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
BROADCAST_ROWS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where unset (tests), a new local one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: a folder that the executors of {master} share is needed")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"t-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The DataFrame, stored, as a side to be joined by broadcast where it has at most so many rows (of a few numbers each), else by shuffle: stored
    sides leave skewed keys to adaptive execution, which splits them."""
    stored = materialize(df)
    return F.broadcast(stored) if stored.count() <= rows else stored


def held_out(key: Column, divisor: int, remainder: int) -> Column:
    """crc32 of the key's decimal text, mod divisor, equals remainder; null keys count as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def bounded_sample(df: DataFrame, key: Column, max_rows: int, seed: int) -> DataFrame:
    """About max_rows rows, chosen by a hash of the key: the same rows for the same table, whatever its partitions."""
    rows = df.count()
    if rows <= max_rows:
        return df
    cut = int(max_rows / rows * 2**32)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**32)) < cut)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts take about `most` bytes, one row at least: so that a batch of long texts is never held as Python objects at once."""
    size = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        if end > at:
            yield batch.slice(at, end - at)
    release()


def release() -> None:
    """Give free memory back to the system: a Python worker lives on between tasks, and what it keeps adds to what its executor takes."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def with_columns(df: DataFrame, columns: str, function: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Add columns (a DDL string) that function makes from an Arrow batch (a slice of limited bytes); columns in keep (default: all) pass unchanged.

    A new column replaces an old one of the same name, so that clashing extra columns do no harm.
    """
    added = T.StructType.fromDDL(columns)
    names = set(added.fieldNames())
    old = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType([*old, *added.fields])
    arrow = to_arrow_schema(schema)
    old_names = [f.name for f in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            made = function(batch)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in old_names] + [a if isinstance(a, pa.Array) else pa.array(a, arrow.field(len(old_names) + i).type) for i, a in enumerate(made)]
            yield pa.RecordBatch.from_arrays([a if a.type == t.type else a.cast(t.type) for a, t in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
