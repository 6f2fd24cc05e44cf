"""Reading and numbering vectors: what the similarity operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.skew import lookup_join
from sediment.runtime import materialize

#: Id lists up to this length are broadcast (a few MB), longer ones are joined by a shuffle.
BROADCAST_IDS = 300_000

DIMENSION = 128


def unit_rows(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(keep, unit): which vectors are usable, that is hold exactly ``dimension`` finite numbers that are
    not all zero, and those vectors at length one as float32."""
    n = len(column)
    lists = column.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(column.type) else column
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1)) if n else np.zeros(0, int)
    keep = lengths == dimension
    flat = lists.filter(pa.array(keep)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(axis=1, initial=0.0) if len(x) else np.zeros(0)
        good = np.isfinite(x).all(axis=1) & (scale > 0)
        x = x[good] / scale[good, None]
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    keep[np.flatnonzero(keep)[~good]] = False
    return keep, unit


def packed(unit: np.ndarray) -> pa.Array:
    """float32 rows as one binary value each."""
    n, d = unit.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * d * 4, d * 4, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(unit, dtype=np.float32).tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """The rows that packed() wrote."""
    if isinstance(column, pa.ChunkedArray):
        parts = [unpacked(c, dimension) for c in column.chunks]
        return np.concatenate(parts) if parts else np.zeros((0, dimension), np.float32)
    if not len(column):
        return np.zeros((0, dimension), np.float32)
    width = pa.int64() if pa.types.is_large_binary(column.type) else pa.int32()
    offsets = np.frombuffer(column.buffers()[1], dtype=width.to_pandas_dtype())
    a, b = offsets[column.offset], offsets[column.offset + len(column)]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[a:b].view(np.float32).reshape(-1, dimension)


def usable(vectors: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(memory_id, vec): the usable vectors at length one, packed. Ids may still be repeated; rows with a
    null id are left out. The column ``dimension`` of the table is not trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, unit = unit_rows(b.column(1), dimension)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), packed(unit)], names=["memory_id", "vec"])

    rows = vectors.where("memory_id is not null").select(F.col("memory_id").cast("long"), "vector")
    return rows.mapInArrow(run, "memory_id long, vec binary")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """df without the rows whose key is in the one column of ids."""
    n = ids.count()
    if not n:
        return df
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_anti")


def one_per_copy(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, copies) of (memory_id, vec, same, ...): of the rows with the same digest the one
    with the smallest id stands for all; copies is (member, root) of the others."""
    firsts = base.groupBy("same").agg(F.min("memory_id").alias("root"), F.max("memory_id").alias("last")).where("root != last").select("same", "root")
    copies = lookup_join(base.select("memory_id", "same"), firsts, "same", "inner").where("memory_id != root")
    copies = materialize(copies.select(F.col("memory_id").alias("member"), "root").distinct())
    return without_ids(base, copies.select(F.col("member").alias("memory_id"))), copies


def one_per_id(base: DataFrame) -> DataFrame:
    """(memory_id, vec, same) without the rows of a repeated id that hold another vector than the one with
    the smallest digest. Equal repeats stay; only ids and digests are shuffled."""
    odd = base.groupBy("memory_id").agg(F.min("same").alias("keep"), F.max("same").alias("most")).where("keep != most").select("memory_id", "keep")
    n = odd.count()
    if not n:
        return base
    known = base.join(F.broadcast(odd) if n <= BROADCAST_IDS else odd, "memory_id", "left")
    return known.where("keep is null or keep = same").drop("keep")
