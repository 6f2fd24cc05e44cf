"""Single-pass leader clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.runtime import materialize

BLOCK_ROWS = 4_096
#: Leaders that one pass over all rows compares them with, in bytes.
PASS_BYTES = 64_000_000


def unit_vectors(df: DataFrame) -> DataFrame:
    """(id, u): vectors at length one as binary doubles; null if null, empty, zero or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.asarray(v if v is not None else [], dtype=np.float64)
                n = np.linalg.norm(x)
                out.append((x / n).tobytes() if 0 < n < np.inf else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "u"])

    return df.mapInArrow(run, "id long, u binary")


def _by_length(units: list[bytes | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the positions and the matrix of its vectors."""
    where: dict[int, list[int]] = {}
    for k, u in enumerate(units):
        if u is not None:
            where.setdefault(len(u), []).append(k)
    return {n: (np.array(at), np.frombuffer(b"".join(units[k] for k in at)).reshape(len(at), -1)) for n, at in where.items()}


def _leaders(ids: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The leaders among rows of one length in order of id, none of which is like an earlier leader."""
    kept, n = np.empty_like(x), 0
    chosen = []
    for k, v in enumerate(x):
        if not n or (kept[:n] @ v).max() < threshold:
            kept[n] = v
            n += 1
            chosen.append(k)
    return ids[chosen], kept[:n].copy()


def leader_clusters(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.55, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, leader): in order of id each vector joins the most similar leader so far, if their cosine reaches
    the threshold, else it leads a new cluster.

    The result is that of one pass over everything. Leaders are found first: the earliest block_rows rows
    that no leader is like are gone through in order, and all later rows like one of the new leaders leave;
    so there are as many rounds as such rows have blocks. Then each row is compared with the leaders up to
    its id. Vectors that are null, empty or zero lead clusters of their own."""
    rows = unit_vectors(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")).persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    found: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    rest = rows.where("u is not null")
    while True:
        block = rest.orderBy("id").limit(block_rows).toArrow()
        if not block.num_rows:
            break
        ids = np.asarray(block.column(0))
        new = {n: _leaders(ids[at], x, threshold) for n, (at, x) in _by_length(block.column(1).to_pylist()).items()}
        found.append(new)
        if block.num_rows < block_rows:
            break
        rest = materialize(_unlike(rest.where(F.col("id") > int(ids[-1])), spark.sparkContext.broadcast(new), threshold))
    passes, size = [[]], 0
    for new in found:
        more = sum(x.nbytes for _, x in new.values())
        if passes[-1] and size + more > PASS_BYTES:
            passes.append([])
            size = 0
        passes[-1].append(new)
        size += more
    joined = None
    for p in passes:
        one = _nearest(rows, spark.sparkContext.broadcast(p), threshold)
        joined = one if joined is None else joined.union(one)
    if len(passes) > 1:  # equal cosines: the earlier leader
        joined = joined.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("leader")).alias("back"))).alias("best")).select("id", (-F.col("best.back")).alias("leader"))
    return joined.select("id", F.coalesce("leader", "id").alias("leader"))


def _unlike(rows: DataFrame, shared, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for n, (at, x) in _by_length(b.column(1).to_pylist()).items():
                if n in shared.value:
                    for a in range(0, len(at), 512):
                        keep[at[a : a + 512]] = (x[a : a + 512] @ shared.value[n][1].T).max(axis=1) < threshold
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, "id long, u binary")


def _nearest(rows: DataFrame, shared, threshold: float) -> DataFrame:
    """(id, cosine, leader): the most similar leader of at least the threshold up to the row's id; null if none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            best, leader = np.full(len(ids), -2.0), np.zeros(len(ids), np.int64)
            for n, (at, x) in _by_length(b.column(1).to_pylist()).items():
                for new in shared.value:
                    if n not in new:
                        continue
                    lid, lx = new[n]
                    for a in range(0, len(at), 512):
                        mine = at[a : a + 512]
                        s = x[a : a + 512] @ lx.T
                        s[lid[None, :] > ids[mine, None]] = -2
                        k = s.argmax(axis=1)
                        s = s[np.arange(len(mine)), k]
                        better = (s >= threshold) & (s > best[mine])
                        best[mine[better]], leader[mine[better]] = s[better], lid[k[better]]
            none = best < -1.5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, mask=none), pa.array(leader, mask=none)], names=["id", "cosine", "leader"])

    return rows.mapInArrow(run, "id long, cosine double, leader long")
