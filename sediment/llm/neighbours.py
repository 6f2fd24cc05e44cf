"""Most similar vectors for every vector by a permutation index.

A bounded sample of the vectors serves as pivots. Each vector is represented by its nearest pivots in
order (its permutation) and posted in the inverted files of the first of them. A query looks into the
files of its own first pivots, ranks what it meets by the footrule distance of the permutations and
compares the best with the full vectors. Pivots are drawn from the data, so dense regions have more of
them; files that are long all the same are cut into blocks whose pairs are handled one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.vectors import BROADCAST_IDS, DIMENSION, one_per_copy, one_per_id, packed, unpacked, usable
from sediment.operators.skew import lookup_join
from sediment.runtime import materialize, shuffle_partitions

#: Vectors per pivot, and the limits of their number (8 MB of pivots at most).
PER_PIVOT, FEWEST, MOST = 180, 16, 16_384
#: Pivots kept of each permutation, and inverted files a vector is posted in.
ORDERED, POSTED = 16, 3
#: Of each file the best by footrule are compared with the full vectors: so many, or this share of a longer file.
RERANK, SHARE = 128, 0.25
#: Bytes of vectors that are gathered at once to be compared.
GATHER_BYTES = 16_000_000
#: Bytes of postings in a shuffle partition.
PARTITION_BYTES = 64_000_000
#: Longer inverted files are cut into blocks.
FILE_ROWS = 20_000
#: Cosines are compared after rounding to this many places, so that equal vectors tie.
PLACES = 6
#: Brute force sends out so many queries for a pass over all rows, and compares so many at once with a batch of rows.
PASS_QUERIES, AT_ONCE = 20_000, 256


def pivots_of(base: DataFrame, dimension: int, n: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, expected rows of each one's file): a sample of about n vectors, and as many others, at
    most 8,192, on which the lengths of the files are estimated."""
    m = int(min(most, MOST, max(FEWEST, n // PER_PIVOT)))
    share = min(1.0, 1.2 * (m + min(n, 8_192)) / max(n, 1))
    picked = base.where(F.pmod(F.xxhash64("memory_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("memory_id", "vec")
    rows = picked.limit(2 * (m + 8_192)).toArrow()
    x = unpacked(rows.column("vec"), dimension)
    ids = np.asarray(rows.column("memory_id"))
    _, first = np.unique(ids, return_index=True)
    order = first[np.random.default_rng(5).permutation(len(first))]
    p = x[order[:m]]
    top = first_pivots(x[order], p, min(POSTED, len(p)))
    return p, np.bincount(top.ravel(), minlength=len(p)) * (n / max(len(order), 1))


def first_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k nearest pivots in order, ties by number; a thousand rows at a time, so that memory
    does not grow with rows times pivots."""
    parts = [np.zeros((0, k), np.int64)]
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ pivots.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(s), 1))
        parts.append(np.take_along_axis(top, np.lexsort((top, -np.take_along_axis(s, top, 1)), axis=1), 1))
    return np.concatenate(parts)


def postings(rows: DataFrame, pivots: np.ndarray, lengths: np.ndarray, dimension: int, posted: int = POSTED, asked: int = POSTED, ordered: int = ORDERED, every: int = 1) -> DataFrame:
    """(file, a, b, reads, posts, memory_id, perm, vec): rows (memory_id, query, vec) in the files of their
    first pivots. Every row is posted in ``posted`` files; a query reads the files of its first ``asked`` pivots.
    Queries of a file are cut into blocks a and posted rows into blocks b of about FILE_ROWS, and every pair of
    blocks is a task, so nothing is cut off: a query goes to all blocks of a file, a posted row to all blocks of
    queries (one in ``every`` rows)."""
    blocks = np.maximum(1, np.ceil(lengths / FILE_ROWS)).astype(np.int64)
    askers = np.maximum(1, np.ceil(lengths * (asked / posted / every) / FILE_ROWS)).astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((pivots, blocks, askers))

    def each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows, each repeated n times, and the place of every repeat."""
        at = np.repeat(np.arange(len(n)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n_b, n_a = shared.value
        width = min(max(ordered, posted, asked), len(p))
        for b in batches:
            x = unpacked(b.column(2), dimension)
            if not len(x):
                continue
            top = first_pivots(x, p, width)
            perm = np.full((len(x), ordered), -1, np.int32)
            perm[:, : min(width, ordered)] = top[:, :ordered]
            ids, query = np.asarray(b.column(0)), np.asarray(b.column(1))
            parts = []
            for j in range(width):
                reads, posts = query & (j < asked), j < posted
                row = np.flatnonzero(reads | posts)
                file, r = top[row, j], reads[row]
                mine, home = ids[row] * 40503 % 4294967291 % n_a[file], ids[row] * 2654435761 % 4294967291 % n_b[file]
                at, k = each(np.where(r, n_b[file], 0))  # as a query, in the block of its own also as a row
                parts.append((file[at], mine[at], k, r[at], posts & (k == home[at]), row[at]))
                if posts:
                    at, k = each(n_a[file])
                    own = r[at] & (k == mine[at])
                    at, k = at[~own], k[~own]
                    parts.append((file[at], k, home[at], np.zeros(len(at), bool), np.ones(len(at), bool), row[at]))
            file, qa, db, rd, ps, row = (np.concatenate(v) for v in zip(*parts))
            for at in range(0, len(row), 4096):
                c = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file[c], pa.int64()), pa.array(qa[c], pa.int64()), pa.array(db[c], pa.int64()), pa.array(rd[c]), pa.array(ps[c]), pa.array(ids[row[c]], pa.int64()),
                     packed(perm[row[c]].view(np.float32)), packed(x[row[c]])],
                    names=["file", "a", "b", "reads", "posts", "memory_id", "perm", "vec"],
                )

    return rows.select("memory_id", "query", "vec").mapInArrow(run, "file long, a long, b long, reads boolean, posts boolean, memory_id long, perm binary, vec binary")


def _closeness(perm: np.ndarray, rows: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For rows x data the sum over shared pivots of the smaller of the two weights, where the pivot at
    place i of a permutation of w pivots weighs w - i: the footrule distance is a constant minus twice that."""
    ordered = perm.shape[1]
    out = np.zeros((len(rows), len(data)), np.int16)
    weight = np.tile(np.arange(ordered, 0, -1, dtype=np.int16), (max(len(rows), len(data)), 1))

    def by_pivot(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat, at, w = perm[which].ravel(), np.repeat(np.arange(len(which)), ordered), weight[: len(which)].ravel()
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        return keys, np.append(first, len(order)), at[order], w[order]

    k1, f1, at1, w1 = by_pivot(rows)
    k2, f2, at2, w2 = by_pivot(data)
    both, i1, i2 = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
    for key, i, j in zip(both, i1, i2):
        if key >= 0:
            a, b = slice(f1[i], f1[i + 1]), slice(f2[j], f2[j + 1])
            out[np.ix_(at1[a], at2[b])] += np.minimum(w1[a][:, None], w2[b][None, :])
    return out


def _met_before(perm: np.ndarray, q: np.ndarray, data: np.ndarray, file: int, asked: int, posted: int) -> np.ndarray:
    """Of q x data the pairs that another file, nearer to the query, holds as well."""
    mine = perm[q][:, :asked]
    earlier = np.cumsum(mine == file, axis=1) == 0  # a query's pivots before this one
    out = np.zeros((len(q), len(data)), bool)
    for i in range(mine.shape[1]):
        rows = np.flatnonzero(earlier[:, i] & (mine[:, i] >= 0))
        for j in range(min(posted, perm.shape[1])):
            out[rows] |= mine[rows, i][:, None] == perm[data, j][None, :]
    return out


def _search(t: pa.Table, dimension: int, k: int, floor: float, rerank: int, share: float = 0.0, asked: int = POSTED, posted: int = POSTED, ordered: int = ORDERED) -> pa.Table:
    """(root, near, cosine): of each query of a file the k best rows of the file. The rows are ranked by the
    footrule distance of the permutations alone; only of the best ``rerank`` of them (or ``share`` of the file,
    if that is more; equal distances by smaller id) the vectors are fetched and compared. Pairs that meet in
    several files are ranked in the one nearest to the query."""
    _, first = np.unique(np.asarray(t.column("memory_id")), return_index=True)
    t = t.take(pa.array(first))
    ids = np.asarray(t.column("memory_id"))
    reads, posts = np.asarray(t.column("reads")), np.asarray(t.column("posts"))
    x = unpacked(t.column("vec"), dimension)
    perm = unpacked(t.column("perm"), ordered).view(np.int32)
    file = t.column("file")[0].as_py()
    data = np.flatnonzero(posts)
    found = []
    queries = np.flatnonzero(reads)
    most = min(len(data), max(rerank, int(np.ceil(share * len(data)))))
    step = int(np.clip(GATHER_BYTES // max(1, most * dimension * 4), 1, 512))
    for at in range(0, len(queries), step) if len(data) else ():
        q = queries[at : at + step]
        near = _closeness(perm, q, data).astype(np.int64)
        near[(ids[q][:, None] == ids[data][None, :]) | _met_before(perm, q, data, file, asked, posted)] = -1
        order = near * len(data) - np.arange(len(data))  # equal distances by smaller id
        best = np.argpartition(-order, most - 1, axis=1)[:, :most] if most < len(data) else np.tile(np.arange(most), (len(q), 1))
        s = np.matmul(x[data[best]], x[q][:, :, None])[:, :, 0]
        s[(np.take_along_axis(near, best, 1) < 0) | (s < floor - 1e-5)] = -2
        m = min(k + 8, most)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < most else np.tile(np.arange(most), (len(q), 1))
        i = np.repeat(np.arange(len(q)), m)
        j = np.take_along_axis(best, top, 1).ravel()
        ok = np.take_along_axis(s, top, 1).ravel() > -1.5
        i, j = i[ok], data[j[ok]]
        cos = np.round(np.einsum("ij,ij->i", x[q[i]].astype(np.float64), x[j].astype(np.float64)), PLACES)
        order = np.lexsort((ids[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
        take = (rank < k) & (cos >= floor)
        found.append((ids[q[i[take]]], ids[j[take]], cos[take]))
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    return pa.table({"root": pa.array(cols[0], pa.int64()), "near": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})


def nearest(vectors: DataFrame, k: int = 5, floor: float = -1.0, every: int = 1, asked: int = POSTED, posted: int = POSTED, rerank: int = RERANK, share: float = SHARE, ordered: int = ORDERED, dimension: int = DIMENSION, most_pivots: int = MOST) -> DataFrame:
    """(memory_id, rank, near, cosine): of every memory whose id is divisible by ``every`` the k most
    similar other memories of the whole table by cosine, equal ones by smaller id; with floor only those
    of at least that cosine. Near copies are found with few files of many pivots; where neighbours are far,
    recall needs a constant share of all rows, that is fewer pivots (most_pivots) and more files read (asked). Files
    are ranked by footrule distance, and the best ``rerank`` or ``share`` of each compared by their vectors.

    Identical vectors are indexed once: as they tie, only the k + 1 smallest ids of each can be among
    anyone's k nearest. Repeated ids count once (rows that differ: the one with the smallest digest); null,
    short, zero and non-finite vectors are not usable; empty tables give no rows."""
    base = one_per_id(usable(vectors, dimension).withColumn("same", F.xxhash64("vec"))).persist(StorageLevel.MEMORY_AND_DISK)
    n = base.count()
    query = (F.col("memory_id") % every == 0) if every > 1 else F.lit(True)
    reps, copies = one_per_copy(base)
    # a class is asked for if any of its members is
    wanted = copies.where(F.col("member") % every == 0).select(F.col("root").alias("memory_id")).distinct()
    if every > 1:
        also = wanted.withColumn("also", F.lit(True))
        rows = reps.select("memory_id", "vec").join(F.broadcast(also) if wanted.count() <= BROADCAST_IDS else also, "memory_id", "left")
        rows = rows.select("memory_id", (query | F.coalesce("also", F.lit(False))).alias("query"), "vec")
    else:
        rows = reps.select("memory_id", F.lit(True).alias("query"), "vec")
    if n:
        pivots, lengths = pivots_of(base, dimension, n, most_pivots)
        posts = postings(rows, pivots, lengths, dimension, posted, asked, ordered, every)
        size = n * (posted + asked / every) * (4 * (dimension + ordered) + 60)
        parts = max(shuffle_partitions(base.sparkSession), int(size // PARTITION_BYTES))
        met = posts.repartition(parts, "file", "a", "b").groupBy("file", "a", "b").applyInArrow(
            lambda t: _search(t, dimension, k, floor, rerank, share, asked, posted, ordered), "root long, near long, cosine double"
        )
    else:
        met = base.sparkSession.createDataFrame([], "root long, near long, cosine double")
    met = materialize(met.groupBy("root", "near").agg(F.max("cosine").alias("cosine")))  # read twice below
    # classes of copies: their first ids stand for the class
    first = Window.partitionBy("root").orderBy("member")
    heads = copies.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).drop("nth")
    more = met.join(heads.withColumnRenamed("root", "near"), "near").select("root", F.col("member").alias("near"), "cosine")
    own = heads.select("root", F.col("member").alias("near"), F.lit(1.0).alias("cosine")).union(heads.select("root", F.col("root").alias("near"), F.lit(1.0)).distinct())
    best = Window.partitionBy("root").orderBy(F.desc("cosine"), "near")
    lists = met.union(more).union(own).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = lists.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("nth", "near", "cosine"))).alias("found"))  # k + 1 at most
    people = reps.select("memory_id", F.col("memory_id").alias("root")).distinct().union(copies.select("member", "root")).where(query)
    mine = lookup_join(people, lists, "root", "inner").select("memory_id", F.filter("found", lambda f: f["near"] != F.col("memory_id")).alias("found"))
    return mine.select("memory_id", F.posexplode(F.slice("found", 1, k)).alias("rank", "f")).select("memory_id", (F.col("rank") + 1).alias("rank"), "f.near", "f.cosine")


def mutual(near: DataFrame, least: float) -> DataFrame:
    """(memory_id_a, memory_id_b), a < b: pairs of at least that cosine that are in each other's lists."""
    pair = near.where(F.col("cosine") >= least).select(F.least("memory_id", "near").alias("memory_id_a"), F.greatest("memory_id", "near").alias("memory_id_b"))
    return pair.groupBy("memory_id_a", "memory_id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def true_lists(vectors: DataFrame, k: int = 5, every: int = 50, dimension: int = DIMENSION) -> DataFrame:
    """(memory_id, near, cosine): the k nearest of each usable memory whose id is divisible by ``every``, by brute
    force against all rows. Queries are sent out PASS_QUERIES at a time, with one pass over all rows for each."""
    base = one_per_id(usable(vectors, dimension).withColumn("same", F.xxhash64("vec"))).select("memory_id", "vec").persist(StorageLevel.MEMORY_AND_DISK)  # equal repeats stay
    asked = base.where(F.col("memory_id") % every == 0).dropDuplicates(["memory_id"])
    parts = max(1, -(-asked.count() // PASS_QUERIES))
    true = None
    for p in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("memory_id"), F.lit(parts)) == p).toArrow()
        one = _brute(base, np.asarray(rows.column(0)), unpacked(rows.column(1), dimension), k, dimension)
        true = one if true is None else true.union(one)
    best = Window.partitionBy("memory_id").orderBy(F.desc("cosine"), "near")
    return true.distinct().withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")


def missed(true: DataFrame, found: DataFrame) -> DataFrame:
    """(queries, expected, missed, recall) of lists (memory_id, near) against true ones, of memories for which
    nothing was found as well."""
    hit = true.join(found.select("memory_id", "near", F.lit(1).alias("hit")), ["memory_id", "near"], "left")
    return hit.agg(F.countDistinct("memory_id").alias("queries"), F.count(F.lit(1)).alias("expected"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missed"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 4).alias("recall"))


def recall(vectors: DataFrame, found: DataFrame, k: int = 5, every: int = 50, dimension: int = DIMENSION) -> DataFrame:
    """(queries, expected, missed, recall) of lists made by nearest() with the same ``every``, against brute
    force: each usable memory whose id is divisible by it counts, whether anything was found for it or not."""
    return missed(true_lists(vectors, k, every, dimension), found)


def _brute(base: DataFrame, qid: np.ndarray, q: np.ndarray, k: int, dimension: int) -> DataFrame:
    """(memory_id, near, cosine): the k best rows of each part of base for every query, equal ones by smaller id."""
    shared = base.sparkSession.sparkContext.broadcast((qid, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, qx = shared.value
        have = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            ids, first = np.unique(np.asarray(b.column(0)), return_index=True)
            x = unpacked(b.column(1), dimension)[first]
            new = [have]
            for a in range(0, len(qi), AT_ONCE) if len(ids) else ():
                s = qx[a : a + AT_ONCE] @ x.T
                s[qi[a : a + AT_ONCE, None] == ids[None, :]] = -2
                floor = np.partition(s, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(s), -1.5)
                # all that may tie with the k-th after rounding
                i, j = np.nonzero((s >= floor[:, None] - 1e-5) & (s > -1.5))
                cos = [np.einsum("ij,ij->i", qx[a + i[c : c + 65_536]].astype(np.float64), x[j[c : c + 65_536]].astype(np.float64)) for c in range(0, len(i), 65_536)]
                new.append((a + i, ids[j], np.round(np.concatenate(cos), PLACES) if cos else np.zeros(0)))
            i, near, cos = (np.concatenate(c) for c in zip(*new))
            order = np.lexsort((near, -cos, i))
            order = order[np.r_[True, (np.diff(i[order]) != 0) | (np.diff(near[order]) != 0)][: len(order)]]  # repeats of one id
            i, near, cos = i[order], near[order], cos[order]
            take = np.arange(len(i)) - np.searchsorted(i, i) < k
            have = i[take], near[take], cos[take]
        if len(have[0]):
            yield pa.RecordBatch.from_arrays([pa.array(qi[have[0]], pa.int64()), pa.array(have[1], pa.int64()), pa.array(have[2], pa.float64())], names=["memory_id", "near", "cosine"])

    return base.mapInArrow(run, "memory_id long, near long, cosine double")
