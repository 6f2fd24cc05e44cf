"""Grouping records into clusters of mutually similar records by bisecting k-means.

The tree starts with one node per category. The node with the largest dispersion (rows times one minus the
mean cosine to its centre) is split in two, again and again, until every node is small or compact enough. Splits
are fitted on a bounded sample drawn inside the nodes that are still too large; one pass over the data then gives
the exact sizes, means and dispersions, after which nodes that do not hold the limits are sampled and split anew. Leaves too large for a task are trees of their own; leaves of bounded size
are split further, each inside one task, until the compactness limit holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.vectors import DIMENSION, one_per_copy, packed, unpacked, usable
from sediment.operators.components import connected_components
from sediment.operators.skew import lookup_join
from sediment.runtime import materialize, shuffle_partitions

#: Rows on which splits are fitted at a time (10 MB); all statistics use all rows.
SAMPLE_ROWS = 20_000
#: So many rows of the sample fall to a node on average, so the most dispersed nodes go first if there are many.
PER_NODE = 64
#: A node is split with at least so many rows of the sample, and on the sample to this share of the limit, so that
#: few nodes miss it when all rows are counted.
FEWEST, MARGIN = 8, 0.7
#: Leaves of the distributed part of the tree hold about this many rows.
LEAF_ROWS = 1_500
#: A tree has at most about this many leaves (8 MB of centres); with more rows its leaves get larger ...
MAX_LEAVES = 16_384
#: ... and leaves with more rows than this become trees of their own.
TASK_ROWS = 50_000
#: Each row is compared within its own leaf and this many next best ones.
VISITS = 3
#: Rows whose centres are looked up at once, queries that brute force sends out for a pass, and bytes of a shuffle partition.
AT_ONCE, PASS_QUERIES, PARTITION_BYTES = 1_024, 20_000, 64_000_000


def category_of(memories: DataFrame) -> DataFrame:
    """(memory_id, category) by the latest version, trimmed and in lower case; without null categories."""
    latest = memories.where("id is not null").groupBy(F.col("id").alias("memory_id")).agg(F.max(F.struct("updated_at", "category"))["category"].alias("category"))
    return latest.select("memory_id", F.lower(F.trim("category")).alias("category")).where("category is not null")


def categorized(vectors: DataFrame, memories: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(memory_id, category, vec): one usable vector per memory; memories without category are left out."""
    rows = usable(vectors, dimension).groupBy("memory_id").agg(F.min("vec").alias("vec"))
    return rows.join(category_of(memories), "memory_id").select("memory_id", "category", "vec")


@dataclass
class Tree:
    """Binary trees over unit vectors, one root per group of more than a leaf's rows; ``centers`` has one unit row
    per node."""

    dimension: int
    roots: dict[str, int] = field(default_factory=dict)
    children: list[tuple[int, int] | None] = field(default_factory=list)
    centers: np.ndarray | None = None
    #: Exact rows and dispersions (1 - mean cosine to the centre) of the leaves.
    sizes: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    #: Exact means of the leaves.
    means: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, center: np.ndarray) -> int:
        self.children.append(None)
        self.sizes.append(0.0)
        self.spread.append(1.0)
        center = center.astype(np.float32)[None]
        self.centers = center if self.centers is None else np.concatenate([self.centers, center])
        return len(self.children) - 1

    def start(self, groups: list[str]) -> np.ndarray:
        """The root of each row's group, -1 for the small groups that have none."""
        return np.array([self.roots.get(g, -1) for g in groups], dtype=int)

    def route(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaf below ``node`` of each row, choosing the nearer child on each level; -1 stays -1."""
        kids = np.array([c or (-1, -1) for c in self.children] or [(-1, -1)]).reshape(-1, 2)
        parts = [self._descend(x[a : a + 4096], node[a : a + 4096], kids) for a in range(0, len(x), 4096)]
        return np.concatenate(parts) if parts else node.copy()

    def _descend(self, x: np.ndarray, node: np.ndarray, kids: np.ndarray) -> np.ndarray:
        node = node.copy()
        open_ = np.flatnonzero((node >= 0) & (kids[node, 0] >= 0)) if len(node) else np.zeros(0, int)
        while len(open_):
            k = kids[node[open_]]
            at = x[open_]
            right = np.einsum("ij,ij->i", at, self.centers[k[:, 1]]) > np.einsum("ij,ij->i", at, self.centers[k[:, 0]])
            node[open_] = np.where(right, k[:, 1], k[:, 0])
            open_ = open_[kids[node[open_], 0] >= 0]
        return node

    def leaves(self, root: int) -> list[int]:
        out, todo = [], [root]
        while todo:
            i = todo.pop()
            if self.children[i] is None:
                out.append(i)
            else:
                todo += self.children[i]
        return sorted(out)

    def all_leaves(self) -> list[int]:
        return [n for r in self.roots.values() for n in self.leaves(r)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def two_means(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """(centers, side) of spherical 2-means, begun with a random row and the row least like it among a
    few; None if the rows cannot be told apart."""
    a = x[rng.integers(len(x))]
    tries = x[rng.integers(len(x), size=min(len(x), 32))]
    c = np.stack([a, tries[(tries @ a).argmin()]])
    side = None
    for _ in range(rounds):
        s = x @ c.T
        new = s[:, 1] > s[:, 0]
        if new.all() or not new.any():
            return None
        if side is not None and (new == side).all():
            break
        side = new
        c = unit(np.stack([x[~side].sum(0), x[side].sum(0)]))
    return c, side


def _measure(base: DataFrame, tree: Tree) -> dict[int, tuple[int, np.ndarray]]:
    """Exact (rows, sum of vectors) of every leaf of the tree, in one pass."""
    shared = base.sparkSession.sparkContext.broadcast(tree)
    d = tree.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        total: dict[int, list] = {}
        for b in batches:
            x = unpacked(b.column(1), d)
            if not len(x):
                continue
            node = t.route(x, t.start(b.column(0).to_pylist()))
            x, node = x[node >= 0], node[node >= 0]
            if not len(x):
                continue
            order = np.argsort(node, kind="stable")
            ids, first = np.unique(node[order], return_index=True)
            for i, n, s in zip(ids, np.diff([*first, len(order)]), np.add.reduceat(x[order].astype(np.float64), first)):
                have = total.setdefault(int(i), [0, np.zeros(d)])
                have[0] += int(n)
                have[1] += s
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1].tobytes() for k in keys], pa.binary())], names=["node", "n", "s"]
            )

    def merge(t: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(v, np.float64) for v in t.column("s").to_pylist()], axis=0)
        return pa.table({"node": t.column("node")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "s": pa.array([s.tobytes()], pa.binary())})

    parts = base.select("grp", "vec").mapInArrow(run, "node long, n long, s binary")
    # one row per leaf, of which there are about MAX_LEAVES at most
    return {r[0]: (r[1], np.frombuffer(r[2], np.float64)) for r in parts.groupBy("node").applyInArrow(merge, "node long, n long, s binary").collect()}


def _settle(base: DataFrame, tree: Tree) -> None:
    """Sizes, dispersions and means of the leaves, counted without moving a centre."""
    for i in tree.all_leaves():
        tree.sizes[i], tree.spread[i] = 0.0, 0.0
    for i, (n, s) in _measure(base, tree).items():
        tree.sizes[i], tree.spread[i], tree.means[i] = n, 1.0 - np.linalg.norm(s) / n, unit(s)


def _sample(base: DataFrame, tree: Tree, nodes: set[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, leaf) of about so many rows of these leaves, picked by a digest of their ids."""
    shared = base.sparkSession.sparkContext.broadcast((tree, np.array(sorted(nodes))))
    d = tree.dimension
    share = min(1.0, rows / max(1.0, sum(tree.sizes[i] for i in nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, wanted = shared.value
        for b in batches:
            x = unpacked(b.column(2), d)
            if len(x):
                node = t.route(x, t.start(b.column(1).to_pylist()))
                mine = np.flatnonzero(np.isin(node, wanted))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[mine]), pa.array(node[mine], pa.int64()), packed(x[mine])], names=["memory_id", "node", "vec"])

    picked = base.select("memory_id", "grp", "vec")
    if share < 1.0:
        scale = 1 << 40
        picked = picked.where(F.pmod(F.xxhash64("memory_id"), F.lit(scale)) < int(share * scale) + 1)
    got = picked.mapInArrow(run, "memory_id long, node long, vec binary").limit(2 * rows).toArrow()
    x, node, ids = unpacked(got.column("vec"), d), np.asarray(got.column("node")), np.asarray(got.column("memory_id"))
    order = np.lexsort((x[:, 0], ids)) if len(ids) else np.zeros(0, int)
    return x[order], node[order]


def fit_tree(base: DataFrame, dimension: int = DIMENSION, leaf_rows: int | None = None, compact: float = 0.85, sample_rows: int | None = None, whole: float | None = None) -> Tree:
    """The distributed part of the tree over (memory_id, grp, vec). Nodes are split by falling dispersion while they
    have more than leaf_rows rows (twice that, if their mean cosine to the centre is at least ``compact``); with
    ``whole`` a node of at least that mean cosine is never split, whatever its size.

    Groups of at most leaf_rows rows have no root. Sizes, dispersions and means are those of the leaves as the
    finished tree routes rows to them."""
    leaf_rows, sample_rows = leaf_rows or LEAF_ROWS, sample_rows or SAMPLE_ROWS
    tree = Tree(dimension)
    total = base.count()
    leaf_rows = max(leaf_rows, total * 2 // MAX_LEAVES)
    # at most MAX_LEAVES / 2 groups are that large
    for r in base.groupBy("grp").count().where(F.col("count") > leaf_rows).orderBy("grp").collect():
        tree.roots[r[0]] = tree.add(np.zeros(dimension))
        tree.sizes[tree.roots[r[0]]] = r[1]
    if not tree.roots:
        return tree
    rng = np.random.default_rng(11)

    def open_(n: float, spread: float, goal: float = 1.0) -> bool:
        if whole is not None:
            return n > leaf_rows * goal and spread > 1.0 - whole
        return n > leaf_rows * goal * (1 if spread > 1.0 - compact else 2)

    stuck: set[int] = set()
    if whole is not None:  # roots may be compact already
        _settle(base, tree)
    while True:
        todo = {i for i in tree.all_leaves() if i not in stuck and open_(tree.sizes[i], tree.spread[i])}
        if not todo:
            return tree
        todo = set(sorted(todo, key=lambda i: (-tree.sizes[i] * tree.spread[i], i))[: max(1, sample_rows // PER_NODE)])
        x, home = _sample(base, tree, todo, sample_rows)
        heap = []
        for i in sorted(todo):
            mine = np.flatnonzero(home == i)
            per = tree.sizes[i] / max(1, len(mine))
            heapq.heappush(heap, (-tree.sizes[i] * tree.spread[i], i, mine, per))
        grown, leaves = False, len(tree.all_leaves())
        while heap and leaves < 2 * MAX_LEAVES:
            _, i, mine, per = heapq.heappop(heap)
            fit = two_means(x[mine], rng) if len(mine) >= FEWEST else None
            if fit is None:
                if i in todo:  # its rows in the sample cannot be told apart
                    stuck.add(i)
                continue
            tree.children[i] = (tree.add(fit[0][0]), tree.add(fit[0][1]))
            grown, leaves = True, leaves + 1
            for k, part in zip(tree.children[i], (mine[~fit[1]], mine[fit[1]])):
                n, spread = len(part) * per, 1.0 - np.linalg.norm(x[part].mean(0))
                if open_(n, spread, MARGIN):
                    heapq.heappush(heap, (-n * spread, k, part, per))
        if grown:  # else all of them are stuck now
            _settle(base, tree)
        if leaves >= 2 * MAX_LEAVES:
            return tree


def placed(base: DataFrame, tree: Tree, visits: int) -> DataFrame:
    """(leaf, own, memory_id, vec): each row of (memory_id, grp, own, vec) in the leaf the tree routes it to and in
    the ``visits`` leaves of its group with the nearest centres besides. Its own (if it was before) are the first
    and the nearest; in the others it is a visitor. The rows of a small group share a leaf."""
    shared = base.sparkSession.sparkContext.broadcast(tree)
    d = tree.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            groups = b.column(1).to_pylist()
            x, own_before = unpacked(b.column(3), d), np.asarray(b.column(2))
            home = t.route(x, t.start(groups))
            groups = np.array(groups, dtype=object)
            for g in dict.fromkeys(groups.tolist()):
                every = np.flatnonzero(groups == g)
                if g not in t.roots:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{g}/"] * len(every)), pa.array(own_before[every]), b.column(0).take(pa.array(every)), packed(x[every])], names=["leaf", "own", "memory_id", "vec"])
                    continue
                if g not in known:
                    ids = np.array(t.leaves(t.roots[g]))
                    known[g] = ids, np.stack([t.means.get(i, t.centers[i]) for i in ids.tolist()]).astype(np.float32)
                ids, centers = known[g]
                for at in range(0, len(every), AT_ONCE):
                    mine = every[at : at + AT_ONCE]
                    s = x[mine] @ centers.T
                    nearest = ids[s.argmax(axis=1)]
                    s[np.arange(len(mine)), np.searchsorted(ids, home[mine])] = 2.0  # always kept
                    m = min(visits + 1, len(ids))
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(ids) else np.tile(np.arange(m), (len(mine), 1))
                    row = np.repeat(mine, m)
                    leaf = ids[best.ravel()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{g}/{i}" for i in leaf.tolist()]), pa.array(own_before[row] & ((leaf == home[row]) | (leaf == np.repeat(nearest, m)))), b.column(0).take(pa.array(row)), packed(x[row])], names=["leaf", "own", "memory_id", "vec"]
                    )

    return base.select("memory_id", "grp", "own", "vec").mapInArrow(run, "leaf string, own boolean, memory_id long, vec binary")


def _too_large(tree: Tree) -> list[tuple[str, int]]:
    """(group, node) of leaves with too many rows for a task."""
    return [(g, i) for g, r in tree.roots.items() for i in tree.leaves(r) if tree.sizes[i] > TASK_ROWS]


def in_leaves(base: DataFrame, dimension: int, visits: int = VISITS, depth: int = 0) -> DataFrame:
    """(leaf, own, memory_id, vec) of (memory_id, grp, own, vec): placed() in a tree, whose leaves are trees of their
    own while they have more rows than a task should handle; there a row visits one leaf besides."""
    tree = fit_tree(base, dimension)
    rows = placed(base, tree, visits)
    large = _too_large(tree)
    if not large or depth == 8:
        return rows
    rows = materialize(rows)
    names = F.broadcast(rows.sparkSession.createDataFrame([(f"{g}/{i}",) for g, i in large], "leaf string"))  # about MAX_LEAVES at most
    deep = rows.join(names, "leaf", "left_semi").select("memory_id", F.col("leaf").alias("grp"), "own", "vec")
    return rows.join(names, "leaf", "left_anti").select("leaf", "own", "memory_id", "vec").unionByName(in_leaves(deep, dimension, min(visits, 1), depth + 1))


def _by_leaf(rows: DataFrame, n: int) -> DataFrame:
    """rows shuffled by leaf into partitions of bounded size, n being how many rows there are about."""
    parts = max(shuffle_partitions(rows.sparkSession), -(-n * 700 // PARTITION_BYTES))
    return rows.repartition(parts, "leaf")


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component."""
    p = np.arange(n)
    while len(i):
        q = p.copy()
        np.minimum.at(q, i, p[j])
        np.minimum.at(q, j, p[i])
        q = q[q]
        if (q == p).all():
            break
        p = q
    return p


def alike_components(rows: DataFrame, threshold: float, dimension: int, n: int) -> DataFrame:
    """rows are those of in_leaves(), about n of them. (member, root) pairs whose components are those of all alike pairs met in a leaf: within each leaf
    every own row is compared with own and visiting rows in blocks, and each row joined to the smallest
    id of its component there. Rows without alike row give nothing."""
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("memory_id")), kind="stable")
        ids = np.asarray(t.column("memory_id"))[order]
        x = unpacked(t.column("vec"), dimension)[order]
        own = np.flatnonzero(np.asarray(t.column("own"))[order])
        label = np.arange(len(ids))
        for at in range(0, len(own), 128):
            block = own[at : at + 128]
            s = x[block] @ x.T
            # rows that are joined already need no further pair
            i, j = np.nonzero((s >= threshold - 1e-5) & (label[block][:, None] != label[None, :]))
            a = block[i]
            near = s[i, j] < threshold + 1e-5
            if near.any():
                exact = np.einsum("ij,ij->i", x[a[near]].astype(np.float64), x[j[near]].astype(np.float64))
                good = np.ones(len(a), bool)
                good[near] = exact >= threshold
                a, j = a[good], j[good]
            if len(a):
                label = _components(len(ids), label[a], label[j])[label]
        size = np.bincount(label, minlength=len(ids))
        member = np.flatnonzero(size[label] > 1)
        return pa.table({"member": pa.array(ids[member], pa.int64()), "root": pa.array(ids[label[member]], pa.int64())})

    return _by_leaf(rows, n).groupBy("leaf").applyInArrow(run, "member long, root long")


def groups_of(base: DataFrame, threshold: float, dimension: int) -> DataFrame:
    """(memory_id, first_id) of all rows of (memory_id, category, vec) that are joined to another one, directly or
    over others, by a cosine of at least threshold within the category; first_id is the smallest id joined."""
    reps, copies = one_per_copy(base.withColumn("same", F.xxhash64("category", "vec")))
    reps = reps.select("memory_id", F.col("category").alias("grp"), F.lit(True).alias("own"), "vec").persist(StorageLevel.MEMORY_AND_DISK)
    pairs = alike_components(in_leaves(reps, dimension), threshold, dimension, (VISITS + 1) * reps.count())
    # a root for each leaf a member is in at most, and no more members of a root than a leaf has rows
    spans = materialize(pairs.groupBy("member").agg(F.min("root").alias("low"), F.sort_array(F.collect_set("root")).alias("roots")))
    reps.unpersist()
    roots = connected_components(spans.select(F.col("low").alias("src"), F.explode("roots").alias("dst")))
    member = materialize(spans.select(F.col("member").alias("memory_id"), F.col("low").alias("node")).join(roots, "node").select("memory_id", F.col("component").alias("first_id")))
    mine = copies.select(F.col("member").alias("memory_id"), F.col("root").alias("node"))
    of_copy = lookup_join(mine, member.withColumnRenamed("memory_id", "node"), "node").select("memory_id", F.coalesce("first_id", "node").alias("first_id"))
    alone = copies.select(F.col("root").alias("memory_id"), F.col("root").alias("first_id")).distinct().join(member.select("memory_id"), "memory_id", "left_anti")
    return materialize(member.unionByName(of_copy).unionByName(alone))


def similar_groups(vectors: DataFrame, memories: DataFrame, threshold: float = 0.72, least: int = 3, dimension: int = DIMENSION) -> DataFrame:
    """(first_id, memory_id): members of every maximal set of at least ``least`` memories of one category
    joined, directly or over others, by cosines of at least threshold; first_id is the smallest id.

    The bisecting k-means tree brings similar vectors into the same leaf; the exact check within leaves
    and their visitors finds the pairs. Identical vectors are represented once. Repeated memory ids count
    once; null, short, zero and non-finite vectors are not usable; empty tables give no rows."""
    base = categorized(vectors, memories, dimension).persist(StorageLevel.MEMORY_AND_DISK)
    everyone = groups_of(base, threshold, dimension)
    base.unpersist()
    large = everyone.groupBy("first_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("first_id")
    return lookup_join(everyone, large, "first_id", "left_semi").select("first_id", "memory_id")


def group_recall(vectors: DataFrame, memories: DataFrame, threshold: float = 0.72, every: int = 50, dimension: int = DIMENSION) -> DataFrame:
    """(queries, expected, missed, recall): of the alike pairs between a memory whose id is divisible by ``every``
    and any other of its category, by brute force over all rows, how many lie in one cluster. Pairs are counted where
    they are met; queries are sent out PASS_QUERIES at a time."""
    base = materialize(categorized(vectors, memories, dimension))
    known = groups_of(base, threshold, dimension)
    rows = lookup_join(base, known, "memory_id").select("memory_id", F.xxhash64("category").alias("c"), F.coalesce("first_id", "memory_id").alias("label"), "vec").persist(StorageLevel.MEMORY_AND_DISK)
    asked = rows.where(F.col("memory_id") % every == 0)
    n = asked.count()
    parts, sums = max(1, -(-n // PASS_QUERIES)), None
    for p in range(parts):
        q = asked.where(F.pmod(F.xxhash64("memory_id"), F.lit(parts)) == p).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((*[np.asarray(q.column(k)) for k in range(3)], unpacked(q.column(3), dimension)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qi, qc, ql, qx = shared.value
            pairs = lost = 0
            for b in batches:
                ids, c, label = (np.asarray(b.column(k)) for k in range(3))
                x = unpacked(b.column(3), dimension)
                for at in range(0, len(qi), 256):
                    i, j = np.nonzero((qx[at : at + 256] @ x.T >= threshold - 1e-5) & (qc[at : at + 256, None] == c[None, :]) & (qi[at : at + 256, None] != ids[None, :]))
                    good = np.einsum("ij,ij->i", qx[at + i].astype(np.float64), x[j].astype(np.float64)) >= threshold
                    pairs += int(good.sum())
                    lost += int((good & (ql[at + i] != label[j])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([lost])], names=["pairs", "lost"])

        one = rows.mapInArrow(run, "pairs long, lost long")
        sums = one if sums is None else sums.union(one)
    out = sums.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("expected"), F.coalesce(F.sum("lost"), F.lit(0)).alias("missed"))
    return out.select(F.lit(n).cast("long").alias("queries"), "expected", "missed", F.round(F.when(F.col("expected") > 0, 1 - F.col("missed") / F.col("expected")).otherwise(1.0), 6).alias("recall"))


def leaf_report(vectors: DataFrame, memories: DataFrame, compact: float = 0.8, typical: int = 3, least: int = 1, dimension: int = DIMENSION, leaf_rows: int | None = None) -> DataFrame:
    """(category, leaf, n, radius, cohesion, typical): the leaves of the whole bisecting k-means tree with
    at least ``least`` rows: smallest id, size, smallest and mean cosine to the centre, and the ids nearest to it.

    The node with the largest dispersion is split again and again until every leaf's mean cosine to its centre is at
    least ``compact``, large ones in the distributed tree and small ones inside a task. A compact node stays whole
    whatever its size; beyond leaf_rows it is summed up where its rows are. Identical vectors count with all
    their rows. Repeated memory ids count once; unusable vectors and null categories are left out."""
    base = categorized(vectors, memories, dimension).withColumn("grp", F.col("category")).persist(StorageLevel.MEMORY_AND_DISK)
    return _reported(base, compact, typical, least, dimension, leaf_rows or LEAF_ROWS)


def _split_up(ids: np.ndarray, x: np.ndarray, compact: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, centre) of the compact leaves below a node, in order of their smallest id; the most dispersed node is
    split first. Rows that cannot be told apart are halved."""
    out, heap = [], []

    def see(mine: np.ndarray) -> None:
        c = unit(x[mine].sum(0, dtype=np.float64))
        mean = float((x[mine] @ c).mean())
        if len(mine) == 1 or mean >= compact:
            out.append((mine, c))
        else:
            heapq.heappush(heap, (-len(mine) * (1.0 - mean), int(mine[0]), mine))

    see(np.arange(len(ids)))
    while heap:
        _, _, mine = heapq.heappop(heap)
        fit = two_means(x[mine], np.random.default_rng(abs(int(ids[mine[0]]))))
        half = fit[1] if fit is not None else np.arange(len(mine)) >= len(mine) // 2
        see(mine[~half])
        see(mine[half])
    return sorted(out, key=lambda m: ids[m[0][0]])


def _reported(base: DataFrame, compact: float, typical: int, least: int, dimension: int, leaf_rows: int, depth: int = 0) -> DataFrame:
    tree = fit_tree(base, dimension, leaf_rows, whole=compact)
    large = {i: m for i, m in tree.means.items() if tree.children[i] is None and tree.sizes[i] > leaf_rows and tree.spread[i] <= 1.0 - compact}
    deep = {i for _, i in _too_large(tree) if i not in large} if depth < 8 else set()

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("memory_id")), kind="stable")
        ids, x = np.asarray(t.column("memory_id"))[order], unpacked(t.column("vec"), dimension)[order]
        rows = []
        for mine, c in _split_up(ids, x, compact):
            if len(mine) >= least:
                s = x[mine] @ c
                near = mine[np.lexsort((ids[mine], -s))[:typical]]
                rows.append((t.column("category")[0].as_py(), int(ids[mine].min()), len(mine), float(s.min()), float(s.mean()), [int(i) for i in ids[near]]))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["category", "leaf", "n", "radius", "cohesion", "typical"])

    shared = base.sparkSession.sparkContext.broadcast((tree, large))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        t = shared.value[0]
        for b in batches:
            x = unpacked(b.column(3), dimension)
            if len(x):
                yield b, x, t.route(x, t.start(b.column(2).to_pylist()))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.array(sorted(shared.value[1]))
        for b, _, node in homes(batches):
            at = pa.array(np.flatnonzero(~np.isin(node, big)))
            leaf = [f"{g}/{i}" if i >= 0 else f"{g}/" for g, i in zip(b.column(2).take(at).to_pylist(), node[np.asarray(at)].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(leaf, pa.string()), pa.array(np.isin(node[np.asarray(at)], sorted(deep))), b.column(3).take(at)], names=["memory_id", "category", "leaf", "deep", "vec"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = shared.value[1]
        for b, x, node in homes(batches):
            ids, cats = np.asarray(b.column(0)), b.column(1)
            for i in np.unique(node[np.isin(node, list(big))]).tolist():
                mine = np.flatnonzero(node == i)
                s = x[mine] @ big[i]
                best = np.lexsort((ids[mine], -s))[:typical]
                row = (cats[int(mine[0])].as_py(), i, int(ids[mine].min()), len(mine), float(s.min()), float(s.sum()), [{"s": -float(s[k]), "id": int(ids[mine[k]])} for k in best])
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["category", "node", "leaf", "n", "low", "total", "best"])

    rows = base.select("memory_id", "category", "grp", "vec")
    small = rows.mapInArrow(rest, "memory_id long, category string, leaf string, deep boolean, vec binary")
    if deep:
        small = materialize(small)
    out = _by_leaf(small.where("not deep"), base.count()).groupBy("leaf").applyInArrow(run, "category string, leaf long, n long, radius double, cohesion double, typical array<long>")
    if deep:
        again = small.where("deep").select("memory_id", "category", F.col("leaf").alias("grp"), "vec")
        out = out.unionByName(_reported(again, compact, typical, least, dimension, leaf_rows, depth + 1))
    if not large or least > max(tree.sizes[i] for i in large):
        return out
    sums = rows.mapInArrow(parts, "category string, node long, leaf long, n long, low double, total double, best array<struct<s:double,id:long>>")
    merged = sums.groupBy("category", "node").agg(
        F.min("leaf").alias("leaf"), F.sum("n").alias("n"), F.min("low").alias("radius"), (F.sum("total") / F.sum("n")).alias("cohesion"),
        F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, typical), lambda b: b["id"]).alias("typical"),  # some rows a batch
    ).where(F.col("n") >= least)
    return out.unionByName(merged.drop("node"))
