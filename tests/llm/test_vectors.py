"""p1 and p2 on small fixtures against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.llm import grouping, neighbours
from sediment.llm.vectors import packed, unit_rows, unpacked

SCHEMA = "memory_id long, vector array<float>, dimension int, vec string, same int, root long, query string"
MEMORY = "id long, category string, updated_at timestamp, vec int, leaf string"
D = 16


def fixture(spark, seed=0, groups=8, noise=120, category=lambda i: "Fact " if i % 2 else "rule"):
    rng = np.random.default_rng(seed)
    rows, memories = [], []
    i = 0
    for g in range(groups):
        c = rng.normal(size=D)
        c /= np.linalg.norm(c)
        for _ in range(rng.integers(2, 9)):
            v = c + rng.normal(size=D) * 0.09
            rows.append((1000 + i, [float(x) for x in v * rng.uniform(0.5, 3)]))
            memories.append((1000 + i, category(g)))
            i += 1
    for _ in range(noise):
        rows.append((1000 + i, [float(x) for x in rng.normal(size=D)]))
        memories.append((1000 + i, category(i)))
        i += 1
    rows += [(5000, None), (5001, []), (5002, [1.0] * (D - 1)), (5003, [0.0] * D), (5004, [float("nan")] * D), (None, [1.0] * D), (5005, [None] * D)]
    rows += [(2000 + k, rows[0][1]) for k in range(9)] + [rows[1], rows[1]]
    memories += [(2000 + k, memories[0][1]) for k in range(9)] + [(5006, None), (None, "fact")]
    v = spark.createDataFrame([(a, b, 7, "x", 1, 2, "q") for a, b in rows], SCHEMA)
    m = spark.createDataFrame([(a, c, None, 1, "l") for a, c in memories], MEMORY)
    usable = {a: np.array(b) / np.linalg.norm(b) for a, b in rows if a and a < 5000}
    return v, m, usable, {a: c.strip().lower() for a, c in memories if a and c}


def brute_groups(vectors, cats, threshold):
    ids = sorted(i for i in vectors if i in cats)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and cats[x] == cats[y] and vectors[x] @ vectors[y] >= threshold:
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in ids:
        groups.setdefault(root(i), []).append(i)
    return {(r, i) for r, g in groups.items() if len(g) >= 3 for i in g}


def test_groups_equal_brute_force(spark):
    v, m, usable, cats = fixture(spark)
    got = {tuple(r) for r in grouping.similar_groups(v, m, 0.72, 3, D).collect()}
    assert got == brute_groups(usable, cats, 0.72) and len(got) > 20


def rows_of(v, m):
    return grouping.categorized(v, m, D).select("memory_id", F.col("category").alias("grp"), F.lit(True).alias("own"), "vec").persist()


def test_groups_over_many_leaves(spark):
    v, m, usable, cats = fixture(spark, 3, 20, 300)
    base = rows_of(v, m)
    tree = grouping.fit_tree(base, D, leaf_rows=60)
    leaves = tree.all_leaves()
    assert len(leaves) > 4 and sum(tree.sizes[i] for i in leaves) == base.count()
    assert all(tree.sizes[i] <= 60 or (tree.spread[i] <= 0.15 and tree.sizes[i] <= 120) for i in leaves)
    placed = grouping.placed(base, tree, 3)
    own = placed.where("own").groupBy("memory_id").agg(F.collect_set("leaf").alias("l")).collect()
    assert len(own) == base.count() and all(1 <= len(r.l) <= 2 for r in own)
    want = {i for _, i in brute_groups(usable, cats, 0.72)}
    members = {r.member for r in grouping.alike_components(placed, 0.72, D, 2000).collect()}
    assert len(want & members) >= 0.99 * len(want)


def test_leaves_too_large_for_a_task_become_trees(spark, monkeypatch):
    v, m, usable, cats = fixture(spark, 5, 60, 900)
    for name, value in (("MAX_LEAVES", 8), ("TASK_ROWS", 90), ("LEAF_ROWS", 30), ("SAMPLE_ROWS", 512)):
        monkeypatch.setattr(grouping, name, value)
    rows = grouping.in_leaves(rows_of(v, m), D, 1).cache()
    assert any(r.leaf.count("/") > 1 for r in rows.select("leaf").distinct().collect())
    assert rows.where("own").groupBy("leaf").count().agg(F.max("count")).first()[0] <= 270  # 90 by the tree, the others by the nearest centre
    assert {r.memory_id for r in rows.where("own").collect()} >= {i for i in usable if i in cats}
    want = brute_groups(usable, cats, 0.72)
    assert len(want & {tuple(r) for r in grouping.similar_groups(v, m, 0.72, 3, D).collect()}) >= 0.97 * len(want)
    leaves = grouping.leaf_report(v, m, 0.8, 3, 1, D).collect()
    assert sum(r.n for r in leaves) == len([i for i in usable if i in cats]) and all(r.cohesion >= 0.8 - 1e-6 for r in leaves)


def test_any_number_of_categories(spark):
    rng = np.random.default_rng(8)
    vs = rng.normal(size=(20_000, 4))
    v = spark.createDataFrame([(3 * i + k, [float(y) for y in x]) for i, x in enumerate(vs) for k in range(3)], "memory_id long, vector array<float>")
    m = spark.createDataFrame([(3 * i + k, f"c{i}", None) for i in range(len(vs)) for k in range(3)], "id long, category string, updated_at timestamp")
    got = grouping.similar_groups(v, m, dimension=4)
    assert got.count() == 60_000 and got.where("first_id != memory_id - memory_id % 3").count() == 0


def test_group_recall_counts_pairs(spark):
    v, m, usable, cats = fixture(spark)
    r = grouping.group_recall(v, m, 0.72, 1, D).first()
    ids = [i for i in usable if i in cats]
    pairs = sum(i != j and cats[i] == cats[j] and usable[i] @ usable[j] >= 0.72 for i in ids for j in ids)
    assert (r.queries, r.expected) == (len(ids), pairs) and r.missed == 0 and r.recall == 1.0


def test_leaves_are_compact_and_whole(spark):
    v, m, usable, cats = fixture(spark)
    leaves = grouping.leaf_report(v, m, 0.8, 3, 1, D).collect()
    assert sum(r.n for r in leaves) == len(usable)
    assert all(r.cohesion >= 0.8 - 1e-6 and len(r.typical) == min(3, r.n) for r in leaves)


def brute_nearest(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    s = np.round(x @ x.T, neighbours.PLACES)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))[:k]] for a, i in enumerate(ids)}


def test_nearest_against_brute_force(spark):
    v, _, usable, _ = fixture(spark)
    near = neighbours.nearest(v, 5, asked=8, share=0.5, ordered=16, dimension=D).collect()
    got = {}
    for r in sorted(near, key=lambda r: (r.memory_id, r["rank"])):
        got.setdefault(r.memory_id, []).append(r.near)
    want = brute_nearest(usable, 5)
    assert set(got) == set(want)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.97 * 5 * len(want)
    copies = [i for i in want if i == 1000 or 2000 <= i < 2009]
    assert all(got[i] == want[i] for i in copies)


def test_mutual_pairs_and_blocks(spark, monkeypatch):
    v, _, usable, _ = fixture(spark, 5)
    want = brute_nearest(usable, 5)
    pairs = {(a, b) for a in want for b in want[a] if a < b and a in want[b] and usable[a] @ usable[b] >= 0.9}
    got = {tuple(r) for r in neighbours.mutual(neighbours.nearest(v, 5, 0.9, dimension=D), 0.9).collect()}
    assert len(got & pairs) >= 0.95 * len(pairs) and len(got - pairs) <= 0.05 * len(pairs)
    monkeypatch.setattr(neighbours, "FILE_ROWS", 20)
    again = {tuple(r) for r in neighbours.mutual(neighbours.nearest(v, 5, 0.9, dimension=D), 0.9).collect()}
    assert again == got


def test_some_queries_and_recall(spark):
    v, _, usable, _ = fixture(spark)
    found = neighbours.nearest(v, 5, every=50, asked=8, share=0.5, ordered=16, dimension=D)
    assert {r.memory_id for r in found.collect()} == {i for i in usable if i % 50 == 0}
    r = neighbours.recall(v, found, dimension=D).first()
    assert r.queries == len([i for i in usable if i % 50 == 0]) and r.recall >= 0.95


def test_empty_tables(spark):
    v, m = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], MEMORY)
    assert grouping.similar_groups(v, m, dimension=D).count() == 0
    assert grouping.leaf_report(v, m, dimension=D).count() == 0
    assert neighbours.nearest(v, dimension=D).count() == 0


def test_packing_round_trip():
    import pyarrow as pa

    x = np.random.default_rng(1).normal(size=(7, D)).astype(np.float32)
    assert np.array_equal(unpacked(packed(x), D), x)
    assert np.array_equal(unpacked(packed(x).slice(2, 3), D), x[2:5])
    keep, unit = unit_rows(pa.array([[3.0, 4.0], None, [1.0], [1e308, 1e308]]), 2)
    assert keep.tolist() == [True, False, False, True]
    assert unit[0] == pytest.approx([0.6, 0.8]) and np.linalg.norm(unit[1]) == pytest.approx(1)
