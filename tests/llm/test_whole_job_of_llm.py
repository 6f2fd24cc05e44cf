"""Cases that a cut, a sample or a block of the vectors would lose."""

import numpy as np

from sediment.llm import grouping, neighbours


def test_recall_counts_memories_without_a_list_and_every_query(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(2300)]
    rows += [(i, rows[7][1]) for i in range(2300, 2320)] + [rows[0]] * 9
    v = spark.createDataFrame(rows, "memory_id long, vector array<float>").repartition(3)
    x = np.array([r[1] for r in rows[:2320]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, neighbours.PLACES)
    np.fill_diagonal(s, -2)
    true = [(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:5]]
    found = spark.createDataFrame([p for p in true if p[0] not in (3, 8)], "memory_id long, near long")
    monkeypatch.setattr(neighbours, "PASS_QUERIES", 1000)
    r = neighbours.recall(v, found, every=1, dimension=8).first()
    assert (r.queries, r.expected) == (2320, 5 * 2320) and 10 <= r.missed <= 12  # a tie may round the other way


def test_compact_leaves_stay_whole_at_any_size(spark):
    rng = np.random.default_rng(6)
    a, b = np.eye(8)[0], np.eye(8)[1]
    vs = [a + rng.normal(size=8) * 0.05 for _ in range(300)] + [b + rng.normal(size=8) * 0.05 for _ in range(300)] + [-a + rng.normal(size=8) * 0.05 for _ in range(200)] + [-b]
    v = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(vs)], "memory_id long, vector array<float>").repartition(4)
    m = spark.createDataFrame([(i, "fact" if i < 300 else "rule" if i < 800 else "event", None) for i in range(len(vs))], "id long, category string, updated_at timestamp")
    keep = lambda rows: sorted((r.category, r.leaf, r.n, round(r.radius, 4), round(r.cohesion, 4), r.typical) for r in rows)
    small = keep(grouping.leaf_report(v, m, dimension=8, leaf_rows=10_000).collect())
    large = keep(grouping.leaf_report(v, m, dimension=8, leaf_rows=40).collect())
    assert small == large and sorted(r[2] for r in large) == [1, 200, 300, 300]
