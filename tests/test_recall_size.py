"""Recall of many queries with words and vectors that many memories share: nothing is written out for each pair of a query
and a memory, and the results are those of plain Python."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.operators import recall as C
from sediment.operators import retrieval as R

T0 = datetime(2025, 6, 1)
N_DOCS, N_QUERIES = 4_000, 300


def most_written(spark, run):
    """The most rows that a stage of run() wrote for the next one."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))}
    before = set(stages())
    out = run()
    return out, max(n for k, n in stages().items() if k not in before)


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"], k=7) + [f"w{rng.randrange(100, 500)}"])) for i in range(n)]


def plain_bm25(docs, queries, top):
    bags = {i: t.split() for i, t in docs}
    avgdl = sum(map(len, bags.values())) / len(bags)
    held = {}
    for q in {w for _, t in queries for w in t.split()}:
        held[q] = {i: n for i, b in bags.items() if (n := sum(w.startswith(q) for w in b))}
    out = {}
    for k, t in queries:
        total = {}
        for q in sorted(set(t.split())):
            idf = max(1e-6, math.log((len(bags) - len(held[q]) + 0.5) / (len(held[q]) + 0.5)))
            for i, n in held[q].items():
                total[i] = total.get(i, 0.0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(bags[i]) / avgdl))
        best = sorted((-round(s, 9), i) for i, s in total.items())[:top]
        out[k] = {i: min(1.0, s / best[0][0]) for s, i in best}
    return out


@pytest.mark.parametrize("passed", [20_000, 40])
def test_words_of_many_queries_are_added_up_beside_the_documents(spark, monkeypatch, passed):
    monkeypatch.setattr(R, "PASS_QUERIES", passed)
    docs, queries = texts(N_DOCS, 1), texts(N_QUERIES, 2)
    posted = R.materialize(R.postings(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text")))
    rows, written = most_written(spark, lambda: R.bm25(posted, spark.createDataFrame(queries, "query_id long, text string"), 5).collect())
    assert written < N_DOCS * N_QUERIES / 10  # each query meets nearly all documents
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.doc] = r.bm25
    want = plain_bm25(docs, queries, 5)
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    assert all(abs(got[k][i] - s) < 2e-6 for k, v in want.items() for i, s in v.items())


@pytest.mark.parametrize("least, passed", [(0.0, 20_000), (0.3, 20_000), (0.3, 7)])
def test_likeness_is_ranked_as_if_each_pair_was_looked_at(spark, monkeypatch, least, passed):
    monkeypatch.setattr(C, "PASS_QUERIES", passed)
    monkeypatch.setattr(C, "HELD_PAIRS", 500)
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda v: v / np.linalg.norm(v))(rng.normal(size=n))
    rows = [(i, float(rng.choice([0.0, 0.1, 0.15])), float(rng.choice([0.0, 0.85, 1.0, 1.9])), float(rng.choice([0.35, 1.0, 1.5])), bool(i % 9 == 0), None if i % 5 == 0 else unit(4 if i % 3 else 6)) for i in range(900)]
    queries = [(k, None if k % 6 == 0 else unit((4, 6, 3)[k % 3])) for k in range(60)]
    want = {}
    for k, q in queries:
        s = []
        for i, base, factor, usage, neg, u in rows:
            v = max(0.0, round(float(q @ u), 6)) if q is not None and u is not None and len(u) == len(q) else 0.0
            signal = 0.45 * v
            score = round(min(1.0, max(0.0, min(1.0, max(0.0, (signal + base) * factor)) * usage)), 9)
            if (signal >= 0.05 or neg) and score >= least:
                s.append((-score, i))
        want |= {(k, i): -x for x, i in sorted(s)[:11]}
    b = lambda u: None if u is None else bytearray(u.tobytes())
    df = spark.createDataFrame([r[:5] for r in rows], "id long, base double, factor double, usage double, neg boolean").repartition(3)
    vectors = spark.createDataFrame([(r[0], (7 * r[5]).tolist()) for r in rows if r[5] is not None], "id long, v array<double>")
    got = C._by_vector(df, vectors, spark.createDataFrame([(k, b(q)) for k, q in queries], "query_id long, u binary"), 11, least)
    got = {(r.query_id, r.id): r.score for r in got.collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def plain_resonance(found, links, alive, limit):
    out = {}
    edges = {}
    for a, b, w in links:
        for x, y in ((a, b), (b, a)):
            if y in alive:
                edges.setdefault(x, []).append((y, w))
    for q in {r[0] for r in found}:
        known = {i: s for k, i, s, _ in found if k == q}
        front = {i: s for k, i, s, n in found if k == q and n <= 3}
        for hop in C.HOPS:
            boosts = {}
            for i, s in front.items():
                for j, w in edges.get(i, ()):
                    boosts.setdefault(j, []).append(round(s * w * C.RESONANCE * hop, 12))
            front = {j: max(b) for j, b in boosts.items() if j not in known}
            known = {i: s + sum(boosts.get(i, ())) for i, s in known.items()} | front
        best = sorted((-round(min(1.0, max(0.0, s)), 9), i) for i, s in known.items())[:limit]
        out |= {(q, i): -s for s, i in best}
    return out


@pytest.mark.parametrize("low", [0.1, -0.4])
def test_the_last_hop_leaves_out_only_what_cannot_be_among_the_best(spark, low):
    rng = random.Random(8)
    n, queries = 3_000, 120
    links = [(0, i, rng.uniform(low, 1.0)) for i in range(1, n)]  # a hub, two hops from everything
    links += [(a, b, rng.uniform(low, 1.0)) for a, b in {tuple(sorted(rng.sample(range(1, n), 2))) for _ in range(2_000)}]
    found = [(q, i, round(rng.choice([0.2, 0.5, 0.999, 1.0]) * rng.uniform(0.98, 1.0), 9), r + 1) for q in range(queries) for r, i in enumerate(rng.sample(range(1, n), q % 6))]
    alive = {i for i in range(n) if i % 7 or not i}
    df = [spark.createDataFrame(x, s) for x, s in ((found, "query_id long, id long, score double, rank int"), (links, "a long, b long, w double"), ([(i, i in alive) for i in range(n)], "id long, is_active boolean"))]
    got, want = {(r.query_id, r.id): r.score for r in C.resonant(*df, 5).collect()}, plain_resonance(found, links, alive, 5)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-9 for x in want)


def test_a_hub_three_hops_off_is_not_written_out_for_each_query(spark):
    rng = random.Random(9)
    n, queries = 4_000, 100
    links = [(i, 51 + i % 10, 0.9) for i in range(1, 51)] + [(0, 51 + k, 0.9) for k in range(10)] + [(0, i, 0.9) for i in range(61, n)]
    found = [(q, i, 0.9 - r / 10, r + 1) for q in range(queries) for r, i in enumerate(rng.sample(range(1, 51), 5))]
    df = [spark.createDataFrame(x, s) for x, s in ((found, "query_id long, id long, score double, rank int"), (links, "a long, b long, w double"), ([(i, True) for i in range(n)], "id long, is_active boolean"))]
    rows, written = most_written(spark, lambda: C.resonant(*df, 5).collect())
    assert written < n * queries / 10
    got, want = {(r.query_id, r.id): r.score for r in rows}, plain_resonance(found, links, set(range(n)), 5)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-9 for x in want)


def plain_walk(found, links, facts, alive, limit):
    out = {}
    for q in {r[0] for r in found}:
        score = {i: s for k, i, s, _ in found if k == q}
        near = {}
        for a, b, w in links:
            for x, y in ((a, b), (b, a)):
                if x in score:
                    near[y] = max(w, near.get(y, w))
        names = {e for p in sorted({(s, o) for s, o, i in facts if i in score})[:40] for e in p}
        held = sorted({i for s, o, i in facts if s in names or o in names})[:40]
        nodes = (set(score) | set(sorted(near, key=lambda x: (-near[x], x))[:40]) | set(held)) & alive
        edges = [e for a, b, w in links if a in nodes and b in nodes for e in ((a, b, w), (b, a, w))]
        edges += [e for s, o, i in facts if i in nodes for n in (s, o) for e in ((i, n, 0.75), (n, i, 0.75))]
        total = {}
        for a, _, w in edges:
            total[a] = total.get(a, 0.0) + w
        start = {i: max(0.1, s) for i, s in score.items() if i in alive}
        start = {i: s / sum(start.values()) for i, s in start.items()}
        rank = start
        for _ in range(C.ROUNDS):
            lost = sum(x for i, x in rank.items() if i not in total)
            moved = {i: s * (0.15 + 0.85 * lost) for i, s in start.items()}
            for a, b, w in edges:
                moved[b] = moved.get(b, 0.0) + 0.85 * rank.get(a, 0.0) * w / total[a]
            rank = moved
        ends = {i: s + 0.25 * rank.get(i, 0.0) for i, s in score.items()} | {i: 0.4 * x for i, x in rank.items() if isinstance(i, int) and i not in score and x > 0.05}
        out |= {(q, i): -s for s, i in sorted((-round(min(1.0, s), 9), i) for i, s in ends.items())[:limit]}
    return out


@pytest.mark.parametrize("walked", [100_000, 50])
def test_the_walk_does_not_write_a_hub_out_for_each_query(spark, monkeypatch, walked):
    monkeypatch.setattr(C, "WALKED_ROWS", walked)
    rng = random.Random(10)
    n, queries = 2_000, 100
    links = [(0, i, round(rng.uniform(0.1, 1.0), 3)) for i in range(1, n)]
    links += [(a, b, rng.uniform(0.1, 1.0)) for a, b in {tuple(sorted(rng.sample(range(1, n), 2))) for _ in range(3_000)}]
    alive = {i for i in range(n) if i % 7 or not i}
    facts = [(f"name{rng.randrange(60)}", f"thing{rng.randrange(300)}", rng.randrange(1, n)) for _ in range(1_500)]
    found = [(q, i, round(rng.uniform(0.01, 0.7), 9), r + 1) for q in range(queries) for r, i in enumerate(([0] if q % 9 else []) + rng.sample(range(1, n), q % 4))] + [(queries, 7, 0.5, 1)]
    df = [spark.createDataFrame(x, s) for x, s in ((found, "query_id long, id long, score double, rank int"), (links, "a long, b long, w double"),
          ([(k, s, "p", o, i, None, True) for k, (s, o, i) in enumerate(facts)], "id long, subject string, predicate string, object string, memory_id long, confidence double, is_active boolean"),
          ([(i, i in alive) for i in range(n)], "id long, is_active boolean"))]
    rows, written = most_written(spark, lambda: C.ranked_by_graph(*df, 5).collect())
    got, want = {(r.query_id, r.id): r.score for r in rows}, plain_walk(found, links, facts, alive, 5)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-9 for x in want)
    assert written < n * queries / 5  # the hub's links for each query would be n * queries


def test_odd_vectors_are_told_without_a_function_for_each_number(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, -0.0], [1.0, 2.0], [nan, 1.0], [inf, 1.0], [-inf, 1.0], [None, 1.0], [-3.0, -3.0], [2.0, -1.0], [5.0], [1e30, 1e30]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "id int, v array<float>")
    assert "lambda" not in df.where(C._usable("v"))._jdf.queryExecution().analyzed().toString()
    fine = df.where(C._usable("v"))
    assert {r.id for r in fine.collect()} == {r.id for r in df.select("id", F.col("v").cast("array<double>").alias("v")).where(C._usable("v")).collect()} == {3, 8, 9, 10, 11}
    pairs = df.where("not id in (4, 5, 6, 7)").crossJoin(fine.select("id", "v").toDF("other", "w")).repartition(3)
    for r in pairs.select("id", "other", C._likeness()("v", "w").alias("got"), F.coalesce(R.cosine("v", "w"), F.lit(0.0)).alias("want")).collect():
        assert abs(r.got - r.want) < 1e-12, r
