"""Recall, blocks and boards on empty tables, odd vectors, ties and clashing columns."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sediment.operators import beliefs as B
from sediment.operators import recall as C
from sediment.operators import reports as P
from sediment.operators import workspace as S

T0 = datetime(2025, 6, 1)
MEMORY = ("id long, content string, scope string, category string, importance string, last_accessed_at timestamp, created_at timestamp, is_active boolean, valid_until timestamp, outcome string, "
          "failure_reason string, is_negative_constraint boolean, confidence double, score double, rank int")


def memories(spark, rows):
    return spark.createDataFrame([(i, c, "global", "fact", None, T0, T0, True, None, o, None, n, None, 9.0, 9) for i, c, o, n in rows], MEMORY)


def found(spark, m, vectors, lexical, queries, used=()):
    return C.hybrid_search(
        m, spark.createDataFrame(vectors, "memory_id long, vector array<float>, score int"), spark.createDataFrame(lexical, "query_id long, doc long, bm25 double"),
        spark.createDataFrame(queries, "query_id long, vector array<float>"), spark.createDataFrame(list(used), "id long, helped long, misled long"), F.lit(T0), 3, 0.0,
    )


def test_vectors_find_what_words_do_not(spark):
    m = memories(spark, [(1, "a", None, False), (2, "b", None, False), (3, "c", "failure", None), (4, None, None, True), (5, "e", None, False)])
    vectors = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, None, 1), (None, [1.0, 0.0], 1)]
    got = found(spark, m, vectors, [(7, 5, 1.0), (8, 5, 1.0)], [(7, [2.0, 0.0]), (8, None), (9, [1.0, 2.0, 3.0])])
    by = {q: [(r.id, round(r.score, 4)) for r in sorted(got.where(F.col("query_id") == q).collect(), key=lambda r: r.rank)] for q in (7, 8, 9)}
    assert [i for i, _ in by[7]] == [1, 2, 5] and by[7][0][1] == 0.6 and by[7][2][1] == 0.4
    assert by[8] == [(5, 0.85), (4, 0.2175)]  # without a vector words count for all; a prohibition always does
    assert [i for i, _ in by[9]] == [4]
    less = found(spark, m, vectors, [], [(7, [2.0, 0.0])], [(1, 0, 9)])
    assert [r.id for r in less.orderBy("rank").collect()] == [2, 4, 1]  # a memory that misled falls behind


def test_recall_of_nothing(spark):
    m = memories(spark, [])
    none = found(spark, m, [], [], [(1, [1.0])])
    assert none.count() == 0 and found(spark, memories(spark, [(1, "a", None, False)]), [], [], []).count() == 0
    links = spark.createDataFrame([], "a long, b long, w double")
    facts = spark.createDataFrame([], "id long, subject string, predicate string, object string, memory_id long, confidence double, is_active boolean, created_at timestamp")
    assert C.resonant(none, links, m).count() == 0 and C.ranked_by_graph(none, links, facts, m).count() == 0
    assert C.attached(none, facts).count() == 0 and S.rendered(none, m).count() == 0 and B.contradictions(none, facts).count() == 0


def test_resonance_adds_to_known_and_brings_new(spark):
    m = memories(spark, [(i, "x", None, False) for i in range(1, 7)])
    start = spark.createDataFrame([(1, 1, 0.8, 1), (1, 2, 0.4, 2)], "query_id long, id long, score double, rank int")
    links = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 6, 1.0)], "a long, b long, w double")
    got = {r.id: r.score for r in C.resonant(start, links, m, 9).collect()}
    back = 0.12 * 0.15 * 0.5  # from 3 to 1
    assert abs(got[2] - (0.4 + 0.8 * 0.5 * 0.15)) < 1e-9 and abs(got[1] - (0.8 + 0.4 * 0.5 * 0.15 + back)) < 1e-9
    assert got[3] >= 0.12 and set(got) == {1, 2, 3, 4, 5}  # three hops


def test_remembered_and_imported_without_store(spark):
    m = spark.createDataFrame([], "id long, content string, is_active boolean, is_negative_constraint boolean, created_at timestamp")
    said = spark.createDataFrame([(1, "The cache is warm."), (2, "the CACHE is warm!"), (3, None), (4, "Done"), (5, "never drop the cache")], "id long, content string")
    got = {r.id: (r.action, r.target) for r in B.remembered(said, m).collect()}
    assert got == {1: ("inserted", None), 2: ("reinforced", 1), 4: ("dropped", None), 5: ("inserted", None)}
    rows = spark.createDataFrame([("memory", 7, None, '{"id":7,"content":"A","scope":"x"}'), ("memory", 9, None, '{"id":9,"content":"a!"}'), ("triple", 1, 9, '{"subject":"s","predicate":"p","object":"o"}'), ("triple", 2, 8, '{"subject":"s"}')],
                                 "kind string, id long, parent long, line string")
    done, moved = P.imported_pack(rows, m)
    assert sorted((r.old_id, r.id, r.action) for r in done.collect()) == [(7, 1, "inserted"), (9, 1, "reinforced")]
    assert [tuple(r) for r in moved.collect()] == [(1, "s", "p", "o")]


def test_boards_equal_a_plain_fold(spark):
    rng = random.Random(2)
    log = [(k, n, rng.choice(["x", "y", None]), rng.choice(["main", "b", "c"] if k % 3 else ["b", "c"])) for k in range(12) for n in range(rng.randint(1, 40))]
    want = {}
    for k, n, v, a in log:
        s = want.get(k)
        if s is None:
            want[k] = [v, a, 1, 0]
        elif s[0] != v:
            want[k] = [s[0], s[1], s[2], s[3] + 1] if s[1] in S.LEADERS else [v, a, s[2] + 1, s[3] + 1]
    df = spark.createDataFrame(log, "k int, n int, value string, author string").repartition(5)
    assert {r.k: [r.value, r.author, r.version, r.disputes] for r in S.arbitrated(df, ["k"], ["n"]).collect()} == want


def test_ratings_of_a_long_log_are_folded_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(B, "FOLDED", 7)
    rng = random.Random(5)
    log = [(k, T0 + timedelta(minutes=n), n, rng.choice(["helped", "helped", "misled"])) for k in range(3) for n in range(300)]
    want = {}
    for k, _, _, v in log:
        want[k] = min(1.0, max(0.05, want.get(k, 1.0) + (0.05 if v == "helped" else -0.15)))
    got = B.rated(spark.createDataFrame(log, "k int, at timestamp, seq int, verdict string").repartition(4), ["k"])
    assert {r.k: r.confidence for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_patterns_meet_texts_both_ways(spark):
    texts = ["disk quota exceeded on node 7", "quota", "???", "", None, "no match", "ab cd"]
    pats = ["quota exceeded", "disk quota exceeded now", "???", "b c", "node", "quo"]
    s = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.pattern) for r in P.playbooks(s, spark.createDataFrame([(p,) for p in pats], "pattern string")).collect()}
    want = {(i, p) for i, t in enumerate(texts) if t for p in pats if p in t or (len(t) >= 4 and t in p)}
    assert got == want and len(want) == 8
