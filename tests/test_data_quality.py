"""p3 and p4: nulls, ties, repeats, empty tables and clashing columns, against plain Python."""

import random
from datetime import datetime, timedelta

from sediment.operators import history, references
from sediment.operators.components import connected_components
from sediment.operators.segments import carry_lag, carry_last, carry_lead, carry_sum, range_segments
from sediment.operators.skew import lookup_join

T0 = datetime(2025, 1, 1)
TRIPLE = "id long, subject string, predicate string, object string, memory_id long, is_active boolean, valid_from timestamp, created_at timestamp, _seg int, reason string, ref_id long"
LINK = "source_id long, target_id long, last_linked_at timestamp, born string, _n int"
MEMORY = "id long, is_active boolean, created_at timestamp, updated_at timestamp, ref_id string, deleted string"
KIND = "predicate string, is_multi_valued boolean"


def triple(i, s="a", p="P", o="x", m=None, active=True, valid=None, made=T0):
    return (i, s, p, o, m, active, valid, made, 9, "clash", 5)


def tables(spark, triples=(), links=(), memories=()):
    return spark.createDataFrame(list(triples), TRIPLE), spark.createDataFrame(list(links), LINK), spark.createDataFrame(list(memories), MEMORY)


def test_reasons_ties_and_nulls(spark):
    day = timedelta(days=1)
    t, a, m = tables(
        spark,
        [triple(1, m=99), triple(2, m=10), triple(3, m=11), triple(4, m=11, active=False), triple(5, m=12), triple(6, m=None), triple(7, m=12, made=None), triple(1, m=99)],
        [(10, 11, T0 + day, "c", 1), (10, 11, T0 + day, "c", 1), (None, 10, T0, "c", 1), (77, None, None, "c", 1)],
        [(10, True, T0 - day, T0, "r", "d"), (11, True, T0 - day, T0, "r", "d"), (11, False, T0 - day, T0 + day, "r", "d"), (12, True, T0 + day, T0, "r", "d"), (None, True, T0, T0, "r", "d")],
    )
    got = {(r.table_name, r.field_name, r.row_key, r.ref_id, r.period, r.reason) for r in references.broken_references(t, a, m).collect()}
    assert got == {
        ("entity_triples", "memory_id", "1", 99, "2025-01", "missing"),
        ("entity_triples", "memory_id", "3", 11, "2025-01", "deleted"),
        ("entity_triples", "memory_id", "5", 12, "2025-01", "late"),
        ("associative_links", "target_id", "10|11", 11, "2025-01", "deleted"),
        ("associative_links", "source_id", "77", 77, None, "missing"),
    }


def test_no_memories_and_empty_tables(spark):
    t, a, m = tables(spark, [triple(1, m=5)])
    assert [r.reason for r in references.broken_references(t, a, m).collect()] == ["missing"]
    t, a, m = tables(spark)
    assert references.broken_references(t, a, m).count() == 0
    kinds = spark.createDataFrame([], KIND)
    assert history.changed_attributes(t, kinds).count() == 0
    assert history.entity_states(t, kinds).count() == 0


def naive_versions(rows):
    best = {}
    for i, s, p, o, valid, made in rows:
        at = made if valid is None or valid.date() == datetime(1970, 1, 1).date() else valid
        if None in (s, o, at):
            continue
        k = (s.strip().lower(), p, at)
        best[k] = max(best.get(k, (datetime(1900, 1, 1), -1, "")), (made, i, o.strip().lower()))
    series = {}
    for (s, p, at), (_, _, o) in sorted(best.items()):
        v = series.setdefault((s, p), [])
        if not v or v[-1][0] != o:
            v.append((o, at))
    return {(s, p, o, at, v[k + 1][1] if k + 1 < len(v) else None) for (s, p), v in series.items() if len(v) > 1 for k, (o, at) in enumerate(v)}


def test_versions_of_random_logs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        s = "Hot " if i % 3 == 0 else rng.choice([" a", "B", "c", None])
        at = T0 + timedelta(hours=rng.randrange(40))
        valid = rng.choice([at, at, at, None, datetime(1970, 1, 1)])
        rows.append((rng.randrange(500), s, rng.choice(["P", "Q", "M"]), rng.choice(["x", "X ", "y", None]), valid, at + timedelta(minutes=rng.randrange(3))))
    # a repeated id is an equal row or another assertion; both are allowed
    t = spark.createDataFrame([triple(i, s, p, o, valid=v, made=c) for i, s, p, o, v, c in rows], TRIPLE)
    kinds = spark.createDataFrame([("P", False), ("Q", False), ("M", True), ("P", False)], KIND)
    got = {(r.subject, r.predicate, r.object, r.valid_from, r.valid_until) for r in history.attribute_versions(t, kinds).where("valid_until is not null or previous is not null").collect()}
    assert got == naive_versions([r for r in rows if r[2] != "M"])


def test_states_split_at_every_boundary(spark):
    h = lambda n: T0 + timedelta(hours=n)
    t = spark.createDataFrame([triple(1, p="P", o="1", valid=h(0)), triple(2, p="Q", o="u", valid=h(1)), triple(3, p="P", o="2", valid=h(2)), triple(4, p="P", o="2", valid=h(3))], TRIPLE)
    kinds = spark.createDataFrame([("P", False), ("Q", False)], KIND)
    got = sorted((r.valid_from, r.valid_until, tuple(r.attributes)) for r in history.entity_states(t, kinds).collect())
    assert got == [(h(0), h(1), ("P=1",)), (h(1), h(2), ("P=1", "Q=u")), (h(2), None, ("P=2", "Q=u"))]


def test_segments_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 2 else f"k{i % 7}", i // 3, i, rng.choice([None, 1, 2])) for i in range(400)]
    seg = range_segments(spark.createDataFrame(rows, "k string, t long, id long, v long"), ["k"], ["t", "id"], 13)
    out = carry_lag(seg, ["k"], ["t", "id"], seg["v"], "prev")
    out = carry_lead(out, ["k"], ["t", "id"], out["v"], "nxt")
    out = carry_last(out, ["k"], ["t", "id"], {"seen": out["v"]})
    out = carry_sum(out, ["k"], ["t", "id"], out["id"], "total")
    got = {r.id: (r.prev, r.nxt, r.seen, r.total) for r in out.collect()}
    for k in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == k], key=lambda r: r[1:3])
        seen, total = None, 0
        for i, r in enumerate(mine):
            prev, nxt, s, t = got[r[2]]
            assert (prev is None) == (i == 0) and (nxt is None) == (i == len(mine) - 1)
            assert i == 0 or prev.v == mine[i - 1][3]
            assert (s, t) == (seen, total)
            seen, total = r[3] if r[3] is not None else seen, total + r[2]


def test_lookup_join_with_a_hot_key(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(90)] + [(100, None)], "i long, k long")
    right = spark.createDataFrame([(1, "one"), (3, "three")], "k long, name string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = sorted(map(tuple, lookup_join(left, right, "k", how, hot_rows=10).select("i").collect()))
        assert got == sorted(map(tuple, left.join(right, "k", how).select("i").collect()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30, 40: 40}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
