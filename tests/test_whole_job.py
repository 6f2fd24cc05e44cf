"""Cases that a cut, a sample or a block of the input would lose."""

import datetime as dt

import numpy as np
import pytest

from sediment.operators import leaders, retrieval
from sediment.plans import registry

AT = dt.datetime(2025, 1, 1)


def test_preflight_counts_every_prohibition(spark, tmp_path):
    rules = [f"never copy aa{k:04d} into bb{k:04d}" for k in range(1005)] + ["never unplug", "never zzap the zzoo"]
    rows = [(k, r, "rule", 0, AT, True, True) for k, r in enumerate(rules)] + [(5000, "Never unplug", "rule", 0, AT, True, True)]
    spark.createDataFrame(rows, "id long, content string, category string, access_count int, updated_at timestamp, is_active boolean, is_negative_constraint boolean").write.parquet(f"{tmp_path}/memories.parquet")
    notes = [(1, "tool", "ZZAP-zzoo"), (2, " Function", "xaa0001y: copybb0001"), (3, "tool", "unplugged"), (4, "user", "unplug"), (5, "tool", "nothing"), (6, "tool", "copy aa0002 and aa0003 into unplug"), (6, "tool", "unplug")]
    spark.createDataFrame(notes, "id long, role string, content string").write.parquet(f"{tmp_path}/notes.parquet")
    got = {r.id: r.rules for r in registry.queries()["preflight"](spark, str(tmp_path)).collect()}
    brute = {}
    for i, role, a in notes:
        for r in set(map(str.lower, rules)) if role.strip().lower() in ("tool", "function") else ():
            ws = {w for w in r.replace("never", " ").split() if len(w) >= 4}
            if sum(w in a.lower() for w in ws) >= min(2, len(ws)):
                brute[i] = brute.get(i, 0) + 1
    assert got == brute and {1, 2, 3, 6} == set(got)


def test_rules_met_without_rules(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, a string")
    assert retrieval.rules_met(texts, spark.createDataFrame([], "ws array<string>")).count() == 0


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_leaders_do_not_depend_on_blocks(spark, monkeypatch, spread):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    x = [centres[k % 6] + rng.normal(size=8) * spread for k in range(400)]
    vectors = [[float(v) for v in y] for y in x]
    vectors[50], vectors[51], vectors[52] = None, [0.0] * 8, [1.0, 0.0]
    want, seen = {}, {}
    for i, v in enumerate(vectors):
        v = np.array(v if v is not None else [])
        v = v / np.linalg.norm(v) if v.any() else v
        known = seen.setdefault(len(v), [])
        best = max(known, key=lambda e: e[1] @ v, default=None) if v.any() else None
        if best is not None and best[1] @ v >= 0.55:
            want[i] = best[0]
        else:
            want[i] = i
            if v.any():
                known.append((i, v))
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").repartition(5)
    for size in (64_000_000, 100):
        monkeypatch.setattr(leaders, "PASS_BYTES", size)
        for block in (16, 4096):
            assert {r.id: r.leader for r in leaders.leader_clusters(df, "id", "v", block_rows=block).collect()} == want


def test_aliases_at_every_position(spark, tmp_path):
    texts = ["When Talia Quillmere is away", "ask scribe-2, then SCRIBE-2 scribe-2!", "zoë ummerdal and Talia Quillmere-Noll", "xscribe-2 scribe-21 Talia  Quillmere", "Talia Quillmere Talia Quillmere"]
    rows = [(k, t, "fact", 0, AT, True) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "id long, content string, category string, access_count int, updated_at timestamp, is_active boolean").write.parquet(f"{tmp_path}/memories.parquet")
    names = [(1, "Talia Quillmere"), (2, "scribe-2"), (3, "Zoë Ummerdal"), (4, "Talia Quillmere-Noll"), (5, None)]
    spark.createDataFrame(names, "id long, name string").write.parquet(f"{tmp_path}/personas.parquet")
    got = {r.id: (r.people, r.text) for r in registry.queries()["resolve_aliases"](spark, str(tmp_path)).collect()}
    assert got == {
        0: ("person-1", "When person-1 is away"),
        1: ("person-2", "ask person-2, then person-2 person-2!"),
        2: ("person-3,person-4", "person-3 and person-4"),
        4: ("person-1", "person-1 person-1"),
    }
