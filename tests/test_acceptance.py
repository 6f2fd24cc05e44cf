"""The engine object end to end: recall cases by ability, and what it hands back for writing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sediment.engine import MemoryEngine
from sediment.operators import retrieval

T0 = datetime(2025, 6, 1)
SETUP = [
    (1, "The billing gateway listens on port 8443", "architecture", False), (2, "Never delete the ledger backups", "negative_constraint", True), (3, "User prefers tabs over spaces", "preference", False),
    (4, "Deploys run on the frost cluster since May", "fact", False), (5, "The old gateway used port 80", "fact", False),
]
CASES = [("billing port", 1), ("delete backups", 2), ("tabs or spaces", 3), ("frost cluster deploys", 4), ("quantum chromodynamics", None)]


def store(spark):
    rows = [(i, c, "global", k, "normal", ["t"], 0, T0, T0, T0, None, i != 5, T0, None, "neutral", n, 1.0, "active") for i, c, k, n in SETUP]
    return spark.createDataFrame(rows, "id long, content string, scope string, category string, importance string, tags array<string>, access_count int, last_accessed_at timestamp, created_at timestamp, updated_at timestamp, "
                                 "superseded_by_id long, is_active boolean, valid_from timestamp, valid_until timestamp, outcome string, is_negative_constraint boolean, confidence double, status string")


def test_recall_cases(spark):
    m, now = store(spark), F.lit("2025-06-02").cast("timestamp")
    q = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "query_id long, text string")
    lexical = retrieval.bm25(retrieval.postings(m, "id", F.col("content")), q)
    top = {r.query_id: r.id for r in retrieval.recall(retrieval.hybrid(retrieval.valid(m, now), lexical, now), 1, 0.25).collect()}
    hits = sum(top.get(k) == want for k, (_, want) in enumerate(CASES))
    assert hits / len(CASES) >= 0.85


def test_validity(spark):
    m = store(spark).withColumn("valid_until", F.when(F.col("id") == 1, F.lit("2025-06-01 12:00:00").cast("timestamp")))
    at = lambda s: F.lit(s).cast("timestamp")
    assert {r.id for r in retrieval.valid(m, at("2025-06-01 12:00:00")).collect()} == {1, 2, 3, 4}
    assert {r.id for r in retrieval.valid(m, at("2025-06-02")).collect()} == {2, 3, 4}
    assert retrieval.valid(m, at("2025-05-01")).count() == 0


def test_engine(spark, small, tmp_path):
    e = MemoryEngine(spark, small)
    q = spark.createDataFrame([(1, "rate limiter")], "query_id long, text string")
    assert e.recall(q).count() <= 5
    for name in ("conflicts", "upserts", "sweep_expired", "evict", "timeline", "diff", "decay", "history", "doctor", "broken_references", "card", "rules", "digest", "prime", "sessions", "rollup", "communities"):
        getattr(e, name)().collect()
    e.export_pack(str(tmp_path / "pack"))
    done, moved = e.import_pack(str(tmp_path / "pack"))
    assert done.count() == e.memories().where("is_active and content is not null").count() and done.where("action = 'inserted'").count() == 0 and moved.count() > 0
    e.read_pack(str(tmp_path / "pack")).where("id % 2 = 0").write.json(str(tmp_path / "torn" / "rows"))
    spark.read.json(str(tmp_path / "pack" / "checksums")).write.json(str(tmp_path / "torn" / "checksums"))
    with pytest.raises(ValueError):
        e.import_pack(str(tmp_path / "torn"))
    both = spark.createDataFrame([(1, "rate limiter", [1.0] * 128), (2, "nothing at all", None)], "query_id long, text string, vector array<float>")
    found = e.recall_full(both)
    assert {r.query_id for r in found.collect()} >= {1} and e.render(found).count() >= 1
    for name in ("blocks", "rule_lines", "session_counters", "recent_sessions", "community_list", "table_counts"):
        assert getattr(e, name)().count() > 0
    assert e.delete_block("scratchpad").where("name = 'scratchpad'").count() == 0
    e.backup(str(tmp_path / "b"))
    assert e.restored(str(tmp_path / "b")).memories().count() == e.memories().count()
    assert e.delete_by_source().count() == 0
    with pytest.raises(TypeError):
        e.delete_by_source(nothing=1)
