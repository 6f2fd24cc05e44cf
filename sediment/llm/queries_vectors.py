"""Queries p1 and p2 on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.llm.grouping import group_recall, leaf_report, similar_groups
from sediment.llm.neighbours import missed, mutual, nearest, true_lists
from sediment.runtime import materialize
from sediment.sources import tables

#: For whole lists (not only near copies) a query reads this many inverted files of so many pivots, ranks them by
#: permutations of that length and compares this share: constant shares of all rows, so that recall does not fall
#: as the table grows.
WIDE, PIVOTS, LONG, WIDE_SHARE = 20, 128, 64, 0.3
#: Cosine that p2_found asks for.
FLOOR = 0.96


def p1_found(spark, d):
    v, m = tables(spark, d, "memory_vectors", "memories")
    return similar_groups(v, m).where("first_id != memory_id")


def p1_leaves(spark, d):
    v, m = tables(spark, d, "memory_vectors", "memories")
    return leaf_report(v, m)


def p1_recall(spark, d):
    """How many of the alike pairs of every memory whose id is divisible by 50 lie in one cluster of p1_found (pairs included)."""
    v, m = tables(spark, d, "memory_vectors", "memories")
    return group_recall(v, m)


def p2_found(spark, d):
    (v,) = tables(spark, d, "memory_vectors")
    return mutual(nearest(v, floor=FLOOR), FLOOR)


def _lists(v):
    return nearest(v, every=50, asked=WIDE, share=WIDE_SHARE, ordered=LONG, most_pivots=PIVOTS)


def p2_nearest(spark, d):
    """The five most similar memories of every memory whose id is divisible by 50, against all rows."""
    (v,) = tables(spark, d, "memory_vectors")
    return _lists(v)


def p2_recall(spark, d):
    """How many true neighbours are missed, of every usable memory whose id is divisible by 50: by the lists of
    p2_nearest, and by those p2_found is made of (with the cosine it asks for)."""
    (v,) = tables(spark, d, "memory_vectors")
    true = materialize(true_lists(v))
    whole = missed(true, _lists(v)).select(F.lit("p2_nearest").alias("lists"), "*")
    close = missed(true.where(F.col("cosine") >= FLOOR), nearest(v, floor=FLOOR, every=50)).select(F.lit("p2_found").alias("lists"), "*")
    return whole.union(close)


QUERIES = {"p1_found": p1_found, "p1_leaves": p1_leaves, "p1_recall": p1_recall, "p2_found": p2_found, "p2_nearest": p2_nearest, "p2_recall": p2_recall}

_UNIT = """
WITH u AS (
  SELECT memory_id, any_value(CAST(vector AS DOUBLE[])) AS v FROM memory_vectors
  WHERE memory_id IS NOT NULL AND len(vector) = 128 AND NOT list_contains(list_transform(vector, lambda x: isfinite(x)), false)
    AND list_contains(list_transform(vector, lambda x: x != 0), true) GROUP BY memory_id)
"""

ORACLE = {
    "p1_found": _UNIT.replace("WITH u", "WITH RECURSIVE u") + """,
m AS (SELECT id, lower(trim(arg_max(category, updated_at))) AS c FROM memories GROUP BY id),
k AS (SELECT memory_id, v, c FROM u JOIN m ON m.id = memory_id WHERE c IS NOT NULL),
e AS (SELECT a.memory_id AS x, b.memory_id AS y FROM k a JOIN k b ON a.c = b.c AND a.memory_id != b.memory_id AND list_cosine_similarity(a.v, b.v) >= 0.72),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
f AS (SELECT x AS memory_id, least(x, min(y)) AS first_id FROM r GROUP BY x),
g AS (SELECT first_id FROM f GROUP BY first_id HAVING count(*) >= 3)
SELECT first_id, memory_id FROM f WHERE first_id != memory_id AND first_id IN (SELECT first_id FROM g)""",
    "p2_found": _UNIT + """,
s AS (SELECT a.memory_id AS x, b.memory_id AS y, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.memory_id != b.memory_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS n FROM s) WHERE n <= 5)
SELECT a.x AS memory_id_a, a.y AS memory_id_b FROM t a JOIN t b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y AND a.c >= 0.96""",
}
