"""Recall with vectors, feedback and the graph, for every memory whose id is divisible by 50 as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import words as W
from sediment.operators import recall as C
from sediment.operators import reports as P
from sediment.operators import retrieval as R
from sediment.plans.common import AS_OF_SQL, FACTS_SQL, LINKS_SQL, MEMORIES_SQL, facts, links, memories, now
from sediment.plans.report_queries import _LOG, _USAGE, _log
from sediment.plans.retrieval_queries import _BM25
from sediment.plans.text_queries import _in
from sediment.runtime import materialize
from sediment.sources import table


def _found(spark, d):
    m, v = memories(spark, d), table(spark, d, "memory_vectors")
    q = m.where("id % 50 = 0 and content is not null").select(F.col("id").alias("query_id"), F.col("content").alias("text"))
    stored = v.select(F.col("memory_id").alias("query_id"), "vector")
    text = F.concat_ws(" ", "content", "category", F.array_join("tags", " "))
    lexical = R.bm25(materialize(R.postings(m, "id", text)), q)
    return materialize(C.hybrid_search(R.valid(m, now()), v, lexical, q.join(stored, "query_id", "left"), P.usage(_log(spark, d)), now()))


def recall_hybrid(spark, d):
    """The best five by words, vectors, recency and feedback."""
    return _found(spark, d)


def recall_resonance(spark, d):
    """The same after spreading activation."""
    return C.resonant(_found(spark, d), links(spark, d), memories(spark, d))


def recall_graph(spark, d):
    """The same after the walk over memories and entities around the results."""
    m, l = materialize(memories(spark, d).select("id", "is_active")), materialize(links(spark, d).select("a", "b", "w"))  # read by both steps
    found = materialize(C.resonant(_found(spark, d), l, m))
    return C.ranked_by_graph(found, l, facts(spark, d), m)


def recall_triples(spark, d):
    """The active triples of each result."""
    return C.attached(_found(spark, d), facts(spark, d))


def recall_effects(spark, d):
    """Links between memories recalled together, to be written after a recall."""
    return C.side_effects(_found(spark, d))[1]


def drift_alerts(spark, d):
    """Stored statements that mark a change, against what they are closest to."""
    m = memories(spark, d)
    v = table(spark, d, "memory_vectors")
    said = m.select("id", "content").join(v.select(F.col("memory_id").alias("id"), "vector"), "id")
    return C.drifted(said, m, v)


QUERIES = {f.__name__: f for f in (drift_alerts, recall_hybrid, recall_resonance, recall_graph, recall_triples, recall_effects)}

_QUERY = _BM25.replace("qu AS (SELECT working_style AS text, min(id) AS query_id FROM personas WHERE working_style IS NOT NULL GROUP BY 1)", "qu AS (SELECT content AS text, id AS query_id FROM m WHERE id % 50 = 0 AND content IS NOT NULL)")
assert _QUERY != _BM25
_HALF = " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.HALF_LIFE.items())
_LIVE = f"is_active AND valid_from <= {AS_OF_SQL} AND (valid_until IS NULL OR valid_until >= {AS_OF_SQL})"
_FOUND = f"WITH {MEMORIES_SQL}, {FACTS_SQL}, {LINKS_SQL}, {_LOG}, us AS ({_USAGE}), {_QUERY}" + f""",
vs AS (SELECT memory_id, min(CAST(vector AS DOUBLE[])) AS v FROM memory_vectors WHERE memory_id IS NOT NULL AND len(vector) > 0 AND NOT list_contains(list_transform(vector, lambda x: isfinite(x)), false)
  AND list_contains(list_transform(vector, lambda x: x != 0), true) GROUP BY 1),
fx AS (SELECT m.id, coalesce(is_negative_constraint, false) AS neg, round(0.15 * coalesce(exp(-ln(2) / CASE category {_HALF} ELSE {W.DEFAULT_HALF_LIFE} END * greatest(0.0, (epoch_us({AS_OF_SQL}) - epoch_us(last_accessed_at)) / 86400000000.0)), 0.0), 12) AS base,
  CASE WHEN is_negative_constraint THEN 1.45 ELSE 1.0 END::DOUBLE * CASE importance WHEN 'critical' THEN 1.35 WHEN 'high' THEN 1.15 WHEN 'low' THEN 0.85 ELSE 1.0 END * CASE WHEN outcome = 'failure' THEN 1.25 ELSE 1.0 END * coalesce(confidence, 1.0)
  * CASE WHEN valid_until IS NULL THEN 1.0 WHEN epoch_ms(valid_until) > epoch_ms({AS_OF_SQL}) THEN greatest(0.1, (epoch_ms(valid_until) - epoch_ms({AS_OF_SQL}))::DOUBLE / greatest(1.0, (epoch_ms(valid_until) - epoch_ms(created_at))::DOUBLE)) ELSE 0.8 END AS factor,
  CASE WHEN us.id IS NULL THEN 1.0 ELSE least(1.5, greatest(0.35, 1.0 + 0.05 * helped - 0.2 * misled)) END::DOUBLE AS usage FROM m LEFT JOIN us ON us.id = m.id WHERE {_LIVE}),
al AS (SELECT qu.query_id, fx.*, CASE WHEN q.v IS NOT NULL THEN 0.45 * greatest(0.0, coalesce(round(CASE WHEN len(q.v) = len(vs.v) THEN list_cosine_similarity(q.v, vs.v) END, 6), 0.0)) + 0.25 * coalesce(bm25, 0.0) ELSE 0.7 * coalesce(bm25, 0.0) END::DOUBLE AS signal
  FROM qu LEFT JOIN vs q ON q.memory_id = qu.query_id CROSS JOIN fx LEFT JOIN vs ON vs.memory_id = fx.id LEFT JOIN b5 ON b5.query_id = qu.query_id AND b5.doc = fx.id)"""
_FOUND += """,
s1 AS (SELECT query_id, id, round(least(1.0, greatest(0.0, least(1.0, greatest(0.0, (signal + base) * factor)) * usage)), 9) AS score FROM al WHERE signal >= 0.05 OR neg),
f0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s1 WHERE score >= 0.2) WHERE rank <= 5)"""
_RESONANT = ", eg AS (SELECT e.src, e.dst, e.w FROM (SELECT a AS src, b AS dst, w FROM l UNION ALL SELECT b, a, w FROM l) e JOIN m ON m.id = e.dst AND m.is_active), n0 AS (SELECT query_id, id, score, rank <= 3 AS new FROM f0)"
for _k, _hop in enumerate(C.HOPS):
    _RESONANT += f""", b{_k} AS (SELECT query_id, dst AS id, sum(round(score * w * 0.15 * {_hop}, 12)) AS al, max(round(score * w * 0.15 * {_hop}, 12)) AS mo FROM n{_k} JOIN eg ON eg.src = n{_k}.id WHERE new GROUP BY ALL),
n{_k + 1} AS (SELECT query_id, id, coalesce(n.score + coalesce(al, 0.0), mo) AS score, n.score IS NULL AS new FROM n{_k} n FULL JOIN b{_k} b USING (query_id, id))"""
_RESONANT += f""", r0 AS (SELECT query_id, id, round(least(1.0, greatest(0.0, score)), 9) AS score FROM n{len(C.HOPS)}),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r0) WHERE rank <= 5)"""
_INFORMATIVE = f"length(trim({{0}})) > 2 AND lower(trim({{0}})) NOT IN {_in(W.STOPWORDS + W.GENERIC)}"
_GRAPH = f""", bo AS (SELECT a AS id, b AS other, w FROM l UNION ALL SELECT b, a, w FROM l),
sa AS (SELECT memory_id, subject, object, coalesce(confidence, 1.0) AS confidence FROM t WHERE is_active AND memory_id IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL),
ne AS (SELECT query_id, other, row_number() OVER (PARTITION BY query_id ORDER BY max(w) DESC, other) AS rn FROM f1 JOIN bo USING (id) GROUP BY query_id, other),
pa AS (SELECT query_id, subject, object, row_number() OVER (PARTITION BY query_id ORDER BY subject, object) AS rn FROM (SELECT DISTINCT query_id, subject, object FROM f1 JOIN sa ON memory_id = id)),
nm AS (SELECT DISTINCT query_id, e FROM (SELECT query_id, unnest([subject, object]) AS e FROM pa WHERE rn <= 40) WHERE {_INFORMATIVE.format('e')}),
sh AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id) AS rn FROM (SELECT DISTINCT query_id, memory_id FROM nm JOIN sa ON subject = e OR object = e)),
ps AS (SELECT query_id, x.id FROM (SELECT query_id, id FROM f1 UNION SELECT query_id, other FROM ne WHERE rn <= 40 UNION SELECT query_id, memory_id FROM sh WHERE rn <= 40) x JOIN m ON m.id = x.id AND m.is_active),
en AS (SELECT query_id, p.id, confidence, unnest([lower(subject), lower(object)]) AS e FROM ps p JOIN sa ON memory_id = p.id),
ed AS (SELECT p.query_id, 'm' || p.id AS src, 'm' || other AS dst, w FROM ps p JOIN bo ON bo.id = p.id JOIN ps o ON o.query_id = p.query_id AND o.id = other
  UNION ALL SELECT query_id, 'm' || id, 'e' || e, 0.75 * confidence FROM en WHERE {_INFORMATIVE.format('e')} UNION ALL SELECT query_id, 'e' || e, 'm' || id, 0.75 * confidence FROM en WHERE {_INFORMATIVE.format('e')}),
fl AS (SELECT query_id, src, dst, sum(w) / any_value(tw) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY query_id, src) AS tw FROM ed) GROUP BY ALL),
st AS (SELECT query_id, 'm' || id AS node, greatest(0.1, score) / sum(greatest(0.1, score)) OVER (PARTITION BY query_id) AS p0 FROM f1 JOIN ps USING (query_id, id)),
p0 AS (SELECT query_id, node, p0 AS pr FROM st)"""
for _k in range(1, C.ROUNDS + 1):
    _GRAPH += f""", x{_k} AS (SELECT query_id, sum(pr) AS lost FROM p{_k - 1} p WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.query_id = p.query_id AND fl.src = p.node) GROUP BY 1),
p{_k} AS (SELECT query_id, node, sum(v) AS pr FROM (SELECT fl.query_id, dst AS node, 0.85 * pr * p AS v FROM p{_k - 1} r JOIN fl ON fl.query_id = r.query_id AND fl.src = r.node
  UNION ALL SELECT st.query_id, node, st.p0 * (0.15 + 0.85 * coalesce(lost, 0.0)) FROM st LEFT JOIN x{_k} USING (query_id)) GROUP BY ALL)"""
_GRAPH += f""", pm AS (SELECT query_id, substr(node, 2)::BIGINT AS id, round(pr, 10) AS pr FROM p{C.ROUNDS} WHERE starts_with(node, 'm')),
g1 AS (SELECT query_id, id, CASE WHEN score IS NOT NULL THEN score + 0.25 * coalesce(pr, 0.0) WHEN pr > 0.05 THEN 0.4 * pr END AS score FROM f1 FULL JOIN pm USING (query_id, id)),
f2 AS (SELECT * FROM (SELECT query_id, id, round(least(1.0, greatest(0.0, score)), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(least(1.0, greatest(0.0, score)), 9) DESC, id) AS rank FROM g1 WHERE score IS NOT NULL) WHERE rank <= 5)"""

_CHANGE = " OR ".join(f"contains(lower(content), '{w}')" for w in W.CONTRAST)

ORACLE = {
    "drift_alerts": f"WITH {MEMORIES_SQL}" + """, vs AS (SELECT memory_id, min(CAST(vector AS DOUBLE[])) AS v FROM memory_vectors WHERE memory_id IS NOT NULL AND len(vector) > 0 AND NOT list_contains(list_transform(vector, lambda x: isfinite(x)), false)
  AND list_contains(list_transform(vector, lambda x: x != 0), true) GROUP BY 1),
x AS (SELECT a.id, b.id AS against, round(CASE WHEN len(p.v) = len(q.v) THEN list_cosine_similarity(p.v, q.v) END, 6) AS c FROM m a JOIN vs p ON p.memory_id = a.id CROSS JOIN m b JOIN vs q ON q.memory_id = b.id
  WHERE b.is_active AND a.id != b.id AND (""" + _CHANGE.replace("content", "a.content") + """)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC NULLS LAST, against) AS rn FROM x) SELECT id, against, round(c, 2) AS similarity FROM r WHERE rn = 1 AND c >= 0.4""",
    "recall_hybrid": _FOUND + " SELECT query_id, id, score, rank FROM f0",
    "recall_resonance": _FOUND + _RESONANT + " SELECT query_id, id, score, rank FROM f1",
    "recall_graph": _FOUND + _RESONANT + _GRAPH + " SELECT query_id, id, score, rank FROM f2",
    "recall_triples": _FOUND + " SELECT query_id, f0.id, t.id AS triple_id, subject, predicate, object FROM f0 JOIN t ON t.memory_id = f0.id WHERE t.is_active",
    "recall_effects": _FOUND + ", pr AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM f0 x JOIN f0 y ON x.query_id = y.query_id AND x.id != y.id GROUP BY ALL) SELECT a, b, n, round(least(0.95, 0.5 + 0.05 * (n - 1)), 6)::DOUBLE AS w FROM pr",
}
