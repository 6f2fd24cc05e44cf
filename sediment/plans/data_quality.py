"""Queries p3 (references to records that do not exist) and p4 (history of changing attributes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.operators.history import changed_attributes, entity_states
from sediment.operators.references import broken_reference_report, broken_references
from sediment.sources import tables


def p3_found(spark, d):
    m, t, a = tables(spark, d, "memories", "entity_triples", "associative_links")
    return broken_references(t, a, m).drop("reason")


def p3_report(spark, d):
    m, t, a = tables(spark, d, "memories", "entity_triples", "associative_links")
    return broken_reference_report(t, a, m)


def p4_found(spark, d):
    t, k = tables(spark, d, "entity_triples", "predicate_kinds")
    return changed_attributes(t, k)


def p4_states(spark, d):
    t, k = tables(spark, d, "entity_triples", "predicate_kinds")
    s = entity_states(t, k)
    ms = lambda c: F.coalesce(F.unix_millis(c), F.lit(-1).cast("long"))
    return s.select("subject", ms("valid_from").alias("valid_from_ms"), ms("valid_until").alias("valid_until_ms"), F.concat_ws(";", "attributes").alias("state"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_states": p4_states}

_P3 = """
WITH parent AS (
  SELECT id, min(created_at) AS born, arg_max(coalesce(is_active, true), (coalesce(updated_at, TIMESTAMP '0001-01-01'), coalesce(is_active, true))) AS alive
  FROM memories WHERE id IS NOT NULL GROUP BY id),
refs AS (
  SELECT 'entity_triples' AS table_name, 'memory_id' AS field_name, CAST(id AS VARCHAR) AS row_key, memory_id AS ref_id, created_at AS ts, coalesce(is_active, false) AS act
  FROM entity_triples WHERE memory_id IS NOT NULL
  UNION ALL SELECT 'associative_links', 'source_id', concat_ws('|', source_id, target_id), source_id, last_linked_at, true FROM associative_links WHERE source_id IS NOT NULL
  UNION ALL SELECT 'associative_links', 'target_id', concat_ws('|', source_id, target_id), target_id, last_linked_at, true FROM associative_links WHERE target_id IS NOT NULL),
judged AS (
  SELECT r.*, strftime(ts, '%Y-%m') AS period,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN NOT p.alive AND act THEN 'deleted' WHEN p.born > ts THEN 'late' END AS reason
  FROM refs r LEFT JOIN parent p ON p.id = r.ref_id),
one AS (
  SELECT table_name, field_name, row_key, ref_id, period, max(reason) AS reason FROM judged WHERE reason IS NOT NULL GROUP BY ALL)
"""

_P4 = """
WITH a AS (
  SELECT lower(trim(subject)) AS subject, t.predicate, lower(trim(object)) AS object,
    CASE WHEN valid_from IS NULL OR CAST(valid_from AS DATE) = DATE '1970-01-01' THEN created_at ELSE valid_from END AS ts, created_at, id
  FROM entity_triples t JOIN (SELECT DISTINCT predicate FROM predicate_kinds WHERE NOT is_multi_valued) k ON k.predicate = t.predicate),
one AS (
  SELECT subject, predicate, ts, arg_max(object, (created_at, id)) AS object FROM a
  WHERE subject IS NOT NULL AND object IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
runs AS (SELECT *, lag(object) OVER (PARTITION BY subject, predicate ORDER BY ts) AS prev FROM one),
v AS (
  SELECT subject, predicate, object, ts, prev, lead(ts) OVER (PARTITION BY subject, predicate ORDER BY ts) AS until
  FROM runs WHERE prev IS NULL OR prev != object)
"""

ORACLE = {
    "p3_found": _P3 + "SELECT table_name, field_name, row_key, ref_id, period FROM one",
    "p3_report": _P3 + "SELECT table_name, field_name, period, reason, count(*) AS n FROM one GROUP BY ALL",
    "p4_found": _P4 + """
SELECT subject, predicate, object, epoch_ms(ts) AS valid_from_ms, coalesce(epoch_ms(until), -1) AS valid_until_ms
FROM v WHERE prev IS NOT NULL OR until IS NOT NULL""",
    "p4_states": _P4 + """,
cuts AS (SELECT DISTINCT subject, ts FROM v),
st AS (
  SELECT c.subject, c.ts, string_agg(v.predicate || '=' || v.object, ';' ORDER BY v.predicate) AS state
  FROM cuts c JOIN v ON v.subject = c.subject AND v.ts <= c.ts AND (v.until IS NULL OR v.until > c.ts) GROUP BY ALL),
ch AS (SELECT *, lag(state) OVER (PARTITION BY subject ORDER BY ts) AS prev FROM st),
kept AS (SELECT * FROM ch WHERE prev IS NULL OR prev != state)
SELECT subject, epoch_ms(ts) AS valid_from_ms, coalesce(epoch_ms(lead(ts) OVER (PARTITION BY subject ORDER BY ts)), -1) AS valid_until_ms, state FROM kept""",
}
