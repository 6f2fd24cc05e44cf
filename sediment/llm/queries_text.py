"""Queries p5, p6, p7, p8 and p9 on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.llm.conversations import conversations
from sediment.llm.mixing import mixed
from sediment.llm.packing import packed_documents, packing_report
from sediment.llm.pii import ASKED, listed_people, redacted
from sediment.llm.truncation import truncated, truncation_report
from sediment.llm.tokens import counted
from sediment.sources import table, tables


def p5_found(spark, d):
    """As TESTDATA.md orders by the stored timestamps, no clock correction is allowed here."""
    return conversations(table(spark, d, "notes"), max_skew_ms=0).select("session_id", "position", "note_id")


def p5_conversations(spark, d):
    """Whole conversations with sender clocks corrected by up to two minutes."""
    return conversations(table(spark, d, "notes")).select("session_id", "position", "note_id", "role", F.unix_millis("at").alias("at_ms"))


def _with_pii(spark, d, clean=True):
    people = listed_people(table(spark, d, "personas"))
    parts = [
        redacted(table(spark, d, t).where("id is not null").select(F.lit(t).alias("table_name"), F.col("id").alias("row_id"), "content"), "content", people, clean)
        for t in ("memories", "notes")
    ]
    return parts[0].unionByName(parts[1])


def p6_found(spark, d):
    kinds = _with_pii(spark, d, clean=False).select("table_name", "row_id", F.explode("pii.kinds").alias("kind"))
    return kinds.where(F.col("kind").isin(*ASKED)).distinct()


def p6_redacted(spark, d):
    """Every row of memories and notes with placeholders in its text."""
    return _with_pii(spark, d).select("table_name", "row_id", F.col("pii.clean").alias("content"), F.array_join("pii.kinds", ",").alias("kinds"))


def p7_packed(spark, d):
    """All documents laid into containers of each capacity of context_blocks."""
    docs, blocks = tables(spark, d, "documents", "context_blocks")
    return packed_documents(counted(docs.select("doc_id", "text")).select("doc_id", "tokens"), blocks)


def p7_report(spark, d):
    docs, blocks = tables(spark, d, "documents", "context_blocks")
    return packing_report(packed_documents(counted(docs.select("doc_id", "text")).select("doc_id", "tokens"), blocks), blocks)


def _mix(spark, d):
    """Texts are counted once: mixed() keeps the sizes in a table."""
    docs, targets = tables(spark, d, "documents", "mix_targets")
    sized = counted(docs.where("trim(text) != ''").select("doc_id", "source", "text")).select("doc_id", "source", "tokens", F.sha2("text", 256).alias("key"))
    return mixed(sized, targets)


def p8_mix(spark, d):
    return _mix(spark, d)[0]


def p8_report(spark, d):
    return _mix(spark, d)[1]


def p9_found(spark, d):
    return truncated(table(spark, d, "documents")).select("doc_id").distinct()


def p9_report(spark, d):
    return truncation_report(table(spark, d, "documents"))


QUERIES = {"p5_found": p5_found, "p5_conversations": p5_conversations, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_packed": p7_packed, "p7_report": p7_report, "p8_mix": p8_mix,
           "p8_report": p8_report, "p9_found": p9_found, "p9_report": p9_report}

_P5 = """
WITH r AS (
  SELECT session_id, id, timestamp AS ts, content,
    CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'agent', 'ai') THEN 'assistant'
         WHEN lower(trim(role)) IN ('system', 'sys') THEN 'system' WHEN lower(trim(role)) IN ('tool', 'function') THEN 'tool' ELSE '?' || lower(trim(role)) END AS said
  FROM notes WHERE session_id IS NOT NULL AND id IS NOT NULL),
one AS (SELECT DISTINCT * FROM r),
m AS (
  SELECT session_id, ts, min(id) AS id, CASE WHEN said NOT LIKE '?%' THEN said END AS role,
    coalesce(regexp_matches(content, '[^\\s\\p{Z}\\p{C}]'), false) AS visible
  FROM one GROUP BY session_id, said, content, ts),
o AS (
  SELECT *, row_number() OVER w AS position,
    last_value(CASE WHEN role IN ('user', 'assistant') THEN role END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spoke
  FROM m WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS FIRST, id)),
s AS (
  SELECT session_id FROM o GROUP BY session_id
  HAVING NOT bool_or(role IS NULL OR ts IS NULL OR NOT visible OR (role = 'user' AND coalesce(spoke, '') = 'user'))
    AND arg_min(role, position) FILTER (role != 'system') = 'user' AND arg_max(role, position) FILTER (role != 'system') = 'assistant')
SELECT session_id, position, id AS note_id FROM o JOIN s USING (session_id)
"""

ORACLE = {"p5_found": _P5}
