"""Inputs that many queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.sources import table

#: "Now" of every query: never the wall clock, so that results can be compared.
AS_OF = "2025-07-01 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def now():
    return F.lit(AS_OF).cast("timestamp")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Latest version of every memory, category trimmed and in lower case."""
    latest = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("access_count"), F.desc("is_active"))
    m = table(spark, d, "memories").where("id is not null").withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return m.withColumn("category", F.lower(F.trim("category")))


MEMORIES_SQL = """m AS (
  SELECT * EXCLUDE (rn) REPLACE (lower(trim(category)) AS category) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, access_count DESC, is_active DESC) AS rn FROM memories WHERE id IS NOT NULL) WHERE rn = 1)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per triple id (the last created), subject and object trimmed."""
    latest = Window.partitionBy("id").orderBy(F.desc("created_at"), "subject", "object")
    t = table(spark, d, "entity_triples").where("id is not null").withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return t.withColumn("subject", F.trim("subject")).withColumn("object", F.trim("object"))


FACTS_SQL = """t AS (
  SELECT * EXCLUDE (rn) REPLACE (trim(subject) AS subject, trim(object) AS object) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, subject, object) AS rn FROM entity_triples WHERE id IS NOT NULL) WHERE rn = 1)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """One row per unordered pair of memories: greatest weight and count over both directions and repeats."""
    a = table(spark, d, "associative_links").where("source_id is not null and target_id is not null and source_id != target_id")
    return a.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(
        F.max(F.coalesce("resonance_weight", F.lit(0.5))).alias("w"), F.max("co_occurrences").alias("n"), F.max("last_linked_at").alias("at")
    )


LINKS_SQL = """l AS (
  SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(coalesce(resonance_weight, 0.5)) AS w, max(co_occurrences) AS n, max(last_linked_at) AS ts
  FROM associative_links WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id != target_id GROUP BY 1, 2)"""
