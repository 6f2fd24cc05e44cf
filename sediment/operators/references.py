"""References to records that do not exist: missing, deleted or late parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.skew import lookup_join


def parent_intervals(memories: DataFrame) -> DataFrame:
    """(ref_id, born, deleted) per memory id: born is the smallest created_at; deleted tells whether
    the latest version (greatest updated_at; on ties an active one) has is_active = false. Rows with a
    null id are left out; a null updated_at counts as oldest, a null is_active as active."""
    alive = F.coalesce("is_active", F.lit(True))
    return (
        memories.where("id is not null")
        .groupBy(F.col("id").alias("ref_id"))
        .agg(F.min("created_at").alias("born"), (~F.max(F.struct("updated_at", alive.alias("alive")))["alive"]).alias("deleted"))
    )


def reference_rows(triples: DataFrame, links: DataFrame) -> DataFrame:
    """All non-null references, one row per (table, field, row, referred id, month, active) with the
    earliest time of the repeated rows. Aggregated before any join, so copies cost one shuffle row."""
    parts = [
        triples.select(F.lit("entity_triples").alias("table_name"), F.lit("memory_id").alias("field_name"), F.col("id").cast("string").alias("row_key"),
                       F.col("memory_id").alias("ref_id"), F.col("created_at").alias("at"), F.coalesce("is_active", F.lit(False)).alias("active"))
    ] + [
        links.select(F.lit("associative_links").alias("table_name"), F.lit(field).alias("field_name"), F.concat_ws("|", "source_id", "target_id").alias("row_key"),
                     F.col(field).alias("ref_id"), F.col("last_linked_at").alias("at"), F.lit(True).alias("active"))
        for field in ("source_id", "target_id")
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("ref_id is not null")
    rows = rows.withColumn("period", F.date_format("at", "yyyy-MM"))
    return rows.groupBy("table_name", "field_name", "row_key", "ref_id", "period", "active").agg(F.min("at").alias("at"))


def broken_references(triples: DataFrame, links: DataFrame, memories: DataFrame) -> DataFrame:
    """(table_name, field_name, row_key, ref_id, period, reason) for each reference without a usable parent.

    References and parents are co-partitioned and sorted by id and merged in one pass (a sort-merge
    join, with hot ids spread over salts); the parent's interval then tells the reasons apart:
    ``missing`` (no row), ``deleted`` (latest version inactive; for triples only if the triple itself
    is active), ``late`` (the parent was created after the referring row). The first that holds is given.
    A reference whose own time is null has a null period and is never late. Empty tables give no rows,
    or, when memories is empty, every reference as missing."""
    refs = reference_rows(triples, links)
    ids = triples.select(F.col("memory_id").alias("ref_id")).union(links.select("source_id")).union(links.select("target_id"))
    merged = lookup_join(refs, parent_intervals(memories), "ref_id", "left", counted=ids)
    reason = (
        F.when(F.col("deleted").isNull(), "missing")
        .when(F.col("deleted") & F.col("active"), "deleted")
        .when(F.col("born") > F.col("at"), "late")
    )
    keep = ["table_name", "field_name", "row_key", "ref_id", "period"]
    found = merged.withColumn("reason", reason).where("reason is not null")
    return found.groupBy(*keep).agg(F.max("reason").alias("reason"))


def broken_reference_report(triples: DataFrame, links: DataFrame, memories: DataFrame) -> DataFrame:
    """Broken references counted per table, field, month and reason."""
    return broken_references(triples, links, memories).groupBy("table_name", "field_name", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
