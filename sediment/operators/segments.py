"""Ordered computations over groups of any size.

A window over a hot key puts that key's rows into one task. Here the rows are range-partitioned by
(keys, order) instead, so that a hot key spans many partitions ("segments"), windows run inside a
segment, and what must flow from one segment to the next is carried by a summary of one row per
(keys, segment). A key that lies in one segment needs no carry; as the partitions are ranges, at
most one key crosses each boundary, so a carry table never has more rows than there are partitions
and may be broadcast whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.runtime import materialize, shuffle_partitions

SEG = "_seg"


def range_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """df range-partitioned by keys + order, with its partition number in ``_seg``; checkpointed, as
    the sampled range bounds must not differ between the reads that follow."""
    n = partitions or shuffle_partitions(df.sparkSession)
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn(SEG, F.spark_partition_id()))


def _within(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(SEG, *keys).orderBy(*order)


def _crossing(summary: DataFrame, keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SEG)


def carry_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: struct(v) of the previous row's value in key order, null for a key's first row."""
    boxed = df.withColumn("_box", F.struct(value.alias("v")))
    local = boxed.withColumn(out, F.lag("_box").over(_within(keys, order)))
    ends = boxed.groupBy(*keys, SEG).agg(F.max_by("_box", F.struct(*[F.col(c) for c in order])).alias("_end"))
    carry = ends.withColumn("_carry", F.lag("_end").over(_crossing(ends, keys))).where("_carry is not null").drop("_end")
    return _fill(local, carry, keys, out)


def carry_lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: struct(v) of the next row's value in key order, null for a key's last row."""
    boxed = df.withColumn("_box", F.struct(value.alias("v")))
    local = boxed.withColumn(out, F.lead("_box").over(_within(keys, order)))
    ends = boxed.groupBy(*keys, SEG).agg(F.min_by("_box", F.struct(*[F.col(c) for c in order])).alias("_end"))
    carry = ends.withColumn("_carry", F.lead("_end").over(_crossing(ends, keys))).where("_carry is not null").drop("_end")
    return _fill(local, carry, keys, out)


def _fill(local: DataFrame, carry: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    joined = local.join(F.broadcast(carry), [*keys, SEG], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_carry", "_box")


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds for each name the last non-null value of the rows strictly before the row, in key order."""
    named = df
    for name, value in values.items():
        named = named.withColumn(f"_in_{name}", value)
    w = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = named
    for name in values:
        local = local.withColumn(name, F.last(f"_in_{name}", ignorenulls=True).over(w))
    at = F.struct(*[F.col(c) for c in order])
    ends = named.groupBy(*keys, SEG).agg(
        *[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), at)).alias(f"_end_{n}") for n in values]
    )
    wc = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, SEG, F.row_number().over(_crossing(ends, keys)).alias("_nth"),
        *[F.last(f"_end_{n}", ignorenulls=True).over(wc).alias(f"_carry_{n}") for n in values],
    ).where("_nth > 1").drop("_nth")
    joined = local.join(F.broadcast(carry), [*keys, SEG], "left")
    for n in values:
        joined = joined.withColumn(n, F.coalesce(F.col(n), F.col(f"_carry_{n}")))
    return joined.drop(*[f"_carry_{n}" for n in values], *[f"_in_{n}" for n in values])


def carry_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of value over the rows strictly before the row, in key order."""
    named = df.withColumn("_val", value)
    w = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(named.schema["_val"].dataType)
    local = named.withColumn(out, F.coalesce(F.sum("_val").over(w), zero))
    wc = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    ends = named.groupBy(*keys, SEG).agg(F.sum("_val").alias("_end"))
    carry = ends.withColumn("_carry", F.sum("_end").over(wc)).where("_carry is not null").drop("_end")
    joined = local.join(F.broadcast(carry), [*keys, SEG], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col("_carry"), zero)).drop("_carry", "_val")
