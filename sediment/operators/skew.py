"""Equi-joins of a large side, in which one key may hold a third of all rows, with a side that has
one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is spread over one salt for each ROWS_PER_SALT of them.
HOT_ROWS = 200_000
ROWS_PER_SALT = 100_000
#: Keys are told apart by this many hash values. Only they are broadcast, 16 bytes each, whatever the number of hot keys.
KEY_HASHES = 1 << 18
#: Null keys match nothing and are spread over this many salts.
NULL_SALTS = 1_024


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Sort-merge join of left with right on key, in which every hot key is spread over as many salts as its own
    rows ask for and its right row repeated once per salt. Null keys match nothing and stay with a left join.

    Rows are counted per key, and of the keys with the same hash the largest count decides, so the table of
    salts has a bounded number of rows however many keys are hot; a key that shares its hash with a hot one is
    only repeated for nothing. how may be left, inner, left_semi or left_anti. right must hold one row per key;
    columns other than key must not clash. counted names a cheaper table with the column key that has at least
    as many rows of each key as left."""
    limit = HOT_ROWS if hot_rows is None else hot_rows
    keys = (counted if counted is not None else left).select(key).where(F.col(key).isNotNull())
    slot = F.pmod(F.xxhash64(key), F.lit(KEY_HASHES))
    hot = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    salts = F.broadcast(hot.groupBy(slot.alias("_slot")).agg(F.ceil(F.max("_n") / min(ROWS_PER_SALT, limit)).alias("_salts")))  # KEY_HASHES rows at most
    one = F.lit(0).cast("long")
    spread = left.withColumn("_slot", slot).join(salts, "_slot", "left")
    row = F.xxhash64(*left.columns)
    salt = F.when(F.col(key).isNull(), F.pmod(row, F.lit(NULL_SALTS))).when(F.col("_salts").isNull(), one).otherwise(F.pmod(row, F.col("_salts")))
    spread = spread.withColumn("_salt", salt).drop("_salts", "_slot")
    copies = right.withColumn("_slot", slot).join(salts, "_slot", "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(one, F.coalesce(F.col("_salts") - 1, one)))).drop("_salts", "_slot")
    return spread.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")
