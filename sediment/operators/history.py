"""History of changing entity attributes, built from an event-sourced log of assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.operators.segments import carry_lag, carry_last, carry_lead, range_segments

KEY = ["subject", "predicate"]
#: Single-valued predicates are a small fixed table; a state has a slot for each. More are refused, not cut.
MOST_PREDICATES = 1_000


def clean_text(c: Column | str) -> Column:
    """Lower case without outer spaces."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def assertion_time(valid_from: str = "valid_from", created_at: str = "created_at") -> Column:
    """valid_from, or created_at where valid_from is null or lies on 1970-01-01."""
    v = F.col(valid_from)
    return F.when(v.isNull() | (F.to_date(v) == F.lit("1970-01-01").cast("date")), F.col(created_at)).otherwise(v)


def assertions(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """(subject, predicate, object, at) of single-valued predicates, one row per subject, predicate and
    time: the latest created_at counts, then the greatest id. kinds is the fixed table of predicates.
    Rows without subject, object or any time are left out."""
    single = kinds.where("not is_multi_valued").select("predicate").distinct()
    rows = triples.select(
        clean_text("subject").alias("subject"), "predicate", clean_text("object").alias("object"), assertion_time().alias("at"), "created_at", "id"
    ).where("subject is not null and predicate is not null and object is not null and at is not null")
    rows = rows.join(F.broadcast(single), "predicate", "left_semi")  # a fixed table of a few predicates
    return rows.groupBy(*KEY, "at").agg(F.max(F.struct("created_at", "id", "object"))["object"].alias("object"))


def attribute_versions(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """Change log of every single-valued attribute: (subject, predicate, object, valid_from, valid_until, n_before).

    A run of equal objects in order of time is one version, valid from its first time until the start
    of the next one (null for the last). n_before is null for an attribute's first version. Hot
    subjects are cut into segments, so no task holds more than a share of the log."""
    log = range_segments(assertions(triples, kinds), KEY, ["at"])
    seen = carry_lag(log, KEY, ["at"], F.col("object"), "prev")
    starts = seen.where("prev is null or not (prev.v <=> object)")
    out = carry_lead(starts, KEY, ["at"], F.col("at"), "next")
    return out.select(*KEY, "object", F.col("at").alias("valid_from"), F.col("next.v").alias("valid_until"), F.col("prev.v").alias("previous"))


def changed_attributes(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """The versions of attributes that have at least two of them, times in epoch milliseconds, -1 for open."""
    v = attribute_versions(triples, kinds).where("valid_until is not null or previous is not null")
    return v.select(*KEY, "object", F.unix_millis("valid_from").alias("valid_from_ms"), F.coalesce(F.unix_millis("valid_until"), F.lit(-1).cast("long")).alias("valid_until_ms"))


def entity_states(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """(subject, valid_from, valid_until, attributes): the whole state of a subject in each period.

    The change logs of the subject's attributes are split at the union of their boundary dates, and
    equal neighbours are coalesced; attributes is the sorted list of ``predicate=object``."""
    names = [r[0] for r in kinds.where("not is_multi_valued").select("predicate").distinct().orderBy("predicate").limit(MOST_PREDICATES + 1).collect()]
    if len(names) > MOST_PREDICATES:
        raise ValueError(f"more than {MOST_PREDICATES} single-valued predicates")
    versions = attribute_versions(triples, kinds)
    if not names:
        return versions.limit(0).select("subject", "valid_from", "valid_until", F.array(F.col("object")).alias("attributes"))
    slot = {n: f"p{i}" for i, n in enumerate(names)}
    at = versions.groupBy("subject", F.col("valid_from").alias("at")).agg(
        *[F.max(F.when(F.col("predicate") == n, F.col("object"))).alias(s) for n, s in slot.items()]
    )
    seg = range_segments(at, ["subject"], ["at"])
    known = carry_last(seg, ["subject"], ["at"], {f"l{s}": F.col(s) for s in slot.values()})
    parts = [F.when(F.coalesce(s, f"l{s}").isNotNull(), F.concat(F.lit(n + "="), F.coalesce(s, f"l{s}"))) for n, s in slot.items()]
    state = known.select("subject", "at", "_seg", F.array_compact(F.array(*parts)).alias("attributes"))
    seen = carry_lag(state, ["subject"], ["at"], F.col("attributes"), "prev")
    kept = seen.where("prev is null or not (prev.v <=> attributes)")
    out = carry_lead(kept, ["subject"], ["at"], F.col("at"), "next")
    return out.select("subject", F.col("at").alias("valid_from"), F.col("next.v").alias("valid_until"), "attributes")
