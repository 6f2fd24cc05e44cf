"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.operators.segments import carry_sum, range_segments
from sediment.runtime import materialize

#: Targets are a small table that decides for every source; more rows than this are refused, not cut.
MOST_TARGETS = 10_000


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens): of the documents with equal text (key) the one with the smallest doc_id
    stands for all, so that no text is used more often for being stored twice. Documents of other sources must be
    left out before, or a text could go with the copy that is not wanted."""
    return documents.groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d")).select("d.*")


def wanted(targets: DataFrame) -> list[dict]:
    """Rows (source, target_share, max_repeats) of the table of targets, sources trimmed and in lower case; rows
    without source, share or repeats are left out, shares of a repeated source are added up."""
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(F.lower(F.trim("source")).alias("source"))
    got = rows.agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(got) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return [r.asDict() for r in got]


def plan(rows: list[dict], have: dict[str, int], total_tokens: int | None = None, seed: int = 0) -> list[dict]:
    """The targets with ``available`` tokens, the share ``goal`` among the sources that have any, ``copies`` and ``offset``.

    copies is how often each text of the source is expected to be used. Without total_tokens the mix is as
    large as all shares can be kept: the first source to reach max_repeats decides. With total_tokens, a
    source that would need more is capped and falls short. Sources without any text get no copies, and the
    other shares are raised in proportion. offset is a source's one random number between 0 and 1, drawn from
    seed and source, so that a retried task or a rerun draws the same."""
    rows = [r | {"available": int(have.get(r["source"], 0))} for r in rows]
    whole = sum(r["target_share"] for r in rows if r["available"])
    feasible = min((r["max_repeats"] * r["available"] * whole / r["target_share"] for r in rows if r["available"]), default=0.0)
    total = feasible if total_tokens is None else float(total_tokens)
    for r in rows:
        r["goal"] = r["target_share"] / whole if r["available"] else 0.0
        r["copies"] = min(float(r["max_repeats"]), total * r["goal"] / r["available"]) if r["available"] else 0.0
        r["offset"] = random.Random(f"{seed}|{r['source']}").random()
    return rows


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mix, report). documents is (doc_id, source, tokens, key), key being equal for equal texts.

    mix is (doc_id, source, copy, tokens): the expected copies of a source's texts are added up in order of
    their size, so that all sizes are drawn alike, the source's one random offset (by seed) is added, and a text is
    emitted once for each whole number crossed, so it is used the expected number of times, rounded up or down.
    report is (source, target_share, goal, max_repeats, available, tokens, share): the share asked for, the one
    aimed at, as sources without text cannot have any, and the one really reached. Documents without token, with a
    null source or one without target are not used, whether or not they hold the same text as another; empty
    tables give an empty mix."""
    spark = documents.sparkSession
    asked = wanted(targets)
    names = F.broadcast(spark.createDataFrame([(r["source"],) for r in asked], "source string"))  # MOST_TARGETS at most
    rows = documents.where("doc_id is not null and tokens > 0").withColumn("source", F.lower(F.trim("source"))).join(names, "source", "left_semi")
    texts = materialize(distinct_texts(rows))  # read for the plan and for the mix
    have = {r[0]: r[1] for r in texts.groupBy("source").agg(F.sum("tokens")).collect()}  # a row a target at most
    rates = plan(asked, have, total_tokens, seed)
    columns = ("source", "target_share", "goal", "max_repeats", "available", "copies", "offset")
    table = spark.createDataFrame([tuple(r[c] for c in columns) for r in rates], "source string, target_share double, goal double, max_repeats long, available long, copies double, offset double")
    used = texts.join(F.broadcast(table.where("copies > 0").select("source", "copies", "max_repeats", "offset")), "source").withColumn("turn", F.xxhash64("doc_id", F.lit(seed)))
    seg = range_segments(used, ["source"], ["tokens", "turn", "doc_id"])
    at = carry_sum(seg, ["source"], ["tokens", "turn", "doc_id"], F.lit(1).cast("long"), "before")
    # before * copies is the prefix sum of expected copies; a product keeps it exact for any number of texts
    crossed = F.floor((F.col("before") + 1) * F.col("copies") + F.col("offset")) - F.floor(F.col("before") * F.col("copies") + F.col("offset"))
    times = F.least(crossed, F.col("max_repeats"))
    mix = at.withColumn("times", times).where("times > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"), "tokens")
    got = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    report = table.drop("copies", "offset").join(got, "source", "left").fillna(0, ["tokens"])
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    report = report.join(F.broadcast(total)).select(
        "source", "target_share", F.round("goal", 6).alias("goal"), "max_repeats", "available", "tokens", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share")
    )
    return mix, report
