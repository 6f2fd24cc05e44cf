"""Streams over notes, facts and events: routing, deduplication, windows and latest-wins state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sediment.functions import text as T
from sediment.functions import words as W


def read_table(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A parquet file or a folder of them as a stream; zone-less times become UTC instants, as watermarks need."""
    schema = spark.read.parquet(path).schema
    if path.endswith("t"):
        path = path[:-1] + "[t]"  # a pattern, as a stream's plain path must be a folder
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    ntz = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return s.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else s


def routed(notes: DataFrame) -> DataFrame:
    """Each note with its route: noise, fact or note."""
    c = F.col("content")
    noise = T.is_noise(c, F.lit(None).cast("string"))
    return notes.where("content is not null").withColumn("route", F.when(noise, "noise").when(T.matches(c, W.IMPERATIVE), "fact").otherwise("note"))


def deduplicated(notes: DataFrame, late: str = "1 day") -> DataFrame:
    """Notes without repeats of the same fingerprint and session within the watermark."""
    fp = notes.where("timestamp is not null").withColumn("fp", T.fingerprint(F.col("content")))
    return fp.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["session_id", "fp"])


def activity(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n) in tumbling windows of event time."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), kind, "n")


def fact_changes(facts: DataFrame, idle: str | None = None) -> DataFrame:
    """(subject, predicate, object, valid_from, closed): a row for each change of a single-valued fact, with
    the object it closes. The state of a key is its last object and time; older assertions that arrive late
    change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, -1)
        out = []
        for pdf in batches:
            for o, t in sorted(zip(pdf["object"], pdf["at"]), key=lambda x: x[1]):
                if t > at and o != last:
                    out.append((key[0], key[1], o, int(t), last))
                if t > at:
                    last, at = o, int(t)
        state.update((last, at))
        yield pd.DataFrame(out, columns=["subject", "predicate", "object", "valid_from", "closed"])

    rows = facts.where("subject is not null and predicate is not null and object is not null and created_at is not null").where(~F.col("predicate").isin(W.MULTI_VALUED))
    rows = rows.select(F.lower(F.trim("subject")).alias("subject"), "predicate", F.lower(F.trim("object")).alias("object"), F.unix_micros("created_at").alias("at"))
    return rows.groupBy("subject", "predicate").applyInPandasWithState(
        step, "subject string, predicate string, object string, valid_from long, closed string", "object string, at long", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process all that is there and stop; a rerun with the same checkpoint takes only what is new."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", sink).start()
    q.awaitTermination()
