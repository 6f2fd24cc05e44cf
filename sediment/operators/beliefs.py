"""Belief maintenance as set-based resolution of ordered assertions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators.segments import carry_lag, carry_lead, carry_sum, range_segments
from sediment.operators.skew import lookup_join

ORDER = ["created_at", "id"]


def keyed(facts: DataFrame) -> DataFrame:
    """Triples with lower-case keys; rows without subject, predicate, object or time are left out."""
    rows = facts.where("subject is not null and predicate is not null and object is not null and created_at is not null")
    return rows.withColumn("ks", F.lower("subject")).withColumn("ko", F.lower("object"))


def successors(rows: DataFrame, keys: list[str], when: Column | None = None) -> DataFrame:
    """rows with ``next``: the following row of the same keys in order of (created_at, id). Hot keys are cut
    into segments."""
    seg = range_segments(rows, keys, ORDER)
    return carry_lead(seg, keys, ORDER, when if when is not None else F.struct("memory_id", "created_at"), "next")


def resolve(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(id, superseded_by, valid_until, active): of equal keys the last assertion is active, every other one
    is closed by its successor's memory and time. Keys are ks and predicate for single-valued predicates,
    and ko as well for multi-valued ones."""
    out = successors(keyed(facts), keys)
    return out.select("id", F.col("next.v.memory_id").alias("superseded_by"), F.col("next.v.created_at").alias("valid_until"), F.col("next").isNull().alias("active"))


def antonym_class(predicate: Column) -> Column:
    """The first of a pair of opposite predicates in alphabetical order; null for others."""
    out = F.lit(None).cast("string")
    for a, b in W.OPPOSITES.items():
        out = F.when(predicate == a, F.lit(min(a, b))).otherwise(out)
    return out


def resolve_antonyms(facts: DataFrame) -> DataFrame:
    """(id, superseded_by, contradictions): a triple is superseded by the next one on the same subject and
    object if that has the opposite predicate; contradictions is how many such changes its subject and object saw."""
    rows = keyed(facts).withColumn("pair", antonym_class(F.col("predicate"))).where("pair is not null")
    keys = ["ks", "pair", "ko"]
    seg = range_segments(rows, keys, ORDER)
    out = carry_lead(seg, keys, ORDER, F.struct("memory_id", "predicate"), "next")
    turned = out.where(F.coalesce(F.col("next.v.predicate") != F.col("predicate"), F.lit(False))).withColumn("key", F.concat_ws("\x01", *keys))
    total = turned.groupBy("key").agg(F.count(F.lit(1)).alias("contradictions"))
    return lookup_join(turned.select("id", "key", F.col("next.v.memory_id").alias("superseded_by")), total, "key", "inner").select("id", "superseded_by", "contradictions")


def upsert_actions(facts: DataFrame) -> DataFrame:
    """(id, action): superseded (the last one on the same subject and object has the opposite predicate), inserted (first
    of its subject and predicate), reinforced (same object as before), updated."""
    rows = keyed(facts)
    keys = ["ks", "predicate"]
    seg = range_segments(rows, keys, ORDER)
    out = carry_lag(seg, keys, ORDER, F.col("ko"), "prev")
    action = F.when(F.col("prev").isNull(), "inserted").when(F.col("prev.v") == F.col("ko"), "reinforced").otherwise("updated")
    pairs = rows.withColumn("pair", antonym_class(F.col("predicate"))).where("pair is not null").select("id", *ORDER[:1], "ks", "pair", "ko", "predicate")
    seen = carry_lag(range_segments(pairs, ["ks", "pair", "ko"], ORDER), ["ks", "pair", "ko"], ORDER, F.col("predicate"), "prev")
    turned = seen.where(F.coalesce(F.col("prev.v") != F.col("predicate"), F.lit(False))).select("id", F.lit(True).alias("turned"))
    return out.select("id", action.alias("action")).join(turned, "id", "left").select("id", F.when(F.col("turned"), "superseded").otherwise(F.col("action")).alias("action"))


def reinforced(memories: DataFrame) -> DataFrame:
    """Active memories by fingerprint, polarity and peer: the first one stays, its confidence raised by 0.05
    for each repeat (1 at most), with the union of all tags."""
    act = memories.where("is_active and content is not null").withColumn("fp", T.fingerprint(F.col("content")))
    at = F.struct("created_at", "id")
    tags = F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>"))))  # distinct tag lists, not rows
    g = act.groupBy("fp", "is_negative_constraint", "peer").agg(
        F.min_by("id", at).alias("id"), F.count(F.lit(1)).alias("n"), F.min_by("confidence", at).alias("confidence"), F.array_join(F.sort_array(F.array_distinct(tags)), ",").alias("tags")
    )
    return g.select("id", "n", F.round(F.least(F.lit(1.0), F.col("confidence") + 0.05 * (F.col("n") - 1)), 6).alias("confidence"), "tags")


def same_text(memories: DataFrame) -> DataFrame:
    """(kept, copies): active memories of one category and polarity with the same text but for case; the
    earliest is kept."""
    act = memories.where("is_active and content is not null")
    g = act.groupBy("category", "is_negative_constraint", F.lower(F.trim("content")).alias("t")).agg(F.min_by("id", F.struct("created_at", "id")).alias("kept"), (F.count(F.lit(1)) - 1).alias("copies"))
    return g.where("copies > 0").select("kept", "copies")


def orphaned(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """Active triples whose memory is inactive or missing: (id, reason)."""
    parents = memories.select(F.col("id").alias("memory_id"), F.col("is_active").alias("alive"))
    out = lookup_join(facts.where("is_active and memory_id is not null").select("id", "memory_id"), parents, "memory_id", "left")
    return out.where("alive is null or not alive").select("id", F.when(F.col("alive").isNull(), "missing").otherwise("inactive").alias("reason"))


def expired(memories: DataFrame, as_of: Column) -> DataFrame:
    return memories.where(F.col("is_active") & (F.col("valid_until") < as_of)).select("id", "valid_until")


def evicted(memories: DataFrame, as_of: Column, cap: int) -> DataFrame:
    """(id, retention): the memories beyond ``cap`` with the lowest confidence x importance x (1 + accesses) / (1 + days).

    Prohibitions are never evicted. The rank is needed only for the excess, which a global top-n gives
    without sorting everything."""
    act = memories.where("is_active")
    weight = F.when(F.col("importance") == "critical", 10.0).when(F.col("importance") == "high", 3.0).when(F.col("importance") == "low", 0.5).otherwise(1.0)
    days = F.floor((F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(86_400_000_000))
    kept = F.coalesce("confidence", F.lit(1.0)) * weight * (F.col("access_count") + 1) / (1 + F.greatest(days, F.lit(0)))
    excess = max(0, act.count() - cap)
    return act.where("not is_negative_constraint").select("id", F.round(kept, 8).alias("retention"), "created_at").orderBy("retention", "created_at", "id").limit(excess).select("id", "retention")


def decayed(memories: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Active, unimportant memories of hardly any use that are older than ``days``."""
    old = F.col("created_at") < as_of - F.expr(f"interval {days} days")
    return memories.where("is_active and not is_negative_constraint and importance = 'low' and access_count <= 1").where(old).select("id")


def conflicts(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, kind, score): active triples of active memories in conflict with another one: contradiction (the
    opposite predicate on the same subject and object) and single_value_replacement or multi_value_coexist
    (another object of the same subject and predicate). Groups are told by aggregates, not by pairs."""
    alive = memories.where("is_active").select(F.col("id").alias("memory_id"))
    rows = lookup_join(keyed(facts).where("is_active and memory_id is not null"), alive, "memory_id", "left_semi")
    pair = rows.withColumn("pair", antonym_class(F.col("predicate"))).where("pair is not null")
    torn = pair.groupBy("ks", "pair", "ko").agg(F.min("predicate").alias("lo"), F.max("predicate").alias("hi")).where("lo != hi").select(F.concat_ws("\x01", "ks", "pair", "ko").alias("key"))
    a = lookup_join(pair.withColumn("key", F.concat_ws("\x01", "ks", "pair", "ko")), torn, "key", "left_semi").select("id", F.lit("contradiction").alias("kind"), F.lit(1.0).alias("score"))
    many = rows.groupBy("ks", "predicate").agg(F.min("ko").alias("lo"), F.max("ko").alias("hi")).where("lo != hi").select(F.concat_ws("\x01", "ks", "predicate").alias("key"))
    kind = F.when(F.col("predicate").isin(W.MULTI_VALUED), "multi_value_coexist").otherwise("single_value_replacement")
    b = lookup_join(rows.withColumn("key", F.concat_ws("\x01", "ks", "predicate")), many, "key", "left_semi").select("id", kind.alias("kind"), F.lit(0.9).alias("score"))
    return a.unionByName(b)


def mentions(memories: DataFrame, text: str) -> DataFrame:
    """Active memories that contain the text, but for case."""
    return memories.where(F.col("is_active") & F.lower("content").contains(text.lower())).select("id")


def remembered(said: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, action, target, is_negative_constraint, memory_type, outcome): what statements (id, content), in order of id,
    do to a store: ``dropped`` as passing remarks, ``reinforced`` (an active memory, the target, or an earlier
    statement says the same with the same polarity) or ``inserted``. Same means equal but for case and punctuation."""
    c = F.col("content")
    neg = F.coalesce(T.is_negative(c, F.lit(None).cast("string")), F.lit(False))
    rows = said.where("id is not null and content is not null").select(
        "id", F.concat(F.sha2(T.normalized(c), 256), neg.cast("string")).alias("fp"), neg.alias("is_negative_constraint"), (T.is_noise(c, F.lit(None).cast("string")) & ~neg).alias("noise"), T.outcome(c).alias("outcome")
    )
    known = memories.where("is_active and content is not null").groupBy(F.concat(F.sha2(T.normalized(c), 256), F.col("is_negative_constraint").cast("string")).alias("fp")).agg(F.min_by("id", F.struct("created_at", "id")).alias("known"))
    first = rows.groupBy("fp").agg(F.min("id").alias("first"))
    j = lookup_join(rows, first.join(known, "fp", "left"), "fp", "inner")
    action = F.when(F.col("noise"), "dropped").when(F.col("known").isNotNull(), "reinforced").when(F.col("id") == F.col("first"), "inserted").otherwise("reinforced")
    target = F.when(F.col("noise"), None).when(F.col("known").isNotNull(), F.col("known")).when(F.col("id") != F.col("first"), F.col("first"))
    kind = F.when(F.col("is_negative_constraint"), "imperative").otherwise("declarative")
    return j.select("id", action.alias("action"), target.alias("target"), "is_negative_constraint", kind.alias("memory_type"), "outcome")


def extracted_upserts(said: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, action): the triples that statements (id, content, at) state, and what each does
    to the facts before it: see upsert_actions. Triples of one statement count in order of predicate and object."""
    t = said.select(F.col("id").alias("note"), "at", F.explode(F.array_distinct(T.triples(F.col("content")))).alias("t"))
    new = t.select("note", F.col("at").alias("created_at"), "t.subject", "t.predicate", "t.object")
    key = F.struct(F.lit(1).alias("new"), F.col("note").alias("a"), F.concat_ws("\x01", "predicate", "object", "subject").alias("b"))
    old = facts.where("created_at is not null").select(F.struct(F.lit(0).alias("new"), F.col("id").alias("a"), F.lit("").alias("b")).alias("id"), "created_at", "subject", "predicate", "object")
    both = old.unionByName(new.select(key.alias("id"), "created_at", "subject", "predicate", "object"))
    done = upsert_actions(both).where("id.new = 1")
    named = new.select(key.alias("id"), "note", "subject", "predicate", "object")
    return named.join(done, "id").select(F.col("note").alias("id"), "subject", "predicate", "object", "action")


def deleted(ids: DataFrame, memories: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, id) of the active memories with these ids and of their active triples."""
    mine = lookup_join(memories.where("is_active").select("id"), ids.select("id").distinct(), "id", "left_semi")
    hit = lookup_join(facts.where("is_active and memory_id is not null").select(F.col("id").alias("tid"), "memory_id"), mine.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi")
    return mine.select(F.lit("memory").alias("kind"), "id").union(hit.select(F.lit("triple"), "tid"))


def contradictions(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, subject, positive, negative, object): opposite predicates on the same subject and object among the active
    triples of each query's results."""
    t = facts.where("is_active and memory_id is not null").select(F.col("memory_id").alias("id"), F.lower("subject").alias("subject"), "predicate", F.lower("object").alias("object"))
    rows = found.select("query_id", "id").join(t, "id").withColumn("pair", antonym_class(F.col("predicate"))).where("pair is not null")
    g = rows.groupBy("query_id", "subject", "object", "pair").agg(F.min("predicate").alias("positive"), F.max("predicate").alias("negative"))
    return g.where("positive != negative").select("query_id", "subject", "positive", "negative", "object")


def forgotten(memories: DataFrame, facts: DataFrame, target: str) -> DataFrame:
    """(kind, id) of active memories meant by ``target`` (its whole text, or a word of at least four letters
    in it) and of their active triples. Wildcards and texts below two letters mean nothing."""
    t = target.strip().lower()
    act = memories.where("is_active and content is not null")
    if len(t) < 2 or any(c in t for c in "%_"):
        hit = act.where("false")
    else:
        whole = F.lower(F.trim("content")) == t
        hit = act.where(whole | T.matches(F.lower("content"), r"\b(" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in t) + r")\b") if len(t) >= 4 else whole)
    ids = hit.select("id")
    cascade = lookup_join(facts.where("is_active and memory_id is not null").select(F.col("id").alias("tid"), "memory_id"), ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi")
    return ids.select(F.lit("memory").alias("kind"), "id").union(cascade.select(F.lit("triple"), "tid"))


def by_source(memories: DataFrame, session: int | None = None, peer: str | None = None, kind: str | None = None, category: str | None = None) -> DataFrame:
    """Active memories of all the given sources; with none given, nothing."""
    given = {"source_session": session, "peer": peer, "memory_type": kind, "category": category}
    if all(v is None for v in given.values()):
        return memories.where("false").select("id")
    out = memories.where("is_active")
    for c, v in given.items():
        if v is not None:
            out = out.where(F.col(c) == v)
    return out.select("id")


def receipts(memories: DataFrame, as_of: Column) -> DataFrame:
    """(id, receipt): a digest of what was purged and when."""
    what = F.concat_ws("|", F.col("id").cast("string"), F.substring("content", 1, 30), F.unix_millis("created_at").cast("string"), F.unix_millis(as_of).cast("string"))
    return memories.select("id", F.sha2(what, 256).alias("receipt"))


#: Steps of a key that are folded at a time.
FOLDED = 4_096


def rated(events: DataFrame, keys: list[str], start: float = 1.0) -> DataFrame:
    """Confidence after all verdicts in order: +0.05 for helped, -0.15 for misled, within [0.05, 1] after
    each. A clamped step x -> min(hi, max(lo, x + a)) composes with the next into one of the same form, so the log
    of a key of any size is folded FOLDED steps at a time, then the folds, and so on."""
    step = F.when(F.col("verdict") == "helped", 0.05).otherwise(-0.15)
    seg = range_segments(events.select(*keys, "at", "seq", step.alias("add")), keys, ["at", "seq"])
    rows = carry_sum(seg, keys, ["at", "seq"], F.lit(1).cast("long"), "nth")
    one = F.struct(F.lit(0.05).alias("lo"), F.lit(1.0).alias("hi"), F.col("add"))
    rows = rows.select(*keys, "nth", one.alias("f"))
    zero = F.struct(F.lit(-10.0).alias("lo"), F.lit(10.0).alias("hi"), F.lit(0.0).alias("add"))

    def then(f: Column, g: Column) -> Column:
        clip = lambda x: F.least(g["hi"], F.greatest(g["lo"], x + g["add"]))
        return F.struct(clip(f["lo"]).alias("lo"), clip(f["hi"]).alias("hi"), (f["add"] + g["add"]).alias("add"))

    for _ in range(3):  # FOLDED ** 3 steps of a key, and as many again below
        part = rows.groupBy(*keys, F.floor(F.col("nth") / FOLDED).alias("nth")).agg(F.sort_array(F.collect_list(F.struct(F.col("nth").alias("n"), "f"))).alias("s"))
        rows = part.select(*keys, "nth", F.aggregate("s", zero, lambda f, x: then(f, x["f"])).alias("f"))
    last = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", "f"))).alias("d"))
    end = F.aggregate("d", F.lit(float(start)), lambda x, d: F.least(d["f"]["hi"], F.greatest(d["f"]["lo"], x + d["f"]["add"])))
    return last.select(*keys, F.round(end, 6).alias("confidence"))


def timeline(memories: DataFrame, facts: DataFrame) -> DataFrame:
    """(memory_id, event, at): what happened to each memory: created, accessed, superseded, expired, and the
    triples asserted from it."""
    m = memories.select(F.col("id").alias("memory_id"), "*")
    parts = [
        m.select("memory_id", F.lit("CREATED").alias("event"), F.col("created_at").alias("at")),
        m.where("updated_at > created_at").select("memory_id", F.lit("MUTATED"), "updated_at"),
        m.where("superseded_by_id is not null").select("memory_id", F.lit("SUPERSEDED"), "updated_at"),
        facts.where("memory_id is not null").select("memory_id", F.lit("ASSERTED"), "created_at"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("at is not null")


def _word_diff():
    """The diff as a function of its own, so that workers need not import this package."""

    @F.pandas_udf("added long, removed long, unchanged long")
    def run(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(old, new):
            x, y = (a or "").split(), (b or "").split()
            width = [0] * (len(y) + 1)  # longest common subsequence, row by row
            for w in x:
                before, width = width, [0]
                for j, v in enumerate(y):
                    width.append(before[j] + 1 if v == w else max(before[j + 1], width[j]))
            same = width[-1]
            rows.append((len(y) - same, len(x) - same, same))
        return pd.DataFrame(rows, columns=["added", "removed", "unchanged"])

    return run


def differences(memories: DataFrame) -> DataFrame:
    """(id, new_id, category_changed, added, removed, unchanged): every superseded memory with its successor,
    words compared by their longest common subsequence."""
    new = memories.select(F.col("id").alias("superseded_by_id"), F.col("content").alias("new_text"), F.col("category").alias("new_category"))
    pairs = lookup_join(memories.where("superseded_by_id is not null").select("id", "superseded_by_id", "content", "category"), new, "superseded_by_id", "inner")
    d = pairs.withColumn("d", _word_diff()(F.col("content"), F.col("new_text")))
    return d.select("id", F.col("superseded_by_id").alias("new_id"), (~F.col("category").eqNullSafe(F.col("new_category"))).alias("category_changed"), "d.*")


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key with its version number, the count of rows so far."""
    last = F.max(F.struct(*order, *[c for c in log.columns if c not in keys and c not in order])).alias("s")
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("version"), last).select(*keys, "version", "s.*")


def contested(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, disputes): how often a claim differs from the one before it in order."""
    seg = range_segments(log, keys, order)
    out = carry_lag(seg, keys, order, F.col("value"), "prev")
    return out.groupBy(*keys).agg(F.sum(F.when(F.col("prev").isNotNull() & ~F.col("prev.v").eqNullSafe(F.col("value")), 1).otherwise(0)).alias("disputes"), F.count(F.lit(1)).alias("claims"))


def history_at(facts: DataFrame, as_of: Column) -> DataFrame:
    """Single-valued facts as they stood at ``as_of``, superseded ones included: (ks, predicate, object)."""
    w = Window.partitionBy("ks", "predicate").orderBy(F.desc("created_at"), F.desc("id"))
    return keyed(facts).where(F.col("created_at") <= as_of).withColumn("n", F.row_number().over(w)).where("n = 1").select("ks", "predicate", "object")
