"""Reports over memories, facts, notes and usage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators.segments import carry_lead, range_segments
from sediment.operators.skew import lookup_join

def seniority() -> Column:
    return F.when(F.col("importance") == "critical", 2).when(F.col("importance") == "high", 1).otherwise(0)


def digest(events: DataFrame, since: Column) -> DataFrame:
    """(event, n) of a log (memory_id, event, at) since a time."""
    return events.where(F.col("at") >= since).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def audit(facts: DataFrame, memories: DataFrame, orphans: DataFrame, as_of: Column) -> DataFrame:
    """(orphans, stale, debris, score): a health score of 100 minus limited penalties."""
    old = F.col("created_at") < as_of - F.expr("interval 30 days")
    m = memories.agg(F.count(F.when(F.col("is_active") & old & (F.col("access_count") == 0), 1)).alias("stale"), F.count(F.when(~F.col("is_active"), 1)).alias("debris"))
    o = orphans.agg(F.count(F.lit(1)).alias("orphans"))
    score = F.greatest(F.lit(0), 100 - F.least(F.lit(25), 5 * F.col("orphans")) - F.least(F.lit(20), 2 * F.col("stale")) - F.when(F.col("debris") > 5, 5).otherwise(0))
    return o.crossJoin(m).select("orphans", "stale", "debris", score.cast("long").alias("score"))  # one row each


def standing_card(facts: DataFrame, memories: DataFrame, limit: int = 15) -> DataFrame:
    """(rank, subject, predicate, object): sure facts of active declarative memories, the weightiest first."""
    sure = memories.where("is_active and memory_type = 'declarative' and coalesce(confidence, 1.0) >= 0.85").where(~F.col("category").isin(W.NOISE_CATEGORIES))
    m = sure.select(F.col("id").alias("memory_id"), seniority().alias("s"), "access_count")
    t = lookup_join(facts.where("is_active and memory_id is not null").select("id", "subject", "predicate", "object", "memory_id", "created_at"), m, "memory_id", "inner")
    top = t.orderBy(F.desc("s"), F.desc("access_count"), F.desc("created_at"), F.desc("id")).limit(limit)
    w = Window.orderBy(F.desc("s"), F.desc("access_count"), F.desc("created_at"), F.desc("id"))  # over ``limit`` rows
    return top.select(F.row_number().over(w).alias("rank"), "subject", "predicate", "object")


def active_rules(memories: DataFrame, scope: str | None = None) -> DataFrame:
    """Rules that stand: prohibitions, rules, architecture and hardware, with their sort keys."""
    m = memories.where("is_active").where(F.col("is_negative_constraint") | F.col("category").isin("rule", "architecture", "hardware"))
    if scope:
        m = m.where(F.col("scope").isin(scope, "global"))
    return m.select("id", F.col("is_negative_constraint").alias("negative"), seniority().alias("seniority"), F.unix_millis("created_at").alias("created_ms"))


def primer(memories: DataFrame, limit: int = 10) -> DataFrame:
    """The weightiest prohibitions."""
    m = memories.where("is_active and is_negative_constraint").select("id", seniority().alias("seniority"), "access_count")
    return m.orderBy(F.desc("seniority"), F.desc("access_count"), "id").limit(limit)


def sessions(memories: DataFrame, notes: DataFrame) -> DataFrame:
    """(session, memories, failures, notes, first_ms, last_ms) of every session either table names."""
    a = memories.where("source_session is not null").groupBy(F.col("source_session").alias("session")).agg(F.count(F.lit(1)).alias("memories"), F.count(F.when(F.col("outcome") == "failure", 1)).alias("failures"))
    b = notes.where("session_id is not null").groupBy(F.col("session_id").alias("session")).agg(F.countDistinct("id").alias("notes"), F.unix_millis(F.min("timestamp")).alias("first_ms"), F.unix_millis(F.max("timestamp")).alias("last_ms"))
    j = a.join(b, "session", "full")
    return j.select("session", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("memories", "failures", "notes")], "first_ms", "last_ms")


# Wordings by which a session's statements are sorted.
LEDGER = [
    ("constraint", r"\b(don't|never|must not|prohibit|forbid|anti-pattern|jangan|dilarang|tidak boleh|hindari)\b"),
    ("failure", r"\b(error|fail|bug|gagal|panic|exception|crash|broken|fault)\b"),
    ("outcome", r"\b(complete|verified|passed|sukses|berhasil|done|finish|achieved|stabil)\b"),
    ("decision", r"\b(decid|chose|using|selected|switched|settled|pilih|pakai|memutuskan|ganti)\b"),
]


def ledger_kind(c: Column) -> Column:
    out = F.lit("general")
    for kind, pattern in reversed(LEDGER):
        out = F.when(T.matches(c, pattern), kind).otherwise(out)
    return out


def rollup(memories: DataFrame, most: int = 50) -> DataFrame:
    """(session, kind, n): the oldest ``most`` active memories of each session by kind of statement."""
    w = Window.partitionBy("source_session").orderBy("created_at", "id")
    m = memories.where("is_active and source_session is not null and content is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return m.groupBy(F.col("source_session").alias("session"), ledger_kind(F.col("content")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def usage(events: DataFrame) -> DataFrame:
    """(id, recalled, helped, misled) of a log (id, verdict)."""
    return events.groupBy("id").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("recalled", "helped", "misled")])


def project_hits(events: DataFrame) -> DataFrame:
    return events.groupBy("id", "project").agg(F.count(F.lit(1)).alias("hits"), F.max("at").alias("last"))


def promotions(hits: DataFrame, used: DataFrame, memories: DataFrame, least: int = 3, limit: int = 20) -> DataFrame:
    """(id, projects, helped): active memories that are not global and that at least ``least`` projects use, most
    used first; projects is their sorted list."""
    own = memories.where("is_active and scope != 'global'").select("id")
    p = hits.groupBy("id").agg(F.countDistinct("project").alias("n"), F.array_join(F.sort_array(F.collect_set("project")), ",").alias("projects")).where(F.col("n") >= least)
    j = p.join(own, "id", "left_semi").join(used.select("id", "helped"), "id", "left")
    return j.select("id", "projects", "n", F.coalesce("helped", F.lit(0)).alias("helped")).orderBy(F.desc("n"), F.desc("helped"), "id").limit(limit)


def playbooks(symptoms: DataFrame, remedies: DataFrame) -> DataFrame:
    """(id, pattern): for each symptom (id, text) the remedies (pattern) that occur in it as plain text, or that hold
    the whole of a symptom of four characters or more.

    A pattern that lies in a text lies between two of its characters, so texts and patterns meet by the first
    word in the pattern that has GRAM letters or digits or more, cut to them: distinct texts are cut into such pieces at
    every position of their words. Patterns without such a word are few in kind and met by all texts, so they are
    looked up among distinct texts only. No pattern and no text is left out."""
    texts, pats = symptoms.where("trim(text) != ''").select(F.trim("text").alias("text")).distinct(), remedies.where("pattern != ''").select("pattern").distinct()
    held = _contained(pats.withColumnRenamed("pattern", "inner"), texts.withColumnRenamed("text", "outer")).select(F.col("outer").alias("text"), F.col("inner").alias("pattern"))
    whole = _contained(texts.where("length(text) >= 4").withColumnRenamed("text", "inner"), pats.withColumnRenamed("pattern", "outer")).select(F.col("inner").alias("text"), F.col("outer").alias("pattern"))
    met = held.union(whole).distinct()
    return symptoms.select("id", F.trim("text").alias("text")).distinct().join(met, "text").select("id", "pattern")


#: Characters by which texts and the patterns in them are brought together.
GRAM = 4


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): which of the distinct texts ``inner`` occur in which of the distinct texts ``outer``.

    Of an inner text the longest run of letters and digits gives the piece of GRAM characters that an outer text must
    hold; shorter ones use the whole run."""
    run = r"[\p{L}\p{N}]+"
    longest = F.element_at(F.array_sort(F.transform(F.regexp_extract_all("inner", F.lit(run), 0), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    keyed = inner.withColumn("w", F.try_element_at(F.regexp_extract_all("inner", F.lit(run), 0), F.lit(1))).where("w is not null").withColumn("w", longest)
    keyed = keyed.select("inner", F.substring("w", 1, GRAM).alias("piece"))
    sizes = F.array(*[F.lit(k) for k in range(1, GRAM + 1)])
    wanted = keyed.select("piece").distinct()
    words = outer.select("outer", F.explode(F.array_distinct(F.regexp_extract_all("outer", F.lit(run), 0))).alias("w"))
    cut = words.select("w").distinct().select("w", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.transform(sizes, lambda k: F.col("w").substr(i, k)))))).alias("piece"))
    has = cut.join(wanted, "piece", "left_semi")
    pairs = words.join(has, "w").select("outer", "piece").distinct().join(keyed, "piece").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer").distinct()
    bare = inner.where(~F.col("inner").rlike(run))
    return pairs.unionByName(bare.join(outer, F.col("outer").contains(F.col("inner"))).select("inner", "outer"))


def calibrated(queries: DataFrame, trajectories: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, id, score): past commands by 2 per word of the query they hold and 10 for the whole of it.

    Words of the query meet the words of the log by equality; only texts that share a word are scored."""
    low = F.lower(F.trim("text"))
    q = queries.select("query_id", low.alias("whole"), F.array_distinct(F.filter(F.split(low, r"[^a-z0-9_./-]+"), lambda w: F.length(w) > 2)).alias("ws"))
    t = trajectories.select("id", F.lower("goal").alias("goal"))
    words = t.select("id", F.explode(F.array_distinct(F.split("goal", r"[^a-z0-9_./-]+"))).alias("w"))
    met = words.join(q.select("query_id", F.explode("ws").alias("w")), "w").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    whole = met.join(t, "id").join(q.select("query_id", "whole"), "query_id")
    score = 2 * F.col("n") + F.when(F.col("goal").contains(F.col("whole")), 10).otherwise(0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return whole.select("query_id", "id", score.alias("score")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def staleness(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(id, status) of anchors (id, path, digest, mtime_ms) against a snapshot of files (path, now_digest,
    now_ms): unlinked (no such file), stale (other digest, or no digest and a time off by over two seconds), fresh."""
    j = anchors.join(files, "path", "left")
    moved = F.col("digest").isNull() & (F.abs(F.col("now_ms") - F.col("mtime_ms")) > 2000)
    status = F.when(F.col("now_ms").isNull(), "unlinked").when(F.col("digest") != F.col("now_digest"), "stale").when(moved, "stale").otherwise("fresh")
    return j.select("id", status.alias("status"))


def pack_rows(memories: DataFrame, facts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(kind, id, parent, line) of a portable pack: active memories, their active triples (parent is the memory) and
    aliases (alias, canonical) if given, one JSON line each."""
    m = memories.where("is_active").select(F.lit("memory").alias("kind"), "id", F.lit(None).cast("long").alias("parent"), F.to_json(F.struct("id", "content", "scope")).alias("line"))
    t = facts.where("is_active").select(F.lit("triple").alias("kind"), "id", F.col("memory_id").alias("parent"), F.to_json(F.struct("subject", "predicate", "object")).alias("line"))
    t = t.join(m.select(F.col("id").alias("parent")), "parent", "left_semi").select("kind", "id", "parent", "line")
    out = m.unionByName(t)
    if aliases is not None:
        none = F.lit(None).cast("long")
        out = out.unionByName(aliases.select(F.lit("alias").alias("kind"), none.alias("id"), none.alias("parent"), F.to_json(F.struct("alias", "canonical")).alias("line")))
    return out


def pack_checksum(rows: DataFrame) -> DataFrame:
    """(kind, n, checksum) of a pack: the rows' digests are summed in pieces, which does not depend on their
    order or the way they are split, and the sums are digested."""
    d = rows.select("kind", F.sha2("line", 256).alias("d"))
    piece = lambda k: F.sum(F.conv(F.substring("d", 15 * k + 1, 12), 16, 10).cast("decimal(38,0)"))
    g = d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[piece(k).alias(f"s{k}") for k in range(4)])
    return g.select("kind", "n", F.sha2(F.concat_ws("|", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("checksum"))


def vault_files(memories: DataFrame) -> DataFrame:
    """(id, folder, file, doc): a markdown file with front matter for each active memory."""
    folder = F.when(F.col("is_negative_constraint"), "rules").otherwise(F.concat(F.col("category"), F.lit("s")))
    head = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit('id: "'), F.col("id"), F.lit('"')), F.concat(F.lit('scope: "'), "scope", F.lit('"')), F.concat(F.lit('category: "'), "category", F.lit('"')),
        F.concat(F.lit('importance: "'), "importance", F.lit('"')), F.concat(F.lit("is_negative_constraint: "), F.col("is_negative_constraint").cast("string")), F.lit("---"), F.lit(""),
    )
    m = memories.where("is_active and content is not null")
    return m.select("id", folder.alias("folder"), F.concat(T.slug(F.col("content"), 28), F.lit("-"), F.col("id"), F.lit(".md")).alias("file"), F.concat(head, F.lit("\n"), F.col("content")).alias("doc"))


def vault_rows(files: DataFrame) -> DataFrame:
    """(id, scope, category, importance, negative, content) of markdown files (doc) with front matter; files
    without a numeric id, and keys other than these, are ignored."""
    head = F.regexp_extract("doc", r"^---\n([\s\S]*?)\n---\n", 1)
    value = lambda k: F.regexp_extract(head, rf'(?m)^{k}: "?(.*?)"?$', 1)
    body = F.regexp_replace(F.regexp_replace("doc", r"^---\n[\s\S]*?\n---\n", ""), r"^\n", "")
    rows = files.select(value("id").try_cast("long").alias("id"), value("scope").alias("scope"), value("category").alias("category"),
                        value("importance").alias("importance"), (value("is_negative_constraint") == "true").alias("negative"), body.alias("content"))
    return rows.where("id is not null")


def vault_changes(files: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, action): what an import of the files would do: insert, update (other content) or nothing (no row)."""
    old = memories.select("id", F.col("content").alias("old"), F.lit(True).alias("known"))
    j = lookup_join(vault_rows(files).select("id", "content"), old, "id", "left")
    action = F.when(F.col("known").isNull(), "insert").when(~F.col("old").eqNullSafe(F.col("content")), "update")
    return j.select("id", action.alias("action")).where("action is not null")


def verified_pack(rows: DataFrame, checksums: DataFrame) -> DataFrame:
    """rows of a pack, if they have the checksums (kind, n, checksum) it was exported with; raises ValueError otherwise.
    There is one checksum a kind of row."""
    want, got = ({r["kind"]: (r["n"], r["checksum"]) for r in d.select("kind", "n", "checksum").collect()} for d in (checksums, pack_checksum(rows)))
    if want != got:
        raise ValueError(f"the pack was changed: {sorted(k for k in want.keys() | got.keys() if want.get(k) != got.get(k))}")
    return rows


def imported_pack(rows: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the import of a pack does to a store: (old_id, id, action, content, scope) of its memories and (memory_id,
    subject, predicate, object) of its triples.

    A memory that the store holds already, active and equal but for case and punctuation, is ``reinforced`` under that
    id; of equal ones in the pack the first is ``inserted`` and the others reinforce it. New ids follow the store's
    largest in order of the old ones. Triples go with their memories; those whose memory is not in the pack are left out."""
    m = rows.where("kind = 'memory'").select(F.from_json("line", "id long, content string, scope string").alias("m")).select(F.col("m.id").alias("old_id"), "m.content", "m.scope").where("old_id is not null and content is not null")
    m = m.groupBy("old_id").agg(F.min(F.struct("content", "scope")).alias("m")).select("old_id", "m.*").withColumn("fp", F.sha2(T.normalized(F.col("content")), 256))
    known = memories.where("is_active and content is not null").groupBy(F.sha2(T.normalized(F.col("content")), 256).alias("fp")).agg(F.min("id").alias("known"))
    firsts = m.groupBy("fp").agg(F.min("old_id").alias("first")).join(known, "fp", "left")
    above = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("above")).join(m.agg(F.coalesce(F.min("old_id"), F.lit(0)).alias("low")))  # one row
    j = lookup_join(m, firsts, "fp", "inner").join(F.broadcast(above))
    fresh = F.col("known").isNull()
    done = j.select("old_id", F.when(fresh, F.col("above") + 1 + F.col("first") - F.col("low")).otherwise(F.col("known")).alias("id"), F.when(fresh & (F.col("old_id") == F.col("first")), "inserted").otherwise("reinforced").alias("action"), "content", "scope")
    t = rows.where("kind = 'triple'").select("parent", F.from_json("line", "subject string, predicate string, object string").alias("t"))
    moved = lookup_join(t, done.select(F.col("old_id").alias("parent"), "id"), "parent", "inner").select(F.col("id").alias("memory_id"), "t.subject", "t.predicate", "t.object")
    return done, moved.distinct()


def session_status(notes: DataFrame, as_of: Column, idle: str = "1 day") -> DataFrame:
    """(session, status): abandoned if the same peer began another session before this one's last note,
    active if the last note is younger than ``idle``, else ended."""
    s = notes.where("session_id is not null and timestamp is not null").groupBy(F.col("session_id").alias("session")).agg(
        F.min("timestamp").alias("began"), F.max("timestamp").alias("last"), F.min_by("peer", F.struct("timestamp", "id")).alias("peer"))
    seg = range_segments(s, ["peer"], ["began", "session"])
    nxt = carry_lead(seg, ["peer"], ["began", "session"], F.col("began"), "next")
    left = F.coalesce(F.col("peer").isNotNull() & (F.col("next.v") < F.col("last")), F.lit(False))
    status = F.when(left, "abandoned").when(F.col("last") > as_of - F.expr(f"interval {idle}"), "active").otherwise("ended")
    return nxt.select("session", status.alias("status"))


def aliases(memories: DataFrame) -> DataFrame:
    """(alias, canonical): the latest name that a memory gives an alias."""
    t = memories.select("id", "created_at", F.explode(T.triples(F.col("content"))).alias("t")).where("t.predicate = 'ALIAS_OF'")
    return t.groupBy(F.col("t.subject").alias("alias")).agg(F.max_by("t.object", F.struct("created_at", "id")).alias("canonical"))
