"""Working memory of an agent: context blocks, shared boards, sessions, candidates, rules and rendered context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators.segments import carry_lag, range_segments
from sediment.operators.skew import lookup_join

# Blocks that always exist (name, content, limit in tokens), the limit of others and the mark of a cut.
DEFAULT_BLOCKS = [
    ("active_task", "# Active Task\nStatus: Idle. Ready for user instructions.", 300),
    ("scratchpad", "# Working Scratchpad\nEmpty scratchpad for temporary notes and plan steps.", 500),
    ("user_profile", "# User Profile\nDeveloper working on high-performance local AI agent systems.", 300),
]
DEFAULT_LIMIT, CUT_MARK, CHARS_PER_TOKEN = 500, "\n... [truncated to fit block token budget]", 4
# Authors whose claims stand against others.
LEADERS = ["main", "lead"]


def blocks(stored: DataFrame) -> DataFrame:
    """(name, content, token_limit): the stored blocks and those of the defaults that are missing."""
    base = stored.sparkSession.createDataFrame(DEFAULT_BLOCKS, "name string, content string, token_limit int")
    have = stored.where("name is not null").groupBy("name").agg(F.max(F.struct("token_limit", "content")).alias("b")).select("name", "b.content", "b.token_limit")
    return have.unionByName(base.join(have, "name", "left_anti"))


def fitted(content: Column, limit: Column) -> Column:
    """Trimmed text, cut at CHARS_PER_TOKEN characters a token with a mark behind it; null counts as empty."""
    c = F.trim(F.coalesce(content, F.lit("")))
    most = limit * CHARS_PER_TOKEN
    return F.when(F.length(c) > most, F.concat(F.left(c, most), F.lit(CUT_MARK))).otherwise(c)


def set_blocks(stored: DataFrame, updates: DataFrame, append: bool = False) -> DataFrame:
    """The blocks after updates (name, text[, token_limit]), one per name: replaced, or with append added as a line.
    Names that are not allowed change nothing; a limit not given stays, or is DEFAULT_LIMIT for new blocks."""
    now = blocks(stored)
    new = updates.where(T.block_name_ok(F.col("name"))).select(F.trim("name").alias("name"), F.col("text").alias("_text"), (F.col("token_limit") if "token_limit" in updates.columns else F.lit(None).cast("int")).alias("_limit"))
    j = now.join(new, "name", "full")
    limit = F.coalesce("_limit", "token_limit", F.lit(DEFAULT_LIMIT))
    text = F.when(F.lit(append) & F.col("token_limit").isNotNull(), F.concat(F.trim(F.coalesce("content", F.lit(""))), F.lit("\n"), F.trim("_text"))).otherwise(F.trim("_text"))
    return j.select("name", F.when(F.col("_text").isNull(), F.col("content")).otherwise(fitted(text, limit)).alias("content"), F.when(F.col("_text").isNull(), F.col("token_limit")).otherwise(limit).alias("token_limit"))


def arbitrated(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, value, author, version, disputes): what a board holds after all claims (keys, value, author, order), in order.

    The first claim stands; an equal one changes nothing; another one wins, unless the claim that stands is a
    leader's. So a board follows its claims until a leader's claim differs from the one before it; from there on that
    one stands. Only neighbours in order are compared, in segments, so a key may hold any share of the log."""
    seg = range_segments(log, keys, order)
    seen = carry_lag(seg, keys, order, F.col("value"), "prev")
    new = F.col("prev").isNull() | ~F.col("prev.v").eqNullSafe(F.col("value"))
    at = F.struct(*order)
    rows = seen.select(*keys, at.alias("at"), "value", "author", new.alias("new"), F.col("prev").isNull().alias("first"))
    lead = rows.where(F.col("new") & F.col("author").isin(LEADERS)).groupBy(*keys).agg(F.min(F.struct("at", "value", "author")).alias("lead"))
    one = F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys])
    j = lookup_join(rows.withColumn("_key", one), lead.select(one.alias("_key"), "lead"), "_key", "left").drop("_key")
    before = F.col("lead").isNull() | (F.col("at") <= F.col("lead.at"))
    turn = before & F.col("new")
    disputed = F.when(before, F.col("new") & ~F.col("first")).otherwise(~F.col("value").eqNullSafe(F.col("lead.value")))
    out = j.groupBy(*keys).agg(F.max(F.when(turn, F.struct("at", "value", "author"))).alias("s"), F.count(F.when(turn, 1)).alias("version"), F.count(F.when(disputed, 1)).alias("disputes"))
    return out.select(*keys, "s.value", "s.author", "version", "disputes")


def rule_lines(memories: DataFrame, scope: str | None = None) -> DataFrame:
    """(format, section, id, line): every active rule as a line of four formats: two of files for agents, one of an
    editor and one of a system prompt. Prohibitions are section 1, other rules 2; lines are not gathered into one text, as
    there may be any number."""
    m = memories.where("is_active and content is not null").where(F.col("is_negative_constraint") | F.col("category").isin("rule", "architecture", "hardware"))
    if scope:
        m = m.where(F.col("scope").isin(scope, "global"))
    neg, level = F.col("is_negative_constraint"), F.upper(F.coalesce("importance", F.lit("normal")))
    badge = F.when(F.col("importance").isin("critical", "high"), F.concat(F.lit("["), level, F.lit("] "))).otherwise("")
    lines = {
        "agents": F.when(neg, F.concat(F.lit("> * **["), level, F.lit("]** "), "content")).otherwise(F.concat(F.lit("* "), badge, "content")),
        "editor": F.concat(F.when(neg, "- NEVER ").otherwise("- "), "content"),
        "prompt": F.concat(F.when(neg, "[FORBIDDEN] ").otherwise("[RULE] "), "content"),
    }
    formats = {"agents.md": "agents", "editor_rules": "editor", "assistant.md": "editor", "system_prompt": "prompt"}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), lines[k].alias("line")) for f, k in formats.items()]))
    return m.select(F.when(neg, 1).otherwise(2).alias("section"), "id", each.alias("e")).select("e.format", "section", "id", "e.line")


def rendered(found: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, macro, meso): the results (query_id, id, score, rank) of each query as text, prohibitions first, then
    lessons of failures, then the rest. macro joins them in lines, meso lists them with scope and relevance."""
    m = memories.select("id", "content", "scope", "importance", "failure_reason", F.coalesce("is_negative_constraint", F.lit(False)).alias("neg"), F.coalesce(F.col("outcome") == "failure", F.lit(False)).alias("failed"))
    j = lookup_join(found.select("query_id", "id", "score", "rank"), m, "id", "inner")
    part = F.when(F.col("neg"), 1).when(F.col("failed"), 2).otherwise(3)
    share = F.concat(F.lit(" *(relevance: "), F.round(F.col("score") * 100, 0).cast("int").cast("string"), F.lit("%)*"))
    where = F.concat(F.lit("**("), F.coalesce("scope", F.lit("")), F.lit(")** "))
    text = F.coalesce("content", F.lit(""))
    badge = F.when(F.col("importance").isin("critical", "high"), F.concat(F.lit(" ["), F.upper("importance"), F.lit("]"))).otherwise("")
    reason = F.when(F.col("failure_reason").isNotNull(), F.concat(F.lit(" (Reason: "), "failure_reason", F.lit(")"))).otherwise("")
    line = F.when(part == 1, F.concat(F.lit("- 🚫 "), where, text, share)).when(part == 2, F.concat(F.lit("- ⚠️ "), where, text, reason, share)).otherwise(F.concat(F.lit("- "), where, text, badge, share))
    short = F.when(part == 1, F.concat(F.lit("⛔ "), text)).when(part == 2, F.concat(F.lit("Avoid: "), text)).otherwise(text)
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(part.alias("part"), "rank", line.alias("line"), short.alias("short")))).alias("l"))  # a top-k list

    def of(k: int, name: str) -> Column:
        return F.transform(F.filter("l", lambda x: x["part"] == k), lambda x: x[name])

    # Headings of the two formats.
    heads = {1: "[🚨 CRITICAL NEGATIVE RULES - NEVER VIOLATE]", 2: "[⚠️ PAST PITFALLS & FAILURE LESSONS]", 3: "[ACTIVE CONTEXTUAL RECALL]"}
    titles = {1: "**🚨 Critical Negative Constraints (Do Not Violate):**", 2: "**⚠️ Past Failure Lessons & Pitfalls:**", 3: "**💡 Context & Facts:**"}
    macro = [F.when(F.size(of(k, "short")) > 0, F.concat(F.lit("\n" + heads[k] + "\n"), F.array_join(of(k, "short"), " | "))) for k in (1, 2, 3)]
    bare = (F.size(of(1, "line")) + F.size(of(2, "line"))) == 0
    meso = [F.when(F.size(of(k, "line")) > 0, F.concat(F.when(bare & F.lit(k == 3), "").otherwise("\n" + titles[k] + "\n"), F.array_join(of(k, "line"), "\n"))) for k in (1, 2, 3)]
    return g.select("query_id", F.concat_ws("\n", *macro).alias("macro"), F.concat_ws("\n", F.lit("### 🏛️ Recalled Context & Knowledge"), *meso).alias("meso"))


def session_counters(memories: DataFrame, notes: DataFrame) -> DataFrame:
    """(session, writes, guardrails, recalls, summary): memories written in a session, prohibitions among them, and its
    tool calls, with a summary line."""
    a = memories.where("source_session is not null").groupBy(F.col("source_session").alias("session")).agg(F.count(F.lit(1)).alias("writes"), F.count(F.when(F.col("is_negative_constraint"), 1)).alias("guardrails"))
    calls = notes.where("session_id is not null").where(F.lower(F.trim("role")).isin("tool", "function")).groupBy(F.col("session_id").alias("session")).agg(F.countDistinct("id").alias("recalls"))
    j = a.join(calls, "session", "full").select("session", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("writes", "guardrails", "recalls")])
    return j.withColumn("summary", F.format_string("Memories written: %d (%d guardrails) | Recalls: %d", "writes", "guardrails", "recalls"))


def recent_sessions(notes: DataFrame, limit: int = 10) -> DataFrame:
    """(session, began_ms, last_ms): the sessions begun last."""
    s = notes.where("session_id is not null and timestamp is not null").groupBy(F.col("session_id").alias("session")).agg(F.unix_millis(F.min("timestamp")).alias("began_ms"), F.unix_millis(F.max("timestamp")).alias("last_ms"))
    return s.orderBy(F.desc("began_ms"), F.desc("session")).limit(limit)


def candidate_list(candidates: DataFrame, status: str = "pending", limit: int = 20) -> DataFrame:
    """The surest candidates (id, confidence, kind, status, created_ms) of a status, the latest first among equals."""
    return candidates.where(F.col("status") == status).orderBy(F.desc("confidence"), F.desc("created_ms"), "id").limit(limit)


def promoted_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates not promoted yet as memories to write: (id, content, category, importance, is_negative_constraint)."""
    neg = F.col("kind") == "negative_constraint"
    return candidates.where("status != 'promoted'").select("id", "content", F.col("kind").alias("category"), F.when(neg, "high").otherwise("normal").alias("importance"), neg.alias("is_negative_constraint"))


def rejected_candidates(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status) of the candidates to reject: pending ones only."""
    return lookup_join(candidates.where("status = 'pending'").select("id"), ids.select("id").distinct(), "id", "left_semi").withColumn("status", F.lit("rejected"))


def trajectories(calls: DataFrame, limit: int = 20) -> DataFrame:
    """(goal, n, last_ms) of a log (goal, at_ms): how often each was done, the most frequent first."""
    g = calls.where("goal is not null").groupBy("goal").agg(F.count(F.lit(1)).alias("n"), F.max("at_ms").alias("last_ms"))
    return g.orderBy(F.desc("n"), F.desc("last_ms"), "goal").limit(limit)


def captured_errors(events: DataFrame) -> DataFrame:
    """Failures (id, text) as rows to write: a remedy that waits for its fix and a rule, (kind, id, text)."""
    bad = events.where(T.matches(F.col("text"), W.FAILURE))
    each = F.explode(F.array(F.struct(F.lit("remediation").alias("kind"), F.lower(F.trim("text")).alias("text")), F.struct(F.lit("rule").alias("kind"), F.concat(F.lit("Avoid: "), F.trim("text")).alias("text"))))
    return bad.select("id", each.alias("e")).select("e.kind", "id", "e.text")
