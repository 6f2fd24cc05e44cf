"""Blocks, boards, sessions, candidates, rules, rendered context, the write path and lists of reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators import beliefs as B
from sediment.operators import graph as G
from sediment.operators import workspace as S
from sediment.plans.belief_queries import _K, _PAIR
from sediment.plans.common import AS_OF_SQL, FACTS_SQL, MEMORIES_SQL, facts, memories, now
from sediment.plans.recall_queries import _FOUND, _RESONANT, _found, recall_resonance
from sediment.plans.text_queries import _CAND, _NOISE, _NORM, _TRIPLES, _ci, _in, stage_candidates
from sediment.sources import table


def block_set(spark, d):
    """Every block written anew, with its content three times over."""
    b = table(spark, d, "context_blocks")
    return S.set_blocks(b, b.select("name", F.concat("content", F.lit(" "), "content", F.lit("\n"), "content").alias("text")))


def block_append(spark, d):
    """A line added to every block, to a new one and to one whose name is not allowed."""
    b = table(spark, d, "context_blocks")
    more = spark.createDataFrame([("fresh.block", " first line "), ("../up", "x"), ("scratchpad", "- next")], "name string, text string")
    return S.set_blocks(b, b.select("name", F.concat(F.lit(" - more of "), "name").alias("text")).unionByName(more).dropDuplicates(["name"]), append=True)


def blackboard_arbitration(spark, d):
    """Claims are the events of a user and key; those of type purchase are a leader's."""
    e = table(spark, d, "events")
    log = e.select("user_id", (F.get_json_object("props", "$.k").cast("long") % 4).alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.round("value", 0).cast("long") % 3).alias("value"),
                   F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0), "lead").otherwise(F.col("event_type")).alias("author"))
    return S.arbitrated(log, ["user_id", "key"], ["at", "seq"])


def rules_export(spark, d):
    return S.rule_lines(memories(spark, d))


def recall_text(spark, d):
    """The results of recall_resonance as text."""
    return S.rendered(recall_resonance(spark, d), memories(spark, d))


def session_counters(spark, d):
    return S.session_counters(memories(spark, d), table(spark, d, "notes"))


def session_list(spark, d):
    return S.recent_sessions(table(spark, d, "notes"))


def _candidates(spark, d):
    n = table(spark, d, "notes").where("content is not null").groupBy("id", "content").agg(F.max(F.unix_millis("timestamp")).alias("created_ms"))
    return stage_candidates(spark, d).join(n, "id")


def candidate_list(spark, d):
    return S.candidate_list(_candidates(spark, d)).select("id", "confidence", "kind", "created_ms")


def candidate_promote(spark, d):
    return S.promoted_candidates(_candidates(spark, d))


def trajectory_list(spark, d):
    """Tool notes by their wording."""
    n = table(spark, d, "notes").where("content is not null and lower(trim(role)) in ('tool', 'function')").groupBy("id", F.lower(F.regexp_replace("content", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("goal")).agg(F.max(F.unix_millis("timestamp")).alias("at_ms"))
    return S.trajectories(n.where("goal != ''"))


def error_capture(spark, d):
    return S.captured_errors(table(spark, d, "notes").where("content is not null").select("id", F.col("content").alias("text")).distinct())


def remember(spark, d):
    """The statements of users in notes, in order of id, against the store: what each would do to it."""
    n = table(spark, d, "notes").where("id is not null and content is not null and lower(trim(role)) in ('user', 'human')").groupBy("id").agg(F.min("content").alias("content"))
    return B.remembered(n, memories(spark, d))


def extract_and_upsert(spark, d):
    """The triples of users' notes against the stored facts."""
    n = table(spark, d, "notes").where("id is not null and content is not null and lower(trim(role)) in ('user', 'human')").groupBy("id").agg(F.min("content").alias("content"), F.max("timestamp").alias("at"))
    return B.extracted_upserts(n.where("at is not null"), facts(spark, d))


def delete_fact(spark, d):
    """Memories without confidence left, by id, and their active triples."""
    m = memories(spark, d)
    return B.deleted(m.where("contradiction_count >= 2").select("id"), m, facts(spark, d))


def timeline_of(spark, d):
    """What happened to the first memory that mentions a topic."""
    m = memories(spark, d)
    one = m.where(F.lower("content").contains("event log")).orderBy("id").limit(1).select("id")
    t = B.timeline(m.join(F.broadcast(one), "id", "left_semi"), facts(spark, d).join(F.broadcast(one.withColumnRenamed("id", "memory_id")), "memory_id", "left_semi"))  # one row
    return t.select("memory_id", "event", F.unix_millis("at").alias("at_ms"))


def digest_lists(spark, d):
    """The latest ten prohibitions and fifteen other memories of the last 30 days."""
    m = memories(spark, d).where("is_active").where(F.col("created_at") >= now() - F.expr("interval 30 days"))
    neg = m.where("is_negative_constraint").orderBy(F.desc("created_at"), F.desc("id")).limit(10)
    rest = m.where("not is_negative_constraint").orderBy(F.desc("created_at"), F.desc("id")).limit(15)
    return neg.select(F.lit("guardrail").alias("list"), "id", "content").union(rest.select(F.lit("memory"), "id", "content"))


def reflect_lists(spark, d):
    """The ten weightiest memories on a topic, as directives and patterns."""
    m = memories(spark, d).where(F.col("is_active") & (F.lower("content").contains("rate limiter") | F.lower("category").contains("rate limiter")))
    kind = F.when(F.col("is_negative_constraint") | (F.col("category") == "rule"), "directive").otherwise("pattern")
    return m.orderBy(F.desc("access_count"), "id").limit(10).select(kind.alias("kind"), "id", "content")


def community_list(spark, d):
    """(community, members, category, entities): size, commonest category and the five commonest entities."""
    m, f = memories(spark, d), facts(spark, d)
    return G.described(G.communities(f, m), f, m)


def explain_contradictions(spark, d):
    """Contradictions among the triples of each query's results."""
    return B.contradictions(_found(spark, d), facts(spark, d))


QUERIES = {
    f.__name__: f
    for f in (block_set, block_append, blackboard_arbitration, rules_export, recall_text, session_counters, session_list, candidate_list, candidate_promote, trajectory_list, error_capture, remember,
              extract_and_upsert, delete_fact, timeline_of, digest_lists, reflect_lists, community_list, explain_contradictions)
}

_M, _MF = f"WITH {MEMORIES_SQL} ", f"WITH {MEMORIES_SQL}, {FACTS_SQL}, "
_MARK = "chr(10) || '... [truncated to fit block token budget]'"
_BASE = "b AS (SELECT name, content, token_limit FROM context_blocks UNION ALL SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {})".format(n, c, k) for n, c, k in S.DEFAULT_BLOCKS) + ") v(n, c, k) WHERE n NOT IN (SELECT name FROM context_blocks))"
_FIT = "CASE WHEN length({0}) > {1} * 4 THEN substr({0}, 1, {1} * 4) || " + _MARK + " ELSE {0} END"
_SAID = "n AS (SELECT id, min(content) AS content, max(timestamp) AS ts FROM notes WHERE id IS NOT NULL AND content IS NOT NULL AND lower(trim(role)) IN ('user', 'human') GROUP BY id)"
_TOOL = "lower(trim(role)) IN ('tool', 'function')"
_NEGATIVE = _ci("content", W.NEGATIVE)

ORACLE = {
    "block_set": f"WITH {_BASE}, u AS (SELECT name, token_limit, content, trim(content || ' ' || content || chr(10) || content) AS x FROM context_blocks), s AS (SELECT name, {_FIT.format('x', 'token_limit')} AS content, token_limit FROM u WHERE x IS NOT NULL) "
    "SELECT name, content, token_limit FROM s UNION ALL SELECT name, content, token_limit FROM b WHERE name NOT IN (SELECT name FROM s)",
    "block_append": f"""WITH {_BASE}, u AS (SELECT name, ' - more of ' || name AS x FROM context_blocks UNION ALL SELECT * FROM (VALUES ('fresh.block', ' first line '), ('scratchpad', '- next')) WHERE col0 NOT IN (SELECT name FROM context_blocks)),
j AS (SELECT coalesce(b.name, u.name) AS name, b.content, coalesce(token_limit, 500) AS k, CASE WHEN b.name IS NULL THEN trim(x) ELSE trim(trim(coalesce(content, '')) || chr(10) || trim(x)) END AS x FROM b FULL JOIN u ON b.name = u.name)
SELECT name, CASE WHEN x IS NULL THEN content ELSE {_FIT.format('x', 'k')} END AS content, k AS token_limit FROM j""",
    "blackboard_arbitration": """WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS key, ts, event_id, CAST(round(value, 0) AS BIGINT) % 3 AS v,
  CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'lead' ELSE event_type END AS a FROM events),
f AS (SELECT user_id, key, list_reduce(list({'v': v, 'a': a, 'n': 1, 'd': 0} ORDER BY ts, event_id), lambda s, x: CASE WHEN s.v IS NOT DISTINCT FROM x.v THEN s
  WHEN s.a IN ('main', 'lead') THEN {'v': s.v, 'a': s.a, 'n': s.n, 'd': s.d + 1} ELSE {'v': x.v, 'a': x.a, 'n': s.n + 1, 'd': s.d + 1} END) AS s FROM e GROUP BY ALL)
SELECT user_id, key, s.v AS value, s.a AS author, s.n AS version, s.d AS disputes FROM f""",
    "rules_export": _M + """, r AS (SELECT *, upper(coalesce(importance, 'normal')) AS lv FROM m WHERE is_active AND content IS NOT NULL AND (is_negative_constraint OR category IN ('rule', 'architecture', 'hardware')))
SELECT f.format, CASE WHEN is_negative_constraint THEN 1 ELSE 2 END AS section, id, CASE f.kind
  WHEN 1 THEN CASE WHEN is_negative_constraint THEN '> * **[' || lv || ']** ' || content ELSE '* ' || CASE WHEN importance IN ('critical', 'high') THEN '[' || lv || '] ' ELSE '' END || content END
  WHEN 2 THEN CASE WHEN is_negative_constraint THEN '- NEVER ' ELSE '- ' END || content ELSE CASE WHEN is_negative_constraint THEN '[FORBIDDEN] ' ELSE '[RULE] ' END || content END AS line
FROM r, (VALUES ('agents.md', 1), ('editor_rules', 2), ('assistant.md', 2), ('system_prompt', 3)) f(format, kind)""",
    "recall_text": _FOUND + _RESONANT + """, j AS (SELECT query_id, rank, coalesce(content, '') AS c, CASE WHEN is_negative_constraint THEN 1 WHEN outcome = 'failure' THEN 2 ELSE 3 END AS part, '**(' || coalesce(scope, '') || ')** ' AS wh,
  ' *(relevance: ' || CAST(round(score * 100, 0) AS INT) || '%)*' AS sh, CASE WHEN importance IN ('critical', 'high') THEN ' [' || upper(importance) || ']' ELSE '' END AS ba, coalesce(' (Reason: ' || failure_reason || ')', '') AS re FROM f1 JOIN m USING (id)),
p AS (SELECT query_id, part, string_agg(CASE part WHEN 1 THEN '⛔ ' || c WHEN 2 THEN 'Avoid: ' || c ELSE c END, ' | ' ORDER BY rank) AS short,
  string_agg(CASE part WHEN 1 THEN '- 🚫 ' || wh || c || sh WHEN 2 THEN '- ⚠️ ' || wh || c || re || sh ELSE '- ' || wh || c || ba || sh END, chr(10) ORDER BY rank) AS line FROM j GROUP BY ALL),
o AS (SELECT *, count(*) FILTER (part < 3) OVER (PARTITION BY query_id) AS others FROM p)
SELECT query_id, string_agg(chr(10) || ['[🚨 CRITICAL NEGATIVE RULES - NEVER VIOLATE]', '[⚠️ PAST PITFALLS & FAILURE LESSONS]', '[ACTIVE CONTEXTUAL RECALL]'][part] || chr(10) || short, chr(10) ORDER BY part) AS macro,
  '### 🏛️ Recalled Context & Knowledge' || chr(10) || string_agg(CASE WHEN part = 3 AND others = 0 THEN '' ELSE chr(10) || ['**🚨 Critical Negative Constraints (Do Not Violate):**', '**⚠️ Past Failure Lessons & Pitfalls:**', '**💡 Context & Facts:**'][part] || chr(10) END || line, chr(10) ORDER BY part) AS meso
FROM o GROUP BY query_id""",
    "session_counters": _M + f""", a AS (SELECT source_session AS session, count(*) AS w, count(*) FILTER (is_negative_constraint) AS g FROM m WHERE source_session IS NOT NULL GROUP BY 1),
c AS (SELECT session_id AS session, count(DISTINCT id) AS r FROM notes WHERE session_id IS NOT NULL AND {_TOOL} GROUP BY 1),
j AS (SELECT coalesce(a.session, c.session) AS session, coalesce(w, 0) AS writes, coalesce(g, 0) AS guardrails, coalesce(r, 0) AS recalls FROM a FULL JOIN c ON a.session = c.session)
SELECT *, 'Memories written: ' || writes || ' (' || guardrails || ' guardrails) | Recalls: ' || recalls AS summary FROM j""",
    "session_list": "SELECT session_id AS session, epoch_ms(min(timestamp)) AS began_ms, epoch_ms(max(timestamp)) AS last_ms FROM notes WHERE session_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 10",
    "candidate_list": f"WITH {_CAND}, x AS (SELECT id, content, max(epoch_ms(timestamp)) AS created_ms FROM notes WHERE content IS NOT NULL GROUP BY ALL) SELECT s.id, confidence, kind, created_ms FROM s JOIN x ON x.id = s.id WHERE confidence >= 0.5 AND NOT ({_NOISE.replace('content', 's.content')} AND NOT {_ci('s.content', W.GUARD)}) AND NOT (confidence >= 0.8 AND kind IN ('negative_constraint', 'rule', 'hardware')) ORDER BY confidence DESC, created_ms DESC NULLS LAST, s.id LIMIT 20",
    "candidate_promote": f"WITH {_CAND}, x AS (SELECT DISTINCT id, content AS c2 FROM notes WHERE content IS NOT NULL) SELECT s.id, c2 AS content, kind AS category, CASE WHEN kind = 'negative_constraint' THEN 'high' ELSE 'normal' END AS importance, kind = 'negative_constraint' AS is_negative_constraint FROM s JOIN x ON x.id = s.id WHERE confidence >= 0.5 AND NOT ({_NOISE} AND NOT {_ci('content', W.GUARD)}) AND NOT (confidence >= 0.8 AND kind IN ('negative_constraint', 'rule', 'hardware'))",
    "trajectory_list": f"WITH x AS (SELECT id, lower(regexp_replace(content, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS goal, max(epoch_ms(timestamp)) AS a FROM notes WHERE content IS NOT NULL AND {_TOOL} GROUP BY ALL) SELECT goal, count(*) AS n, max(a) AS last_ms FROM x WHERE goal != '' GROUP BY 1 ORDER BY 2 DESC, 3 DESC NULLS LAST, 1 LIMIT 20",
    "error_capture": f"WITH x AS (SELECT DISTINCT id, content FROM notes WHERE content IS NOT NULL AND {_ci('content', W.FAILURE)}) SELECT 'remediation' AS kind, id, lower(trim(content)) AS text FROM x UNION ALL SELECT 'rule', id, 'Avoid: ' || trim(content) FROM x",
    "remember": _M + f""", {_SAID}, r AS (SELECT id, content, {_NEGATIVE} AS neg, sha256({_NORM}) AS fp FROM n),
k AS (SELECT sha256({_NORM}) AS fp, is_negative_constraint AS neg, arg_min(id, (created_at, id)) AS known FROM m WHERE is_active AND content IS NOT NULL GROUP BY ALL),
z AS (SELECT r.*, known, min(id) OVER (PARTITION BY fp, neg) AS first FROM r LEFT JOIN (SELECT fp, neg, min(known) AS known FROM k GROUP BY ALL) k USING (fp, neg))
SELECT id, CASE WHEN {_NOISE} AND NOT neg THEN 'dropped' WHEN known IS NOT NULL THEN 'reinforced' WHEN id = first THEN 'inserted' ELSE 'reinforced' END AS action,
  CASE WHEN {_NOISE} AND NOT neg THEN NULL WHEN known IS NOT NULL THEN known WHEN id != first THEN first END AS target, neg AS is_negative_constraint,
  CASE WHEN neg THEN 'imperative' ELSE 'declarative' END AS memory_type, CASE WHEN {_ci('content', W.FAILURE)} THEN 'failure' ELSE 'neutral' END AS outcome FROM z""",
    "extract_and_upsert": f"WITH {FACTS_SQL}, {_SAID}, k AS (SELECT id, trim(content) AS c FROM n WHERE ts IS NOT NULL), {_TRIPLES}" + f""",
a AS (SELECT created_at AS ts, 0 AS fresh, id, '' AS b, subject, predicate, object FROM t UNION ALL SELECT ts, 1, tr.id, concat_ws(chr(1), predicate, object, subject), subject, predicate, object FROM tr JOIN n ON n.id = tr.id),
c AS (SELECT *, lower(subject) AS ks, lower(object) AS ko FROM a WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, lag(ko) OVER (PARTITION BY ks, predicate ORDER BY ts, fresh, id, b) AS prev, CASE WHEN {_PAIR} IS NOT NULL THEN lag(predicate) OVER (PARTITION BY ks, {_PAIR}, ko ORDER BY ts, fresh, id, b) END AS pp FROM c)
SELECT id, subject, predicate, object, CASE WHEN pp != predicate THEN 'superseded' WHEN prev IS NULL THEN 'inserted' WHEN prev = ko THEN 'reinforced' ELSE 'updated' END AS action FROM p WHERE fresh = 1""",
    "delete_fact": _MF + "h AS (SELECT id FROM m WHERE contradiction_count >= 2 AND is_active) SELECT 'memory' AS kind, id FROM h UNION ALL SELECT 'triple', t.id FROM t JOIN h ON h.id = t.memory_id WHERE t.is_active",
    "timeline_of": _MF + """o AS (SELECT * FROM m WHERE id = (SELECT min(id) FROM m WHERE contains(lower(content), 'event log'))),
x AS (SELECT id AS memory_id, 'CREATED' AS event, created_at AS ts FROM o UNION ALL SELECT id, 'MUTATED', updated_at FROM o WHERE updated_at > created_at
  UNION ALL SELECT id, 'SUPERSEDED', updated_at FROM o WHERE superseded_by_id IS NOT NULL UNION ALL SELECT memory_id, 'ASSERTED', t.created_at FROM t JOIN o ON o.id = memory_id)
SELECT memory_id, event, epoch_ms(ts) AS at_ms FROM x WHERE ts IS NOT NULL""",
    "digest_lists": _M + f", x AS (SELECT *, row_number() OVER (PARTITION BY is_negative_constraint ORDER BY created_at DESC, id DESC) AS rn FROM m WHERE is_active AND created_at >= {AS_OF_SQL} - INTERVAL 30 DAYS) SELECT CASE WHEN is_negative_constraint THEN 'guardrail' ELSE 'memory' END AS list, id, content FROM x WHERE rn <= CASE WHEN is_negative_constraint THEN 10 ELSE 15 END",
    "reflect_lists": _M + "SELECT CASE WHEN is_negative_constraint OR category = 'rule' THEN 'directive' ELSE 'pattern' END AS kind, id, content FROM m WHERE is_active AND (contains(lower(content), 'rate limiter') OR contains(category, 'rate limiter')) ORDER BY access_count DESC, id LIMIT 10",
    "community_list": f"WITH RECURSIVE {MEMORIES_SQL}, {FACTS_SQL}, " + f"""g AS (SELECT DISTINCT t.memory_id AS id, lower(object) AS e FROM t JOIN m ON m.id = t.memory_id AND m.is_active WHERE t.is_active AND length(trim(object)) > 2 AND lower(trim(object)) NOT IN {_in(W.STOPWORDS + W.GENERIC)}),
nb AS (SELECT DISTINCT x.id AS a, y.id AS b FROM g x JOIN g y ON x.e = y.e), r(a, b) AS (SELECT a, b FROM nb UNION SELECT r.a, nb.b FROM r JOIN nb ON nb.a = r.b),
c AS (SELECT coalesce(c.community, m.id) AS community, m.id, category FROM m LEFT JOIN (SELECT a, min(b) AS community FROM r GROUP BY a) c ON c.a = m.id WHERE is_active),
ct AS (SELECT community, category, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, category NULLS LAST) AS rn FROM c GROUP BY community, category),
et AS (SELECT community, e, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, e) AS rn FROM c JOIN g ON g.id = c.id GROUP BY community, e)
SELECT c.community, count(*) AS members, any_value(ct.category) AS category, coalesce(any_value(x.entities), '') AS entities FROM c JOIN ct ON ct.community = c.community AND ct.rn = 1
LEFT JOIN (SELECT community, string_agg(e, ', ' ORDER BY rn) AS entities FROM et WHERE rn <= 5 GROUP BY 1) x ON x.community = c.community GROUP BY c.community""",
    "explain_contradictions": _FOUND + ", x AS (SELECT query_id, lower(subject) AS s, lower(object) AS o, predicate AS p FROM f0 JOIN t ON t.memory_id = f0.id WHERE t.is_active) SELECT DISTINCT a.query_id, a.s AS subject, a.p AS positive, b.p AS negative, a.o AS object FROM x a JOIN x b ON a.query_id = b.query_id AND a.s = b.s AND a.o = b.o AND a.p < b.p WHERE ("
    + " OR ".join(f"(a.p = '{min(a, b)}' AND b.p = '{max(a, b)}')" for a, b in W.OPPOSITES.items() if a < b) + ")",
}
