"""Belief maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import words as W
from sediment.operators import beliefs as B
from sediment.plans.common import AS_OF_SQL, FACTS_SQL, MEMORIES_SQL, facts, links, LINKS_SQL, memories, now
from sediment.plans.text_queries import _NORM, _in
from sediment.sources import table

CAP = 1000


def _single(f):
    return f.where(~F.col("predicate").isin(W.MULTI_VALUED))


def resolve_single_valued(spark, d):
    return B.resolve(_single(facts(spark, d)), ["ks", "predicate"])


def resolve_multi_valued(spark, d):
    return B.resolve(facts(spark, d).where(F.col("predicate").isin(W.MULTI_VALUED)), ["ks", "predicate", "ko"])


def resolve_antonym(spark, d):
    return B.resolve_antonyms(facts(spark, d))


def upsert_actions(spark, d):
    return B.upsert_actions(facts(spark, d))


def dedup_fingerprint(spark, d):
    return B.reinforced(memories(spark, d))


def dedup_semantic(spark, d):
    return B.same_text(memories(spark, d))


def compact_orphans(spark, d):
    return B.orphaned(facts(spark, d), memories(spark, d))


def sweep_expired(spark, d):
    return B.expired(memories(spark, d), now()).select("id", F.unix_millis("valid_until").alias("until_ms"))


def evict(spark, d):
    return B.evicted(memories(spark, d), now(), CAP)


def dream_decay(spark, d):
    return B.decayed(memories(spark, d), now())


def detect_conflicts(spark, d):
    return B.conflicts(facts(spark, d), memories(spark, d))


def supersede_query(spark, d):
    return B.mentions(memories(spark, d), "event log")


def forget(spark, d):
    return B.forgotten(memories(spark, d), facts(spark, d), "lease timer")


def delete_by_source(spark, d):
    return B.by_source(memories(spark, d), peer="scout-3", category="fact")


def purge(spark, d):
    return B.receipts(memories(spark, d).where("status = 'superseded'"), now())


def timeline(spark, d):
    t = B.timeline(memories(spark, d), facts(spark, d))
    return t.select("memory_id", "event", F.unix_millis("at").alias("at_ms"))


def diff_memories(spark, d):
    return B.differences(memories(spark, d))


def consolidate(spark, d):
    """Links used more than twice are strengthened by 0.02, up to 0.95."""
    return links(spark, d).where("n > 2").select("a", "b", F.round(F.greatest(F.col("w"), F.least(F.lit(0.95), F.col("w") + 0.02)), 6).alias("w"))


def as_of_history(spark, d):
    return B.history_at(_single(facts(spark, d)), now())


def _board(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", F.get_json_object("props", "$.k").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.round("value", 0).cast("long").alias("value"), "event_type")


def blackboard_state(spark, d):
    return B.latest_state(_board(spark, d), ["user_id", "key"], ["at", "seq"]).select("user_id", "key", "version", "value", "event_type")


def blackboard_contest(spark, d):
    return B.contested(_board(spark, d), ["user_id", "key"], ["at", "seq"])


def rate(spark, d):
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    v = F.when(F.col("event_type") == "purchase", "helped").otherwise("misled")
    return B.rated(e.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), v.alias("verdict")), ["user_id"])


QUERIES = {
    f.__name__: f
    for f in (resolve_single_valued, resolve_multi_valued, resolve_antonym, upsert_actions, dedup_fingerprint, dedup_semantic, compact_orphans, sweep_expired, evict, dream_decay, detect_conflicts,
              supersede_query, forget, delete_by_source, purge, timeline, diff_memories, consolidate, as_of_history, blackboard_state, blackboard_contest, rate)
}

_M, _F, _MF = f"WITH {MEMORIES_SQL} ", f"WITH {FACTS_SQL}, ", f"WITH {MEMORIES_SQL}, {FACTS_SQL}, "
_K = "k AS (SELECT *, lower(subject) AS ks, lower(object) AS ko FROM t WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL AND created_at IS NOT NULL)"
_MULTI = _in(W.MULTI_VALUED)
_PAIR = "CASE " + " ".join(f"WHEN predicate = '{a}' THEN '{min(a, b)}'" for a, b in W.OPPOSITES.items()) + " END"
_RESOLVE = "SELECT id, lead(memory_id) OVER w AS superseded_by, lead(created_at) OVER w AS valid_until, lead(id) OVER w IS NULL AS active FROM k WHERE {} WINDOW w AS (PARTITION BY {} ORDER BY created_at, id)"
_BOARD = "b AS (SELECT user_id, json_extract_string(props, '$.k') AS key, ts, event_id, CAST(round(value, 0) AS BIGINT) AS value, event_type FROM events)"

ORACLE = {
    "resolve_single_valued": _F + _K + " " + _RESOLVE.format(f"predicate NOT IN {_MULTI}", "ks, predicate"),
    "resolve_multi_valued": _F + _K + " " + _RESOLVE.format(f"predicate IN {_MULTI}", "ks, predicate, ko"),
    "resolve_antonym": _F + _K + f", p AS (SELECT *, {_PAIR} AS pair FROM k), x AS (SELECT id, ks, pair, ko, predicate, lead(predicate) OVER w AS np, lead(memory_id) OVER w AS superseded_by FROM p WHERE pair IS NOT NULL WINDOW w AS (PARTITION BY ks, pair, ko ORDER BY created_at, id)) SELECT id, superseded_by, count(*) OVER (PARTITION BY ks, pair, ko) AS contradictions FROM x WHERE np != predicate",
    "upsert_actions": _F + _K + f", x AS (SELECT id, ko, lag(ko) OVER (PARTITION BY ks, predicate ORDER BY created_at, id) AS prev FROM k), y AS (SELECT id, predicate, lag(predicate) OVER (PARTITION BY ks, {_PAIR}, ko ORDER BY created_at, id) AS pp FROM k WHERE {_PAIR} IS NOT NULL) SELECT x.id, CASE WHEN pp != predicate THEN 'superseded' WHEN prev IS NULL THEN 'inserted' WHEN prev = ko THEN 'reinforced' ELSE 'updated' END AS action FROM x LEFT JOIN y USING (id)",
    "dedup_fingerprint": _M + f""", a AS (SELECT *, sha256({_NORM}) AS fp FROM m WHERE is_active AND content IS NOT NULL),
g AS (SELECT fp, is_negative_constraint AS neg, peer, arg_min(id, (created_at, id)) AS id, count(*) AS n, arg_min(coalesce(confidence, -1), (created_at, id)) AS c FROM a GROUP BY ALL),
x AS (SELECT fp, is_negative_constraint AS neg, peer, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT fp, is_negative_constraint, peer, unnest(tags) AS tag FROM a) GROUP BY ALL)
SELECT g.id, g.n, round(least(1.0, c + 0.05 * (n - 1)), 6) AS confidence, coalesce(tags, '') AS tags FROM g LEFT JOIN x ON g.fp = x.fp AND g.neg IS NOT DISTINCT FROM x.neg AND g.peer IS NOT DISTINCT FROM x.peer""",
    "dedup_semantic": _M + ", g AS (SELECT category, is_negative_constraint, lower(trim(content)) AS t, arg_min(id, (created_at, id)) AS kept, count(*) - 1 AS copies FROM m WHERE is_active AND content IS NOT NULL GROUP BY ALL) SELECT kept, copies FROM g WHERE copies > 0",
    "compact_orphans": _MF + "x AS (SELECT t.id, m.is_active AS alive FROM t LEFT JOIN m ON m.id = t.memory_id WHERE t.is_active AND t.memory_id IS NOT NULL) SELECT id, CASE WHEN alive IS NULL THEN 'missing' ELSE 'inactive' END AS reason FROM x WHERE alive IS NULL OR NOT alive",
    "sweep_expired": _M + f"SELECT id, epoch_ms(valid_until) AS until_ms FROM m WHERE is_active AND valid_until < {AS_OF_SQL}",
    "evict": _M + f""", a AS (SELECT * FROM m WHERE is_active),
r AS (SELECT id, created_at, round(coalesce(confidence, 1.0) * CASE importance WHEN 'critical' THEN 10.0 WHEN 'high' THEN 3.0 WHEN 'low' THEN 0.5 ELSE 1.0 END::DOUBLE * (access_count + 1)
  / (1 + greatest(floor((epoch_us({AS_OF_SQL}) - epoch_us(created_at)) / 86400000000), 0)), 8) AS retention FROM a WHERE NOT is_negative_constraint),
n AS (SELECT *, row_number() OVER (ORDER BY retention, created_at, id) AS rn FROM r)
SELECT id, retention FROM n WHERE rn <= (SELECT count(*) FROM a) - {CAP}""",
    "dream_decay": _M + f"SELECT id FROM m WHERE is_active AND NOT is_negative_constraint AND importance = 'low' AND access_count <= 1 AND created_at < {AS_OF_SQL} - INTERVAL 14 DAYS",
    "detect_conflicts": _MF + _K + f""", r AS (SELECT k.*, {_PAIR} AS pair FROM k JOIN m ON m.id = k.memory_id AND m.is_active WHERE k.is_active)
SELECT id, 'contradiction' AS kind, 1.0::DOUBLE AS score FROM r x WHERE pair IS NOT NULL AND EXISTS (SELECT 1 FROM r y WHERE y.ks = x.ks AND y.ko = x.ko AND y.pair = x.pair AND y.predicate != x.predicate)
UNION ALL SELECT id, CASE WHEN predicate IN {_MULTI} THEN 'multi_value_coexist' ELSE 'single_value_replacement' END, 0.9::DOUBLE FROM r x WHERE EXISTS (SELECT 1 FROM r y WHERE y.ks = x.ks AND y.predicate = x.predicate AND y.ko != x.ko)""",
    "supersede_query": _M + "SELECT id FROM m WHERE is_active AND contains(lower(content), 'event log')",
    "forget": _MF + "h AS (SELECT id FROM m WHERE is_active AND regexp_matches(lower(content), '\\blease timer\\b')) SELECT 'memory' AS kind, id FROM h UNION ALL SELECT 'triple', t.id FROM t JOIN h ON h.id = t.memory_id WHERE t.is_active",
    "delete_by_source": _M + "SELECT id FROM m WHERE is_active AND peer = 'scout-3' AND category = 'fact'",
    "purge": _M + f"SELECT id, sha256(concat_ws('|', id, substr(content, 1, 30), epoch_ms(created_at), epoch_ms({AS_OF_SQL}))) AS receipt FROM m WHERE status = 'superseded'",
    "timeline": _MF + """x AS (SELECT id AS memory_id, 'CREATED' AS event, created_at AS ts FROM m UNION ALL SELECT id, 'MUTATED', updated_at FROM m WHERE updated_at > created_at
  UNION ALL SELECT id, 'SUPERSEDED', updated_at FROM m WHERE superseded_by_id IS NOT NULL UNION ALL SELECT memory_id, 'ASSERTED', created_at FROM t WHERE memory_id IS NOT NULL)
SELECT memory_id, event, epoch_ms(ts) AS at_ms FROM x WHERE ts IS NOT NULL""",
    "consolidate": f"WITH {LINKS_SQL} SELECT a, b, round(greatest(w, least(0.95, w + 0.02)), 6) AS w FROM l WHERE n > 2",
    "as_of_history": _F + _K + f" SELECT ks, predicate, arg_max(object, (created_at, id)) AS object FROM k WHERE predicate NOT IN {_MULTI} AND created_at <= {AS_OF_SQL} GROUP BY ALL",
    "blackboard_state": f"WITH {_BOARD} SELECT user_id, key, count(*) AS version, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM b GROUP BY ALL",
    "blackboard_contest": f"WITH {_BOARD}, x AS (SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY user_id, key ORDER BY ts, event_id)) SELECT user_id, key, count(*) FILTER (n > 1 AND prev IS DISTINCT FROM value) AS disputes, count(*) AS claims FROM x GROUP BY ALL",
    "rate": "SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN event_type = 'purchase' THEN 0.05 ELSE -0.15 END::DOUBLE ORDER BY ts, event_id)), lambda x, a: least(1.0, greatest(0.05, x + a))), 6) AS confidence FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id",
}
