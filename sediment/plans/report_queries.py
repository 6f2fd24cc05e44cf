"""Reports, sessions, feedback, packs and batch jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators import beliefs as B
from sediment.operators import reports as P
from sediment.operators.leaders import leader_clusters
from sediment.plans.common import AS_OF_SQL, FACTS_SQL, LINKS_SQL, MEMORIES_SQL, facts, links, memories, now
from sediment.plans.text_queries import _ALIAS, _NORM, _PAREN, _TRIPLES, _ci
from sediment.sources import table
from sediment.runtime import checkpoint_dir
from sediment.streaming import activity, read_table, run_available


#: Smallest memory id of the tables.
FIRST = 1_000_000


def digest(spark, d):
    return P.digest(B.timeline(memories(spark, d), facts(spark, d)), now() - F.expr("interval 30 days"))


def doctor_audit(spark, d):
    m, f = memories(spark, d), facts(spark, d)
    return P.audit(f, m, B.orphaned(f, m), now())


def doctor_repair(spark, d):
    """Rows a repair would touch: orphaned triples and links with an end that does not exist."""
    m, f = memories(spark, d), facts(spark, d)
    ids = m.select("id")
    ends = links(spark, d)
    bad = ends.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b").union(ends.join(ids.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")).distinct()
    return B.orphaned(f, m).select(F.lit("triple").alias("kind"), F.col("id").cast("string").alias("key")).union(bad.select(F.lit("link"), F.concat_ws("|", "a", "b")))


def standing_card(spark, d):
    return P.standing_card(facts(spark, d), memories(spark, d))


def primer(spark, d):
    return P.primer(memories(spark, d))


def active_rules(spark, d):
    return P.active_rules(memories(spark, d))


def stats(spark, d):
    m, n = memories(spark, d), table(spark, d, "notes")
    a = m.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("is_active") & (F.col("memory_type") == "declarative"), 1)).alias("facts"), F.count(F.when(F.col("status") == "superseded", 1)).alias("superseded"))
    return a.crossJoin(n.agg(F.countDistinct("id").alias("notes")))  # one row each


def reflect(spark, d):
    """Memories on a topic, split into directives and patterns."""
    m = memories(spark, d).where(F.col("is_active") & F.lower("content").contains("rate limiter"))
    kind = F.when(F.col("is_negative_constraint") | (F.col("category") == "rule"), "directive").otherwise("pattern")
    return m.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def graph_view(spark, d):
    return links(spark, d).orderBy(F.desc("w"), F.desc("n"), "a", "b").limit(50).select("a", "b", "w", "n")


def session_summary(spark, d):
    return P.sessions(memories(spark, d), table(spark, d, "notes"))


def rollup(spark, d):
    return P.rollup(memories(spark, d))


def _log(spark, d):
    """The events as a log of what became of recalled memories: users stand for the memories from FIRST on."""
    e = table(spark, d, "events")
    verdict = F.when(F.col("event_type") == "view", "recalled").when(F.col("event_type") == "purchase", "helped").when(F.col("event_type") == "error", "misled")
    return e.select((F.col("user_id") + FIRST).alias("id"), verdict.alias("verdict"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("project"), F.unix_micros("ts").alias("at"))


def usage_agg(spark, d):
    return P.usage(_log(spark, d))


def project_hits(spark, d):
    return P.project_hits(_log(spark, d))


def promotions(spark, d):
    log = _log(spark, d)
    return P.promotions(P.project_hits(log), P.usage(log), memories(spark, d))


def find_remediation(spark, d):
    """Patterns are the distinct failure reasons, whole and by their first two words; symptoms are all notes."""
    m = memories(spark, d).where("failure_reason is not null")
    whole = F.lower(F.trim("failure_reason"))
    r = m.select(F.explode(F.array(whole, F.substring_index(whole, " ", 2))).alias("pattern")).where("length(pattern) >= 4").distinct()
    n = table(spark, d, "notes").where("content is not null").select("id", F.lower("content").alias("text")).distinct()
    return P.playbooks(n, r)


def calibrate(spark, d):
    q = table(spark, d, "personas").where("working_style is not null").groupBy(F.col("working_style").alias("text")).agg(F.min("id").alias("query_id"))
    m = memories(spark, d).where("content is not null").select("id", F.col("content").alias("goal"))
    return P.calibrated(q, m)


def staleness(spark, d):
    """Documents anchor their first version by digest; the snapshot is their latest version per project."""
    t = table(spark, d, "documents").where("project is not null and text is not null")
    a = t.select(F.col("doc_id").alias("id"), F.col("project").alias("path"), F.when(F.col("doc_id") % 3 != 0, F.md5("text")).alias("digest"), F.unix_millis("created_at").alias("mtime_ms"))
    s = t.groupBy(F.col("project").alias("path")).agg(F.max_by(F.md5("text"), "doc_id").alias("now_digest"), F.unix_millis(F.max_by("created_at", "doc_id")).alias("now_ms"))
    return P.staleness(a, s)


def _pack(spark, d):
    """All active memories and triples, with the persons named in the store as aliases."""
    p = table(spark, d, "personas").where("name is not null").select(F.lower(F.trim("name")).alias("alias"), F.col("name").alias("canonical")).distinct()
    return P.pack_rows(memories(spark, d), facts(spark, d), p)


def pack_export(spark, d):
    return _pack(spark, d).drop("parent")


def pack_checksum(spark, d):
    return P.pack_checksum(_pack(spark, d))


def vault_export(spark, d):
    return P.vault_files(memories(spark, d))


def dream_delta(spark, d):
    """Notes beyond the watermark (all, as nothing was dreamt so far) that state a habit, and the triples in them."""
    n = table(spark, d, "notes").where("id > 0 and content is not null").select("id", "content").distinct()
    habit = n.where(T.matches(F.col("content"), W.HABIT))
    return habit.select("id", T.fingerprint(F.col("content")).alias("fp"), F.size(F.array_distinct(T.triples(F.col("content")))).alias("triples"))


def dream_synthesis(spark, d):
    """Topics of at least two memories without reflection so far: categories and tags that go together. A tag is
    known if a reflection bears it and names it."""
    m = memories(spark, d).where("is_active").select("id", "category", F.explode("tags").alias("tag")).distinct()
    known = memories(spark, d).where("category = 'reflection'").select("content", F.explode("tags").alias("tag")).where(F.lower("content").contains(F.lower("tag"))).select("tag").distinct()
    g = m.groupBy("category", "tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.join(known, "tag", "left_anti").select("category", "tag", "n")


def ingest(spark, d):
    """What becomes of each note: dropped as noise, stored as fact (it is an order or a rule) or kept as note only."""
    n = table(spark, d, "notes").where("content is not null").select("id", "content").distinct()
    c = F.col("content")
    route = F.when(T.is_noise(c, F.lit(None).cast("string")), "noise").when(T.matches(c, W.IMPERATIVE), "fact").otherwise("note")
    return n.select("id", route.alias("route"))


def vault_import(spark, d):
    """The exported files, those of weighty memories edited, read back against a store without preferences."""
    m = memories(spark, d)
    weighty = m.select("id", (F.col("importance") == "high").alias("weighty"))
    files = P.vault_files(m).join(weighty, "id").withColumn("doc", F.when(F.col("weighty"), F.concat("doc", F.lit(" edited"))).otherwise(F.col("doc")))
    return P.vault_changes(files, m.where("category is null or category != 'preference'"))


def _imported(spark, d):
    """The pack of a whole store read into one that holds its facts only, after its checksums were compared."""
    rows = _pack(spark, d)
    return P.imported_pack(P.verified_pack(rows, P.pack_checksum(rows)), memories(spark, d).where("category = 'fact'"))


def pack_import(spark, d):
    return _imported(spark, d)[0]


def pack_import_triples(spark, d):
    return _imported(spark, d)[1]


def session_status(spark, d):
    return P.session_status(table(spark, d, "notes"), now())


def auto_alias(spark, d):
    return P.aliases(memories(spark, d))


def leader_cluster(spark, d):
    return leader_clusters(table(spark, d, "embeddings"), "vec_id", "embedding").groupBy("leader").agg(F.count(F.lit(1)).alias("n"))


def stream_activity(spark, d):
    """Events as a stream, counted by day and type; the counts so far are written anew with each batch."""
    base = f"{checkpoint_dir(spark)}/activity-{uuid.uuid4().hex}"
    run_available(activity(read_table(spark, f"{d}/events.parquet")), "", f"{base}/state", "complete", lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/counts"))
    return spark.read.parquet(f"{base}/counts").select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (digest, doctor_audit, doctor_repair, standing_card, primer, active_rules, stats, reflect, graph_view, session_summary, rollup, usage_agg, project_hits, promotions, find_remediation, calibrate,
              staleness, pack_export, pack_checksum, vault_export, vault_import, pack_import, pack_import_triples, session_status, auto_alias, leader_cluster, stream_activity, dream_delta, dream_synthesis, ingest)
}

_M, _F, _MF = f"WITH {MEMORIES_SQL} ", f"WITH {FACTS_SQL} ", f"WITH {MEMORIES_SQL}, {FACTS_SQL} "
_SEN = "CASE importance WHEN 'critical' THEN 2 WHEN 'high' THEN 1 ELSE 0 END"
_ORPHANS = "x AS (SELECT t.id, m.is_active AS alive FROM t LEFT JOIN m ON m.id = t.memory_id WHERE t.is_active AND t.memory_id IS NOT NULL), o AS (SELECT id FROM x WHERE alive IS NULL OR NOT alive)"
_LOG = "g AS (SELECT user_id + 1000000 AS id, CASE event_type WHEN 'view' THEN 'recalled' WHEN 'purchase' THEN 'helped' WHEN 'error' THEN 'misled' END AS verdict, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS project, epoch_us(ts) AS at_ms FROM events)"
_USAGE = "SELECT id, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("recalled", "helped", "misled")) + " FROM g GROUP BY id"
_KIND = "CASE " + " ".join(f"WHEN {_ci('content', p)} THEN '{k}'" for k, p in P.LEDGER) + " ELSE 'general' END"


ORACLE = {
    "digest": _MF + f""", x AS (SELECT 'CREATED' AS event, created_at AS ts FROM m UNION ALL SELECT 'MUTATED', updated_at FROM m WHERE updated_at > created_at
  UNION ALL SELECT 'SUPERSEDED', updated_at FROM m WHERE superseded_by_id IS NOT NULL UNION ALL SELECT 'ASSERTED', created_at FROM t WHERE memory_id IS NOT NULL)
SELECT event, count(*) AS n FROM x WHERE ts >= {AS_OF_SQL} - INTERVAL 30 DAYS GROUP BY 1""",
    "doctor_audit": f"WITH {MEMORIES_SQL}, {FACTS_SQL}, {_ORPHANS}" + f""", c AS (SELECT (SELECT count(*) FROM o) AS orphans, count(*) FILTER (is_active AND created_at < {AS_OF_SQL} - INTERVAL 30 DAYS AND access_count = 0) AS stale, count(*) FILTER (NOT is_active) AS debris FROM m)
SELECT orphans, stale, debris, greatest(0, 100 - least(25, 5 * orphans) - least(20, 2 * stale) - CASE WHEN debris > 5 THEN 5 ELSE 0 END) AS score FROM c""",
    "doctor_repair": f"WITH {MEMORIES_SQL}, {FACTS_SQL}, {LINKS_SQL}, {_ORPHANS} SELECT 'triple' AS kind, CAST(id AS VARCHAR) AS key FROM o UNION ALL SELECT 'link', a || '|' || b FROM l WHERE a NOT IN (SELECT id FROM m) OR b NOT IN (SELECT id FROM m)",
    "standing_card": _MF + f""", r AS (SELECT row_number() OVER (ORDER BY {_SEN} DESC, access_count DESC, t.created_at DESC, t.id DESC) AS rank, subject, predicate, object FROM t JOIN m ON m.id = t.memory_id
  WHERE t.is_active AND m.is_active AND memory_type = 'declarative' AND coalesce(m.confidence, 1.0) >= 0.85 AND category NOT IN ('episodic', 'session', 'task_progress')) SELECT * FROM r WHERE rank <= 15""",
    "primer": _M + f"SELECT id, {_SEN} AS seniority, access_count FROM m WHERE is_active AND is_negative_constraint ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10",
    "active_rules": _M + f"SELECT id, is_negative_constraint AS negative, {_SEN} AS seniority, epoch_ms(created_at) AS created_ms FROM m WHERE is_active AND (is_negative_constraint OR category IN ('rule', 'architecture', 'hardware'))",
    "stats": _M + "SELECT count(*) AS total, count(*) FILTER (is_active AND memory_type = 'declarative') AS facts, count(*) FILTER (status = 'superseded') AS superseded, (SELECT count(DISTINCT id) FROM notes) AS notes FROM m",
    "reflect": _M + "SELECT CASE WHEN is_negative_constraint OR category = 'rule' THEN 'directive' ELSE 'pattern' END AS kind, count(*) AS n, min(id) AS first FROM m WHERE is_active AND contains(lower(content), 'rate limiter') GROUP BY 1",
    "graph_view": f"WITH {LINKS_SQL} SELECT a, b, w, n FROM l ORDER BY w DESC, n DESC, a, b LIMIT 50",
    "session_summary": _M + """, a AS (SELECT source_session AS session, count(*) AS memories, count(*) FILTER (outcome = 'failure') AS failures FROM m WHERE source_session IS NOT NULL GROUP BY 1),
b AS (SELECT session_id AS session, count(DISTINCT id) AS notes, epoch_ms(min(timestamp)) AS first_ms, epoch_ms(max(timestamp)) AS last_ms FROM notes WHERE session_id IS NOT NULL GROUP BY 1)
SELECT coalesce(a.session, b.session) AS session, coalesce(memories, 0) AS memories, coalesce(failures, 0) AS failures, coalesce(notes, 0) AS notes, first_ms, last_ms FROM a FULL JOIN b ON a.session = b.session""",
    "rollup": _M + f", r AS (SELECT *, row_number() OVER (PARTITION BY source_session ORDER BY created_at, id) AS rn FROM m WHERE is_active AND source_session IS NOT NULL AND content IS NOT NULL) SELECT source_session AS session, {_KIND} AS kind, count(*) AS n FROM r WHERE rn <= 50 GROUP BY ALL",
    "usage_agg": f"WITH {_LOG} {_USAGE}",
    "project_hits": f"WITH {_LOG} SELECT id, project, count(*) AS hits, max(at_ms) AS last FROM g GROUP BY ALL",
    "promotions": f"WITH {MEMORIES_SQL}, {_LOG}, u AS ({_USAGE}), p AS (SELECT id, count(DISTINCT project) AS n, string_agg(DISTINCT project::VARCHAR, ',' ORDER BY project::VARCHAR) AS projects FROM g GROUP BY id) "
    "SELECT p.id, projects, n, helped FROM p JOIN u USING (id) JOIN m ON m.id = p.id WHERE n >= 3 AND m.is_active AND m.scope != 'global' ORDER BY 3 DESC, 4 DESC, 1 LIMIT 20",
    "find_remediation": _M + """, w AS (SELECT DISTINCT lower(trim(failure_reason)) AS w FROM m WHERE failure_reason IS NOT NULL),
r AS (SELECT DISTINCT pattern FROM (SELECT w AS pattern FROM w UNION ALL SELECT array_to_string(string_split(w, ' ')[1:2], ' ') FROM w) WHERE length(pattern) >= 4),
n AS (SELECT DISTINCT id, trim(lower(content)) AS text FROM notes WHERE trim(content) != '')
SELECT DISTINCT n.id, pattern FROM n JOIN r ON contains(text, pattern) OR (length(text) >= 4 AND contains(pattern, text))""",
    "calibrate": _M + """, q AS (SELECT lower(trim(working_style)) AS whole, min(id) AS query_id FROM personas WHERE working_style IS NOT NULL GROUP BY working_style),
qw AS (SELECT query_id, whole, unnest(list_distinct(list_filter(regexp_split_to_array(whole, '[^a-z0-9_./-]+'), lambda w: length(w) > 2))) AS w FROM q),
tw AS (SELECT id, lower(content) AS goal, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z0-9_./-]+'))) AS w FROM m WHERE content IS NOT NULL),
s AS (SELECT query_id, id, 2 * count(*) + CASE WHEN contains(any_value(goal), any_value(whole)) THEN 10 ELSE 0 END AS score FROM qw JOIN tw USING (w) GROUP BY query_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s) SELECT query_id, id, score FROM r WHERE rn <= 5""",
    "staleness": """WITH t AS (SELECT * FROM documents WHERE project IS NOT NULL AND text IS NOT NULL),
s AS (SELECT project, arg_max(md5(text), doc_id) AS nd, epoch_ms(arg_max(created_at, doc_id)) AS nm FROM t GROUP BY project)
SELECT doc_id AS id, CASE WHEN nm IS NULL THEN 'unlinked' WHEN doc_id % 3 != 0 AND md5(text) != nd THEN 'stale' WHEN doc_id % 3 = 0 AND abs(nm - epoch_ms(created_at)) > 2000 THEN 'stale' ELSE 'fresh' END AS status FROM t JOIN s USING (project)""",
    "vault_export": _M + """, v AS (SELECT *, regexp_replace(substr(regexp_replace(trim(regexp_replace(lower(content), '[^A-Za-z0-9_\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 28), '-+$', '') AS s FROM m WHERE is_active AND content IS NOT NULL)
SELECT id, CASE WHEN is_negative_constraint THEN 'rules' ELSE category || 's' END AS folder, CASE WHEN s = '' THEN 'memory' ELSE s END || '-' || id || '.md' AS file,
  concat_ws(chr(10), '---', 'id: "' || id || '"', 'scope: "' || scope || '"', 'category: "' || category || '"', 'importance: "' || importance || '"', 'is_negative_constraint: ' || is_negative_constraint, '---', '') || chr(10) || content AS doc FROM v""",
    "vault_import": _M + "SELECT id, CASE WHEN category = 'preference' THEN 'insert' ELSE 'update' END AS action FROM m WHERE is_active AND content IS NOT NULL AND (category = 'preference' OR importance = 'high')",
    "pack_export": f"WITH {MEMORIES_SQL}, {FACTS_SQL} SELECT 'memory' AS kind, id, to_json({{'id': id, 'content': content, 'scope': scope}})::VARCHAR AS line FROM m WHERE is_active "
    "UNION ALL SELECT 'triple', t.id, to_json({'subject': subject, 'predicate': predicate, 'object': object})::VARCHAR FROM t JOIN m ON m.id = memory_id AND m.is_active WHERE t.is_active "
    "UNION ALL SELECT DISTINCT 'alias', NULL, to_json({'alias': lower(trim(name)), 'canonical': name})::VARCHAR FROM personas WHERE name IS NOT NULL",
    "pack_checksum": f"WITH {MEMORIES_SQL}, {FACTS_SQL}, w AS (SELECT 'memory' AS kind, to_json({{'id': id, 'content': content, 'scope': scope}})::VARCHAR AS line FROM m WHERE is_active "
    "UNION ALL SELECT 'triple', to_json({'subject': subject, 'predicate': predicate, 'object': object})::VARCHAR FROM t JOIN m ON m.id = memory_id AND m.is_active WHERE t.is_active "
    "UNION ALL SELECT 'alias', line FROM (SELECT DISTINCT to_json({'alias': lower(trim(name)), 'canonical': name})::VARCHAR AS line FROM personas WHERE name IS NOT NULL)), "
    "h AS (SELECT kind, sha256(line) AS d FROM w) SELECT kind, count(*) AS n, sha256(concat_ws('|', " + ", ".join(f"sum(('0x' || substr(d, {15 * k + 1}, 12))::BIGINT)" for k in range(4)) + ")) AS checksum FROM h GROUP BY kind",
    "pack_import": _M + f""", p AS (SELECT id AS old_id, content, scope, sha256({_NORM}) AS fp FROM m WHERE is_active AND content IS NOT NULL), k AS (SELECT sha256({_NORM}) AS fp, min(id) AS known FROM m WHERE category = 'fact' AND is_active AND content IS NOT NULL GROUP BY 1),
z AS (SELECT p.*, known, min(old_id) OVER (PARTITION BY p.fp) AS first, (SELECT max(id) FROM m WHERE category = 'fact') AS above, (SELECT min(old_id) FROM p) AS low FROM p LEFT JOIN k USING (fp))
SELECT old_id, coalesce(known, above + 1 + first - low) AS id, CASE WHEN known IS NULL AND old_id = first THEN 'inserted' ELSE 'reinforced' END AS action, content, scope FROM z""",
    "pack_import_triples": f"WITH {MEMORIES_SQL}, {FACTS_SQL}" + f""", p AS (SELECT id AS old_id, sha256({_NORM}) AS fp FROM m WHERE is_active AND content IS NOT NULL), k AS (SELECT sha256({_NORM}) AS fp, min(id) AS known FROM m WHERE category = 'fact' AND is_active AND content IS NOT NULL GROUP BY 1),
z AS (SELECT old_id, coalesce(known, (SELECT max(id) FROM m WHERE category = 'fact') + 1 + min(old_id) OVER (PARTITION BY p.fp) - (SELECT min(old_id) FROM p)) AS id FROM p LEFT JOIN k USING (fp))
SELECT DISTINCT z.id AS memory_id, subject, predicate, object FROM t JOIN z ON z.old_id = t.memory_id WHERE t.is_active""",
    "session_status": f"""WITH s AS (SELECT session_id AS session, min(timestamp) AS began, max(timestamp) AS last, arg_min(coalesce(peer, chr(0)), (timestamp, id)) AS peer FROM notes WHERE session_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1),
n AS (SELECT *, lead(began) OVER (PARTITION BY peer ORDER BY began, session) AS nxt FROM s)
SELECT session, CASE WHEN peer != chr(0) AND coalesce(nxt < last, false) THEN 'abandoned' WHEN last > {AS_OF_SQL} - INTERVAL 1 DAY THEN 'active' ELSE 'ended' END AS status FROM n""",
    "auto_alias": _M + f""", a AS (SELECT id, created_at, trim(content) AS c FROM m WHERE content IS NOT NULL),
x AS (SELECT lower(regexp_extract(c, '{_ALIAS}', 1)) AS alias, regexp_extract(c, '{_ALIAS}', 2) AS o, created_at, id FROM a WHERE regexp_matches(c, '{_ALIAS}')
  UNION ALL SELECT lower(regexp_extract(c, '{_PAREN}', 2)), regexp_extract(c, '{_PAREN}', 1), created_at, id FROM a WHERE regexp_matches(c, '{_PAREN}') AND NOT regexp_matches(c, '{_ALIAS}'))
SELECT alias, arg_max(o, (created_at, id)) AS canonical FROM x GROUP BY alias""",
    "dream_delta": f"WITH n AS (SELECT DISTINCT id, content FROM notes WHERE id > 0 AND content IS NOT NULL AND {_ci('content', W.HABIT)}), z AS (SELECT *, row_number() OVER (ORDER BY id, content) AS nr FROM n), k AS (SELECT nr AS id, trim(content) AS c FROM z), {_TRIPLES}, "
    f"q AS (SELECT id AS nr, count(*) AS c FROM tr GROUP BY 1) SELECT z.id, substr(sha256({_NORM}), 1, 16) AS fp, coalesce(q.c, 0)::INT AS triples FROM z LEFT JOIN q USING (nr)",
    "dream_synthesis": _M + """, e AS (SELECT DISTINCT id, category, unnest(tags) AS tag FROM m WHERE is_active),
k AS (SELECT tag FROM (SELECT content, unnest(tags) AS tag FROM m WHERE category = 'reflection') WHERE contains(lower(content), lower(tag)))
SELECT category, tag, count(*) AS n FROM e WHERE tag NOT IN (SELECT tag FROM k) GROUP BY ALL HAVING count(*) >= 2""",
    "stream_activity": "SELECT epoch_ms(date_trunc('day', ts)::TIMESTAMP) AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL",
    "ingest": f"SELECT DISTINCT id, CASE WHEN {_ci('lower(trim(content))', W.NOISE_START)} OR {_ci('lower(content)', W.NOISE_WORDS)} THEN 'noise' WHEN {_ci('content', W.IMPERATIVE)} THEN 'fact' ELSE 'note' END AS route FROM notes WHERE content IS NOT NULL",
}
