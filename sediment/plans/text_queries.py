"""Text and scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators.workspace import fitted
from sediment.plans.common import AS_OF_SQL, FACTS_SQL, MEMORIES_SQL, facts, memories, now
from sediment.sources import table


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _ci(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '(?i){_sq(pattern)}')"


def _in(words) -> str:
    return "(" + ", ".join(f"'{_sq(w)}'" for w in words) + ")"


_NORM = "trim(regexp_replace(regexp_replace(lower(content), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def fingerprint(spark, d):
    m = memories(spark, d)
    return m.select("id", T.normalized(F.col("content")).alias("normalized"), T.fingerprint(F.col("content")).alias("fp"))


def is_noise(spark, d):
    m = memories(spark, d)
    return m.select("id", T.is_noise(F.col("content"), F.col("category")).alias("noise"))


def is_negative(spark, d):
    m = memories(spark, d)
    neg = T.is_negative(F.col("content"), F.col("category"))
    return m.select("id", neg.alias("negative"), T.memory_type(neg, F.col("category")).alias("kind"))


def outcome_detect(spark, d):
    m = memories(spark, d)
    o = T.outcome(F.col("content"))
    return m.select("id", o.alias("detected"), F.when(o == "failure", F.col("content")).alias("reason"))


def redact(spark, d):
    """Notes are prefixed with a made-up assignment and token, so that every kind of replacement is met."""
    n = table(spark, d, "notes").where("content is not null")
    dirty = F.concat(F.lit("API_KEY=abc123def "), F.col("content"), F.lit(" Bearer abcdef.ghijkl-123456 sk-abcdefghijklmnop1234"))
    text, count = T.redact_secrets(dirty)
    return n.select("id", text.alias("clean"), count.alias("n_redacted")).distinct()


def canonicalize_entity(spark, d):
    """Objects as stored and with sizes of several spellings behind them."""
    sizes = F.array(*[F.lit(x) for x in ("", " with 16384 MB of RAM;", " 512 Kb..", "  2 TB ,", " 1500mb", " 8 GB disk")])
    t = facts(spark, d).where("object is not null").select("id", F.concat("object", F.element_at(sizes, (F.col("id") % 6 + 1).cast("int"))).alias("object"))
    return t.select("id", T.canonical_units(F.col("object")).alias("canonical"))


def tokenize(spark, d):
    m = memories(spark, d)
    return m.select("id", F.explode(T.tokenize(F.col("content"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def hash_fnv1a(spark, d):
    s = facts(spark, d).where("subject is not null").select("subject").distinct()
    return s.select("subject", T.fnv1a(F.col("subject"), 0x1337).alias("h"))


def recency_score(spark, d):
    m = memories(spark, d).where("last_accessed_at is not null")
    return m.select("id", F.round(T.recency(F.col("last_accessed_at"), F.col("category"), now()), 6).alias("recency"))


def estimate_tokens(spark, d):
    m = memories(spark, d).where("content is not null")
    return m.select("id", T.estimate_tokens(F.col("content")).alias("tokens"))


def informative_entity(spark, d):
    t = facts(spark, d)
    e = t.select(F.lower("subject").alias("entity")).union(t.select(F.lower("object"))).where("entity is not null").distinct()
    return e.select("entity", T.informative(F.col("entity")).alias("informative"))


def score_candidate(spark, d):
    n = table(spark, d, "notes").where("content is not null").select("id", "content").distinct()
    conf, kind = T.candidate(F.col("content"), F.size(T.triples(F.col("content"))) > 0)
    return n.select("id", conf.alias("confidence"), kind.alias("kind"))


def stage_candidates(spark, d):
    """Statements by their score: dropped noise aside, promoted at 0.8 if they forbid something, else pending from 0.5."""
    n = table(spark, d, "notes").where("content is not null").select("id", "content").distinct()
    conf, kind = T.candidate(F.col("content"), F.size(T.triples(F.col("content"))) > 0)
    noise = T.is_noise(F.col("content"), F.lit(None).cast("string")) & ~T.matches(F.col("content"), W.GUARD)
    s = n.where(~noise).select("id", conf.alias("confidence"), kind.alias("kind")).where("confidence >= 0.5")
    return s.withColumn("status", F.when((F.col("confidence") >= 0.8) & F.col("kind").isin("negative_constraint", "rule", "hardware"), "promoted").otherwise("pending"))


def route_intent(spark, d):
    n = table(spark, d, "notes").where("content is not null").select("id", "content").distinct()
    return n.select("id", T.intent(F.col("content")).alias("r")).select("id", "r.intent", "r.confidence", "r.tool")


def extract_triples(spark, d):
    m = memories(spark, d)
    return m.select("id", F.explode(T.triples(F.col("content"))).alias("t")).select("id", "t.*").distinct()


def git_classify(spark, d):
    m = memories(spark, d).where("content is not null")
    return m.select("id", T.commit_class(F.col("content")).alias("c")).select("id", "c.*")


def slugify(spark, d):
    m = memories(spark, d).where("content is not null")
    return m.select("id", T.slug(F.col("content")).alias("slug"))


#: Around a name: no ASCII word character before or after it.
BEFORE, AFTER = "(?iu)(?<![A-Za-z0-9_])(?:", ")(?![A-Za-z0-9_])"


def resolve_aliases(spark, d):
    """Names in contents, bounded by the ends or by ASCII characters that are no word's and regardless of case:
    who is named, and the text with every name replaced. Longer names go first, equal ones to all who bear them and
    in the text to the smallest id. The alias table is bounded (the fixed table of personas)."""
    p = table(spark, d, "personas").where("trim(name) != ''").groupBy(F.lower(F.trim("name")).alias("alias")).agg(F.min("id").alias("id"), F.collect_set(F.concat(F.lit("person-"), "id")).alias("people"))
    names = sorted((r.alias for r in p.select("alias").collect()), key=lambda x: (-len(x), x))
    m = memories(spark, d).where("content is not null").select("id", "content")
    found = F.regexp_extract_all("content", F.lit(BEFORE + ("|".join(map(_literal, names)) or r"\b\B") + AFTER), 0)
    hit = m.select("id", "content", found.alias("found")).where("size(found) > 0")
    each = hit.select("id", "content", F.explode(F.array_distinct(F.transform("found", F.lower))).alias("alias")).join(F.broadcast(p.withColumnRenamed("id", "first")), "alias")
    g = each.groupBy("id", "content").agg(F.flatten(F.collect_list("people")).alias("people"), F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("n"), "alias", "first"))).alias("names"))
    # special characters are escaped as _literal does
    pattern = lambda x: F.concat(F.lit(BEFORE), F.regexp_replace(x["alias"], r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(AFTER))
    text = F.aggregate("names", F.col("content"), lambda t, x: F.regexp_replace(t, pattern(x), F.concat(F.lit("person-"), x["first"].cast("string"))))
    return g.select("id", F.array_join(F.sort_array(F.array_distinct("people")), ",").alias("people"), text.alias("text"))


def _literal(s: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in s)


def usage_multiplier(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("helped"), F.count(F.when(F.col("event_type") == "error", 1)).alias("misled")
    )
    return e.select("user_id", F.round(T.usage_multiplier(F.col("helped"), F.col("misled")), 6).alias("multiplier"))


def block_truncate(spark, d):
    """Context blocks cut at four characters per token."""
    b = table(spark, d, "context_blocks")
    return b.select("name", fitted(F.col("content"), F.col("token_limit")).alias("content"), T.block_name_ok(F.col("name")).alias("name_ok"))


QUERIES = {
    f.__name__: f
    for f in (fingerprint, is_noise, is_negative, outcome_detect, redact, canonicalize_entity, tokenize, hash_fnv1a, recency_score, estimate_tokens, informative_entity, score_candidate,
              stage_candidates, route_intent, extract_triples, git_classify, slugify, resolve_aliases, usage_multiplier, block_truncate)
}

_NEG = f"(coalesce(category = 'negative_constraint', false) OR {_ci('content', W.NEGATIVE)})"
_REDACT = "'API_KEY=abc123def ' || content || ' Bearer abcdef.ghijkl-123456 sk-abcdefghijklmnop1234'"
_red_n = []
for _k, _p in W.SECRETS:
    _p = _p.replace('{0,4000}?', '*?')
    _red_n.append(f"len(regexp_extract_all({_REDACT}, '{_sq(_p)}'))")
    _REDACT = f"regexp_replace({_REDACT}, '{_sq(_p)}', '" + ("\\1=" if _k == "env_secret" else "") + f"[REDACTED:{_k}]', 'g')"
_HAS = f"""(regexp_matches(c, '(?i)ram\\s+\\d+gb|jangan\\s+(pernah\\s+)?build|dilarang|never\\s+run') OR regexp_matches(c, '(?i)([A-Za-z0-9_\\-]+)\\s+(?:alias|aka|known as|disebut juga|is alias of)\\s+([A-Za-z0-9_\\-]+)')
  OR regexp_matches(c, '([A-Za-z0-9_\\-]+)\\s*\\(([A-Za-z0-9_\\-]+)\\)')
  OR len(list_filter(cl, lambda x: regexp_matches(x, '(?i)([A-Za-z0-9_\\-.\\s]+?)\\s+(?:berjalan di|listens on|running on|menggunakan port|port)\\s+(?:port\\s+)?(\\d{{2,5}})'))) > 0
  OR len(list_filter(cl, lambda x: regexp_matches(x, '(?i)([A-Za-z0-9_\\-.\\s]+?)\\s+({_sq(W.VERBS)})\\s+(.+)') AND trim(regexp_extract(x, '(?i)([A-Za-z0-9_\\-.\\s]+?)\\s+({_sq(W.VERBS)})\\s+(.+)', 1)) != '')) > 0)"""
_CLAUSES = "list_filter(list_transform(regexp_split_to_array(c, '(?i)\\s*[;!?]\\s+|\\s*\\.\\s+|\\s+(?:and|dan|serta)\\s+'), lambda x: regexp_replace(trim(x), '[.,;]$', '')), lambda x: x != '')"
_CAND = f"""
n AS (SELECT DISTINCT id, content, trim(content) AS c FROM notes WHERE content IS NOT NULL),
k AS (SELECT *, {_CLAUSES} AS cl FROM n),
h AS (SELECT *, {_HAS} AS has FROM k),
s AS (SELECT id, content, least(0.95, round(0.45 + CASE WHEN has THEN 0.2 ELSE 0 END + CASE WHEN {_ci('c', W.IMPERATIVE)} THEN 0.15 ELSE 0 END
  + CASE WHEN {_ci('c', W.GUARD)} THEN 0.3 ELSE 0 END + CASE WHEN length(c) BETWEEN 30 AND 250 THEN 0.05 ELSE 0 END, 2))::DOUBLE AS confidence,
  CASE WHEN {_ci('c', W.GUARD)} THEN 'negative_constraint' WHEN {_ci('c', W.PREFERENCE)} THEN 'preference' WHEN has THEN 'architecture' ELSE 'fact' END AS kind FROM h)"""
_NOISE = f"({_ci('lower(trim(content))', W.NOISE_START)} OR {_ci('lower(content)', W.NOISE_WORDS)})"
_WITH = f"WITH {MEMORIES_SQL} "
_PRED = "CASE " + " ".join(f"WHEN p IN {_in(s)} THEN '{k}'" for k, s in W.CANONICAL_PREDICATES.items()) + " ELSE p END"
_VERB = f"(?i)([A-Za-z0-9_\\-.\\s]+?)\\s+({_sq(W.VERBS)})\\s+(.+)"
_PORT = "(?i)([A-Za-z0-9_\\-.\\s]+?)\\s+(?:berjalan di|listens on|running on|menggunakan port|port)\\s+(?:port\\s+)?(\\d{2,5})"
_ALIAS = "(?i)([A-Za-z0-9_\\-]+)\\s+(?:alias|aka|known as|disebut juga|is alias of)\\s+([A-Za-z0-9_\\-]+)"
_PAREN = "([A-Za-z0-9_\\-]+)\\s*\\(([A-Za-z0-9_\\-]+)\\)"

#: tr: the triples of the texts k (id, c).
_TRIPLES = f"""x AS (SELECT id, unnest({_CLAUSES}) AS x FROM k),
v AS (SELECT id, regexp_extract(x, '{_VERB}', 1) AS s, regexp_replace(upper(trim(regexp_extract(x, '{_VERB}', 2))), '\\s+', '_', 'g') AS p, regexp_replace(trim(regexp_extract(x, '{_VERB}', 3)), '[.,;]$', '') AS o FROM x WHERE regexp_matches(x, '{_VERB}')),
r AS (
  SELECT id, regexp_extract(x, '{_PORT}', 1) AS subject, 'LISTENS_ON_PORT' AS predicate, regexp_extract(x, '{_PORT}', 2) AS object FROM x WHERE regexp_matches(x, '{_PORT}')
  UNION ALL SELECT id, s, {_PRED}, o FROM v
  UNION ALL SELECT id, 'SafetyGuardrail', 'FORBIDS', substr(c, 1, 100) FROM k WHERE regexp_matches(c, '(?i)ram\\s+\\d+gb|jangan\\s+(pernah\\s+)?build|dilarang|never\\s+run')
  UNION ALL SELECT id, lower(regexp_extract(c, '{_ALIAS}', 1)), 'ALIAS_OF', regexp_extract(c, '{_ALIAS}', 2) FROM k WHERE regexp_matches(c, '{_ALIAS}')
  UNION ALL SELECT id, lower(regexp_extract(c, '{_PAREN}', 2)), 'ALIAS_OF', regexp_extract(c, '{_PAREN}', 1) FROM k WHERE regexp_matches(c, '{_PAREN}') AND NOT regexp_matches(c, '{_ALIAS}')),
tr AS (SELECT DISTINCT id, trim(subject) AS subject, predicate, trim(object) AS object FROM r WHERE trim(subject) != '' AND trim(object) != '')"""

ORACLE = {
    "fingerprint": _WITH + f"SELECT id, {_NORM} AS normalized, substr(sha256({_NORM}), 1, 16) AS fp FROM m",
    "is_noise": _WITH + f"SELECT id, coalesce(category IN {_in(W.NOISE_CATEGORIES)}, false) OR {_NOISE} AS noise FROM m",
    "is_negative": _WITH + f"SELECT id, {_NEG} AS negative, CASE WHEN {_NEG} OR category IN ('rule', 'negative_constraint') THEN 'imperative' ELSE 'declarative' END AS kind FROM m",
    "outcome_detect": _WITH + f"SELECT id, CASE WHEN {_ci('content', W.FAILURE)} THEN 'failure' ELSE 'neutral' END AS detected, CASE WHEN {_ci('content', W.FAILURE)} THEN content END AS reason FROM m",
    "redact": f"SELECT DISTINCT id, {_REDACT} AS clean, {' + '.join(_red_n)} AS n_redacted FROM notes WHERE content IS NOT NULL",
    "canonicalize_entity": f"WITH {FACTS_SQL}, " + """o AS (SELECT id, object || ['', ' with 16384 MB of RAM;', ' 512 Kb..', '  2 TB ,', ' 1500mb', ' 8 GB disk'][id % 6 + 1] AS o FROM t WHERE object IS NOT NULL),
c AS (SELECT id, regexp_replace(regexp_replace(trim(o), '[.,;:]+$', ''), '\\s+', ' ', 'g') AS c FROM o),
u AS (SELECT id, list_reduce(list_concat([c], ['tb', 'gb', 'mb', 'kb']), lambda t, x: regexp_replace(t, '(\\d+(?:\\.\\d+)?)\\s*' || x || '\\b', '\\1' || x, 'gi')) AS c FROM c),
n AS (SELECT id, c, TRY_CAST(regexp_extract(c, '(\\d{4,9})mb', 1) AS BIGINT) AS mb FROM u)
SELECT id, CASE WHEN mb >= 1024 AND mb % 1024 = 0 THEN regexp_replace(c, '\\d{4,9}mb', (mb // 1024) || 'gb', 'g') ELSE c END AS canonical FROM n""",
    "tokenize": _WITH + """, r AS (SELECT unnest(list_filter(regexp_split_to_array(lower(content), '[\\s,.;:!?/\\\\()\\[\\]{}''"]+'), lambda x: x != '')) AS token FROM m),
p AS (SELECT token FROM r UNION ALL SELECT unnest(list_filter(regexp_split_to_array(token, '[-_]+'), lambda x: length(x) > 1)) FROM r WHERE regexp_matches(token, '[-_]'))
SELECT token, count(*) AS n FROM p GROUP BY token""",
    "hash_fnv1a": f"WITH {FACTS_SQL}, " + """s AS (SELECT DISTINCT subject FROM t WHERE subject IS NOT NULL)
SELECT subject, list_reduce(list_prepend(2166136261::BIGINT # 4919, list_transform(string_split(subject, ''), lambda c: ascii(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS h FROM s""".replace("2166136261::BIGINT # 4919", "xor(2166136261::BIGINT, 4919::BIGINT)"),
    "recency_score": _WITH + "SELECT id, round(exp(-ln(2) / CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.HALF_LIFE.items())
    + f" ELSE {W.DEFAULT_HALF_LIFE} END * greatest(0.0, (epoch_us({AS_OF_SQL}) - epoch_us(last_accessed_at)) / 86400000000.0)), 6) AS recency FROM m WHERE last_accessed_at IS NOT NULL",
    "estimate_tokens": _WITH + "SELECT id, greatest(1, CAST(ceil(length(content) / 3.8) AS BIGINT)) AS tokens FROM m WHERE content IS NOT NULL",
    "informative_entity": f"WITH {FACTS_SQL} SELECT entity, length(trim(entity)) > 2 AND trim(entity) NOT IN {_in(W.STOPWORDS + W.GENERIC)} AS informative FROM (SELECT lower(subject) AS entity FROM t UNION SELECT lower(object) FROM t) WHERE entity IS NOT NULL",
    "score_candidate": f"WITH {_CAND} SELECT id, confidence, kind FROM s",
    "stage_candidates": f"WITH {_CAND} SELECT id, confidence, kind, CASE WHEN confidence >= 0.8 AND kind IN ('negative_constraint', 'rule', 'hardware') THEN 'promoted' ELSE 'pending' END AS status FROM s WHERE confidence >= 0.5 AND NOT ({_NOISE} AND NOT {_ci('content', W.GUARD)})",
    "route_intent": "SELECT id, " + ", ".join(
        "CASE " + " ".join(f"WHEN {_ci('lower(trim(content))', r[3])} THEN {v(r)}" for r in W.INTENTS) + f" ELSE {v(W.DEFAULT_INTENT)} END AS {n}"
        for n, v in (("intent", lambda r: f"'{r[0]}'"), ("confidence", lambda r: f"{r[1]}::DOUBLE"), ("tool", lambda r: f"'{r[2]}'"))
    ) + " FROM (SELECT DISTINCT id, content FROM notes WHERE content IS NOT NULL)",
    "extract_triples": _WITH + f", k AS (SELECT id, trim(content) AS c FROM m WHERE content IS NOT NULL), {_TRIPLES} SELECT * FROM tr",
    "git_classify": _WITH + ", c AS (SELECT id, lower(content) AS s FROM m WHERE content IS NOT NULL), k AS (SELECT id, CASE WHEN starts_with(s, 'fix') OR contains(s, 'bugfix') OR contains(s, 'hotfix') THEN 1 WHEN starts_with(s, 'perf') OR contains(s, 'optimize') THEN 2 WHEN starts_with(s, 'refactor') OR starts_with(s, 'arch') THEN 3 WHEN contains(s, 'forbid') OR contains(s, 'prevent') OR contains(s, 'never') THEN 4 ELSE 5 END AS k FROM c)"
    " SELECT id, ['episodic', 'rule', 'architecture', 'negative_constraint', 'fact'][k] AS category, ['high', 'high', 'normal', 'critical', 'normal'][k] AS importance, ['success', 'neutral', 'neutral', 'neutral', 'neutral'][k] AS outcome FROM k",
    "slugify": _WITH + ", s AS (SELECT id, regexp_replace(substr(regexp_replace(trim(regexp_replace(lower(content), '[^A-Za-z0-9_\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 32), '-+$', '') AS s FROM m WHERE content IS NOT NULL) SELECT id, CASE WHEN s = '' THEN 'memory' ELSE s END AS slug FROM s",
    # names are looked for one after the other, the longest first, each twice, as neighbours share the character between them
    "resolve_aliases": _WITH + """, a AS (SELECT lower(trim(name)) AS alias, min(id) AS first, list('person-' || id) AS people FROM personas WHERE trim(name) != '' GROUP BY 1),
l AS (SELECT list(alias || chr(1) || first ORDER BY length(alias) DESC, alias) AS xs FROM a),
r AS (SELECT id, content, list_reduce(list_concat([content], xs, xs), lambda t, x: regexp_replace(t, '(^|[^A-Za-z0-9_])' || regexp_escape(string_split(x, chr(1))[1]) || '([^A-Za-z0-9_]|$)', '\\1' || chr(2) || string_split(x, chr(1))[2] || chr(3) || '\\2', 'gi')) AS t FROM m, l WHERE content IS NOT NULL),
h AS (SELECT id, t, unnest(list_distinct(regexp_extract_all(t, chr(2) || '(\\d+)' || chr(3), 1))) AS first FROM r)
SELECT h.id, array_to_string(list_sort(list_distinct(flatten(list(a.people)))), ',') AS people, replace(replace(any_value(h.t), chr(2), 'person-'), chr(3), '') AS text FROM h JOIN a ON a.first = h.first::BIGINT GROUP BY h.id""",
    "usage_multiplier": "SELECT user_id, round(least(1.5, greatest(0.35, 1.0 + 0.05 * count(*) FILTER (event_type = 'purchase') - 0.2 * count(*) FILTER (event_type = 'error'))), 6)::DOUBLE AS multiplier FROM events GROUP BY user_id",
    "block_truncate": "SELECT name, CASE WHEN length(trim(content)) > token_limit * 4 THEN substr(trim(content), 1, token_limit * 4) || chr(10) || '... [truncated to fit block token budget]' ELSE coalesce(trim(content), '') END AS content, regexp_matches(trim(name), '^[-A-Za-z0-9_.]{1,64}$') AND trim(name) NOT IN ('__proto__', 'constructor', 'prototype') AND NOT contains(name, '..') AS name_ok FROM context_blocks",
}
