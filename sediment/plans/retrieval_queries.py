"""Retrieval, vectors and graph expansion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators import graph as G
from sediment.operators import retrieval as R
from sediment.plans.common import AS_OF_SQL, FACTS_SQL, LINKS_SQL, MEMORIES_SQL, facts, links, memories, now
from sediment.plans.text_queries import _in
from sediment.runtime import materialize
from sediment.sources import table


def _queries(spark, d):
    """The query batch: the working styles in the fixed table of personas."""
    p = table(spark, d, "personas").where("working_style is not null")
    return p.groupBy(F.col("working_style").alias("text")).agg(F.min("id").alias("query_id"))


def _lexical(spark, d, top=50):
    m = memories(spark, d)
    text = F.concat_ws(" ", "content", "category", F.array_join("tags", " "))
    return R.bm25(materialize(R.postings(m, "id", text)), _queries(spark, d), top)  # read three times


def bm25_search(spark, d):
    return _lexical(spark, d)


def validity_filter(spark, d):
    return R.valid(memories(spark, d), now(), "project").select("id")


def hybrid_score(spark, d):
    return R.hybrid(R.valid(memories(spark, d), now()), _lexical(spark, d), now())


def recall_topk(spark, d):
    return R.recall(hybrid_score(spark, d))


def context_pack(spark, d):
    """The best twenty memories of each query packed into 120 tokens, prohibitions first."""
    m = memories(spark, d)
    top = R.recall(hybrid_score(spark, d), 20, 0.0).drop("rank").join(m.select("id", "content", "is_negative_constraint", "outcome"), "id")
    tier = F.when(F.col("is_negative_constraint"), 0).when(F.col("outcome") == "failure", 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy(tier, F.desc("score"), "id")
    items = top.select("query_id", F.row_number().over(w).alias("rank"), "id", T.estimate_tokens(F.col("content")).alias("tokens"))
    return R.pack(items, ["query_id"], 120, 8).select("query_id", "used", F.array_join("ids", ",").alias("ids"))


def explain_belief(spark, d):
    """Verdict on each query by its best memory."""
    top = R.recall(hybrid_score(spark, d), 5, 0.1)
    best = top.groupBy("query_id").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("evidence"))
    verdict = F.when(F.col("top") < 0.35, "ABSTAIN").when(F.col("top") >= 0.6, "SUPPORTED").otherwise("WEAK")
    return best.select("query_id", "top", "evidence", verdict.alias("verdict"))


def drift(spark, d):
    """Notes whose wording marks a change of mind: the candidates for drift. How close a note is to a belief
    is told by vectors, which notes do not have."""
    n = table(spark, d, "notes").where("content is not null").select("id", F.lower("content").alias("c")).distinct()
    contrast = F.lit(False)
    for w in W.CONTRAST:
        contrast = contrast | F.col("c").contains(w)
    return n.where(contrast).select("id")


def preflight(spark, d):
    """Tool notes (actions) against standing prohibitions: blocked if at least two of a prohibition's words
    occur. Every distinct prohibition counts; they are reduced to their words first."""
    neg = memories(spark, d).where("is_negative_constraint and is_active and content is not null")
    c = F.lower("content")
    neg = neg.where(c.rlike("jangan|dilarang|never|tidak boleh|do not")).select(c.alias("rule")).distinct()
    ws = F.filter(F.split(F.regexp_replace("rule", "jangan|dilarang|never|tidak boleh|do not|harus", " "), r"[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    act = table(spark, d, "notes").where("lower(trim(role)) in ('tool', 'function') and content is not null").select("id", F.lower("content").alias("a")).distinct()
    return R.rules_met(act, neg.select(ws.alias("ws")))


def cosine(spark, d):
    """Each embedding with the one after it."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(R.cosine("embedding", "other"), 6).alias("cosine"))


def l2_normalize(spark, d):
    e = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / norm)
    return e.select("vec_id", F.round(norm, 6).alias("norm"), F.round(unit[0], 6).alias("first"), F.round(F.array_max(unit), 6).alias("largest"))


def bq_quantize(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.array_join(R.bits("embedding", 64), ",").alias("words"))


def hamming(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", R.bits("embedding", 64).alias("x"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    h = e.join(nxt, "vec_id").select("vec_id", R.hamming("x", "y").alias("distance"))
    return h.select("vec_id", "distance", F.round(F.cos(F.col("distance") / 64.0 * 3.141592653589793), 6).alias("estimate"), F.round(1 - F.col("distance") / 64.0, 6).alias("similarity"))


def bq_topk(spark, d):
    """The twenty nearest by Hamming distance of every embedding whose id is divisible by 50, against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", R.bits("embedding", 64).alias("x"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("x").alias("y"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    pairs = e.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", R.hamming("x", "y").alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 20")


def embed_local(spark, d):
    m = memories(spark, d).where("content is not null")
    v = m.select("id", R.embedder()(F.col("content")).alias("v"))
    return v.select("id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def cooccurrence(spark, d):
    return G.cooccurrences(memories(spark, d).where("source_session is not null"), "source_session", "id")


def _seeds(spark, d):
    m = memories(spark, d).where("is_active")
    return m.orderBy(F.desc("access_count"), "id").limit(3).select("id", F.lit(1.0).alias("score"))


def resonance(spark, d):
    return G.resonance(_seeds(spark, d), links(spark, d)).select("id", "hop", F.round("boost", 9).alias("boost"))


def ppr(spark, d):
    seeds = _seeds(spark, d).select("id", F.lit(1.0 / 3).alias("p0"))
    return G.page_rank(seeds, links(spark, d)).where("pr > 1e-6").select("id", F.round("pr", 8).alias("pr"))


def communities(spark, d):
    return G.communities(facts(spark, d), memories(spark, d))


QUERIES = {
    f.__name__: f
    for f in (bm25_search, validity_filter, hybrid_score, recall_topk, context_pack, explain_belief, drift, preflight, cosine, l2_normalize, bq_quantize, hamming, bq_topk, embed_local, cooccurrence, resonance, ppr, communities)
}

_M, _F, _L = f"WITH {MEMORIES_SQL}, ", f"WITH {FACTS_SQL}, ", f"{LINKS_SQL}, "
_TERMS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t != '')"
_BM25 = f"""
td AS (SELECT id AS doc, {_TERMS.format("concat_ws(' ', content, category, array_to_string(tags, ' '))")} AS ts FROM m),
po AS (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM td WHERE len(ts) > 0),
pt AS (SELECT doc, dl, term, count(*) AS tf FROM po GROUP BY ALL),
sz AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc, dl FROM pt)),
qu AS (SELECT working_style AS text, min(id) AS query_id FROM personas WHERE working_style IS NOT NULL GROUP BY 1),
q0 AS (SELECT query_id, list_filter({_TERMS.format('text')}, lambda t: length(t) > 1) AS w0 FROM qu),
qw AS (SELECT query_id, list_filter(w0, lambda w, i: list_position(w0, w) = i)[1:16] AS ws FROM q0),
qt AS (SELECT query_id, unnest(CASE WHEN len(list_filter(ws, lambda t: length(t) > 2 AND t NOT IN {_in(W.STOPWORDS)})) > 0 THEN list_filter(ws, lambda t: length(t) > 2 AND t NOT IN {_in(W.STOPWORDS)}) ELSE ws END) AS q FROM qw),
hi AS (SELECT query_id, q, doc, dl, sum(tf) AS tf FROM pt JOIN qt ON starts_with(term, q) GROUP BY ALL),
df AS (SELECT query_id, q, count(*) AS df FROM hi GROUP BY ALL),
sc AS (SELECT query_id, doc, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM hi JOIN df USING (query_id, q), sz GROUP BY ALL),
lx AS (SELECT query_id, doc, round(least(1.0, score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY query_id) END), 6) AS bm25,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rn FROM sc),
b5 AS (SELECT query_id, doc, bm25 FROM lx WHERE rn <= 50)"""
_HYBRID = _BM25 + f""",
hv AS (SELECT m.*, query_id, bm25 FROM m JOIN b5 ON doc = id WHERE is_active AND valid_from <= {AS_OF_SQL} AND (valid_until IS NULL OR valid_until >= {AS_OF_SQL})),
hs AS (SELECT query_id, id, round(least(1.0, greatest(0.0, (bm25 * 0.7 + 0.15 * exp(-ln(2) / CASE category {" ".join(f"WHEN '{k}' THEN {v}" for k, v in W.HALF_LIFE.items())} ELSE {W.DEFAULT_HALF_LIFE} END
  * greatest(0.0, (epoch_us({AS_OF_SQL}) - epoch_us(last_accessed_at)) / 86400000000.0)))
  * CASE WHEN is_negative_constraint THEN 1.45 ELSE 1.0 END * CASE importance WHEN 'critical' THEN 1.35 WHEN 'high' THEN 1.15 WHEN 'low' THEN 0.85 ELSE 1.0 END * CASE WHEN outcome = 'failure' THEN 1.25 ELSE 1.0 END
  * coalesce(confidence, 1.0) * CASE WHEN valid_until IS NULL THEN 1.0 WHEN epoch_ms(valid_until) > epoch_ms({AS_OF_SQL})
      THEN greatest(0.1, (epoch_ms(valid_until) - epoch_ms({AS_OF_SQL}))::DOUBLE / greatest(1.0, (epoch_ms(valid_until) - epoch_ms(created_at))::DOUBLE)) ELSE 0.8 END)), 9)::DOUBLE AS score
  FROM hv WHERE bm25 * 0.7 >= 0.05 OR is_negative_constraint),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hs WHERE score >= @LEAST@)"""
_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_WORDS = "[list_reduce(list_prepend(0::BIGINT, list_transform(embedding[{}:{}], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::BIGINT)), lambda s, x: s * 2 + x)]"
_BITS = "list_concat(" + ", ".join(_WORDS.format(a, a + 31) for a in (1, 33)) + ")"
_EDGES = f"{LINKS_SQL}, ed AS (SELECT a AS src, b AS dst, w FROM l UNION ALL SELECT b, a, w FROM l)"
_SEEDS = "s0 AS (SELECT id FROM m WHERE is_active ORDER BY access_count DESC, id LIMIT 3)"
_RES = "r0 AS (SELECT id, 0 AS hop, 1.0::DOUBLE AS boost FROM s0)"
for _h in (1, 2, 3):
    _prev = " UNION ALL ".join(f"SELECT id FROM r{k}" for k in range(_h))
    _RES += f", r{_h} AS (SELECT dst AS id, {_h} AS hop, round(max(boost * w * {0.15 * 0.5 ** (_h - 1)}), 12) AS boost FROM r{_h - 1} JOIN ed ON src = id WHERE dst NOT IN ({_prev}) GROUP BY dst)"
_PPR = "fl AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM ed), p0 AS (SELECT id, 1.0::DOUBLE / 3 AS pr FROM s0)"
for _h in (1, 2, 3, 4):
    _PPR += f""", x{_h} AS (SELECT coalesce(sum(pr), 0) AS lost FROM p{_h - 1} WHERE id NOT IN (SELECT src FROM ed)),
p{_h} AS (SELECT id, sum(v) AS pr FROM (SELECT dst AS id, 0.85 * pr * p AS v FROM p{_h - 1} JOIN fl ON src = id UNION ALL SELECT id, (1.0 / 3) * (0.15 + 0.85 * lost) FROM s0, x{_h}) GROUP BY id)"""

ORACLE = {
    "bm25_search": _M + _BM25 + " SELECT query_id, doc, bm25 FROM b5",
    "validity_filter": f"WITH {MEMORIES_SQL} SELECT id FROM m WHERE scope IN ('project', 'global') AND is_active AND valid_from <= {AS_OF_SQL} AND (valid_until IS NULL OR valid_until >= {AS_OF_SQL})",
    "hybrid_score": _M + _HYBRID.replace("@LEAST@", "0") + " SELECT query_id, id, score FROM hs",
    "recall_topk": _M + _HYBRID.replace("@LEAST@", "0.2") + " SELECT query_id, id, score, rank FROM rk WHERE rank <= 5",
    "explain_belief": _M + _HYBRID.replace("@LEAST@", "0.1") + ", t5 AS (SELECT query_id, max(score) AS top, count(*) AS evidence FROM rk WHERE rank <= 5 GROUP BY 1) SELECT query_id, top, evidence, CASE WHEN top < 0.35 THEN 'ABSTAIN' WHEN top >= 0.6 THEN 'SUPPORTED' ELSE 'WEAK' END AS verdict FROM t5",
    "drift": "SELECT DISTINCT id FROM notes WHERE content IS NOT NULL AND (" + " OR ".join(f"contains(lower(content), '{w}')" for w in W.CONTRAST) + ")",
    "preflight": _M + """ru AS (SELECT DISTINCT lower(content) AS rule FROM m WHERE is_negative_constraint AND is_active AND regexp_matches(lower(content), 'jangan|dilarang|never|tidak boleh|do not')),
rw AS (SELECT rule, list_distinct(list_filter(regexp_split_to_array(regexp_replace(rule, 'jangan|dilarang|never|tidak boleh|do not|harus', ' ', 'g'), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS ws FROM ru),
ac AS (SELECT DISTINCT id, lower(content) AS a FROM notes WHERE lower(trim(role)) IN ('tool', 'function') AND content IS NOT NULL)
SELECT id, count(*) AS rules FROM ac JOIN rw ON len(ws) > 0 AND len(list_filter(ws, lambda w: contains(a, w))) >= least(2, len(ws)) GROUP BY id""",
    "cosine": f"SELECT a.vec_id, round(greatest(-1.0, least(1.0, {_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "l2_normalize": f"WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings) SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS first, round(list_max(v) / n, 6) AS largest FROM n",
    "bq_quantize": f"SELECT vec_id, array_to_string({_BITS}, ',') AS words FROM embeddings",
    "hamming": f"WITH e AS (SELECT vec_id, {_BITS} AS x FROM embeddings), h AS (SELECT a.vec_id, bit_count(xor(a.x[1], b.x[1])) + bit_count(xor(a.x[2], b.x[2])) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, distance, round(cos(distance / 64.0 * 3.141592653589793), 6) AS estimate, round(1 - distance / 64.0, 6) AS similarity FROM h",
    "bq_topk": f"WITH e AS (SELECT vec_id, {_BITS} AS x FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, bit_count(xor(e.x[1], q.x[1])) + bit_count(xor(e.x[2], q.x[2])) AS distance FROM e JOIN e q ON q.vec_id % 50 = 0 AND e.vec_id != q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 20",
    "cooccurrence": _M + """f AS (SELECT source_session AS s, id, row_number() OVER (PARTITION BY source_session ORDER BY id) AS rn FROM m WHERE source_session IS NOT NULL),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM f x JOIN f y ON x.s = y.s AND x.id != y.id AND x.rn <= 8 AND y.rn <= 8 GROUP BY ALL) SELECT a, b, n, round(least(0.95, 0.5 + 0.05 * (n - 1)), 6)::DOUBLE AS w FROM p""",
    "resonance": _M + f"{_EDGES}, {_SEEDS}, {_RES} SELECT id, hop, round(boost, 9) AS boost FROM r1 UNION ALL SELECT id, hop, round(boost, 9) FROM r2 UNION ALL SELECT id, hop, round(boost, 9) FROM r3",
    "ppr": _M + f"{_EDGES}, {_SEEDS}, {_PPR} SELECT id, round(pr, 8) AS pr FROM p4 WHERE pr > 1e-6",
    "communities": f"WITH RECURSIVE {MEMORIES_SQL}, {FACTS_SQL}, " + f"""g AS (SELECT DISTINCT t.memory_id AS id, lower(object) AS e FROM t JOIN m ON m.id = t.memory_id AND m.is_active WHERE t.is_active AND length(trim(object)) > 2 AND lower(trim(object)) NOT IN {_in(W.STOPWORDS + W.GENERIC)}),
n AS (SELECT DISTINCT x.id AS a, y.id AS b FROM g x JOIN g y ON x.e = y.e), r(a, b) AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON n.a = r.b)
SELECT coalesce(c.community, m.id) AS community, m.id FROM m LEFT JOIN (SELECT a, min(b) AS community FROM r GROUP BY a) c ON c.a = m.id WHERE is_active""",
}
