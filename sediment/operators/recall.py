"""Recall of a batch of queries from end to end: words, vectors, recency and feedback; then the graph around the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.functions import words as W
from sediment.operators.leaders import unit_vectors
from sediment.operators.retrieval import importance_boost, validity_left
from sediment.operators.skew import lookup_join
from sediment.runtime import materialize

# Weights of the signals with a vector of the query and without, and of recency.
WITH_VECTOR, WITHOUT_VECTOR, RECENCY = (0.45, 0.25), (0.0, 0.70), 0.15
#: A memory is relevant from this signal on; a prohibition always is.
LEAST_SIGNAL = 0.05
# Rate of resonance, its factors by hop; weight of a triple, damping and weights of the rank.
RESONANCE, HOPS = 0.15, (1.0, 0.5, 0.25)
ENTITY_WEIGHT, DAMPING, ROUNDS, SEED_GAIN, NEW_GAIN, NEW_LEAST = 0.75, 0.85, 4, 0.25, 0.4, 0.05
# Links, pairs of entities and memories taken into the graph around the results of a query.
MOST_NEIGHBOURS = 40
#: Queries that are sent out for one pass over all memories (20 MB of vectors of 128 numbers).
PASS_QUERIES = 20_000
#: Pairs that a task holds before it leaves out those that are not among the best.
HELD_PAIRS = 1_000_000
#: Rows of several queries' graphs that are walked at once.
WALKED_ROWS = 100_000


def _factors(memories: DataFrame, used: DataFrame, as_of: Column) -> DataFrame:
    """(id, base, factor, usage, neg): what a memory adds and multiplies whatever the query."""
    base = F.round(RECENCY * F.coalesce(T.recency(F.col("last_accessed_at"), F.col("category"), as_of), F.lit(0.0)), 12)
    factor = importance_boost() * F.coalesce("confidence", F.lit(1.0)) * validity_left(as_of)
    m = memories.select("id", base.alias("base"), factor.alias("factor"), F.coalesce("is_negative_constraint", F.lit(False)).alias("neg"))
    u = used.select("id", T.usage_multiplier(F.col("helped"), F.col("misled")).alias("usage"))
    return m.join(u, "id", "left").withColumn("usage", F.coalesce("usage", F.lit(1.0)))


def _usable(vector: str) -> Column:
    """Whether a vector holds finite numbers only, not all zero. NaN is the greatest number, and where a number is
    missing, nobody knows whether infinity is in the vector."""
    infinite = F.lit(float("inf")).cast("float")
    low, high = F.array_min(vector), F.array_max(vector)
    return F.coalesce(~F.array_contains(vector, infinite) & (high < infinite) & (low > -infinite) & ((low != 0) | (high != 0)), F.lit(False))


def _likeness():
    """Arrow UDF: cosines of two columns of vectors within [-1, 1]; 0 where one is null, empty or zero or they differ in length."""

    def numbers(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(a), 0))
        return a.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, sizes

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, at, sizes), (y, bt, others) = numbers(a), numbers(b)
        out = np.zeros(len(sizes))
        for size in np.unique(sizes[(sizes == others) & (sizes > 0)]):
            some = np.flatnonzero((sizes == size) & (others == size))
            p, q = x[at[some][:, None] + np.arange(size)].astype(np.float64), y[bt[some][:, None] + np.arange(size)].astype(np.float64)
            norms = np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))
            ok = norms > 0
            out[some[ok]] = np.maximum(-1.0, np.fmin(1.0, (p[ok] * q[ok]).sum(axis=1) / norms[ok]))
        return pa.array(out)

    return run


def _clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _first(q: np.ndarray, ids: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each q the ``most`` rows with the largest s, equal ones by id."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    take = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[take], ids[take], s[take]


def _score(signal: Column) -> Column:
    return F.round(_clamped(_clamped((signal + F.col("base")) * F.col("factor")) * F.col("usage")), 9)


def _by_vector(rows: DataFrame, vectors: DataFrame, queries: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """(query_id, id, score): for each query the ``most`` best of rows (id, base, factor, usage, neg) with a score of at
    least ``least``, without regard to words. vectors (id, v) are usable ones of some of the rows.

    Without a likeness only prohibitions count, and as much for any query: the ``most`` best of them are found once.
    Pairs of vectors of one length go through blocks: queries (query_id, u) go out PASS_QUERIES at a time, and what a
    row lacks to ``least`` says from which cosine on a pair is looked at."""
    asked = queries.select("query_id", "u")
    n = asked.count()
    parts = max(1, -(-n // PASS_QUERIES))
    same = rows.where("neg").select("id", _score(F.lit(0.0)).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(most)
    out = asked.select("query_id").crossJoin(F.broadcast(same))
    for p in range(parts):
        some = asked.where("u is not null").where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((np.asarray(some.column(0)), some.column(1).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, units = shared.value
            by_size: dict[int, list[int]] = {}
            for k, u in enumerate(units):
                by_size.setdefault(len(u) // 8, []).append(k)
            asking = {size: (np.array(at), np.frombuffer(b"".join(units[k] for k in at)).reshape(len(at), -1)) for size, at in by_size.items()}
            found, held = [], 0
            for b in batches:
                ids, base, factor, usage, neg = (np.asarray(b.column(k)) for k in range(5))
                numbers, begin = b.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(b.column(5).offsets)
                sizes, begin = np.diff(begin), begin - begin[0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    lack = ((least - 1e-8) / (factor * usage) - base) / WITH_VECTOR[0]
                lack = np.where((factor * usage > 0) & (least > 0), lack, -np.inf)
                lack = np.where(neg, lack, np.maximum(lack, LEAST_SIGNAL / WITH_VECTOR[0])) - 1e-6
                for size, (members, q) in asking.items():
                    like = np.flatnonzero(sizes == size)
                    for a in range(0, len(like), 2_048):
                        mine = like[a : a + 2_048]
                        x = numbers[begin[mine][:, None] + np.arange(size)]
                        length = np.sqrt((x * x).sum(axis=1))
                        fine = (length > 0) & (length < np.inf)
                        mine, x = mine[fine], x[fine] / length[fine, None]
                        for at in range(0, len(members), 256):
                            dots = q[at : at + 256] @ x.T
                            i, j = np.nonzero(dots >= np.where(lack[mine] > 0, lack[mine], -np.inf))
                            signal = WITH_VECTOR[0] * np.maximum(np.round(dots[i, j], 6), 0.0)
                            j = mine[j]
                            s = np.round(np.clip(np.clip((signal + base[j]) * factor[j], 0.0, 1.0) * usage[j], 0.0, 1.0), 9)
                            keep = (s >= least) & ((signal >= LEAST_SIGNAL) | neg[j])
                            found.append((members[at + i[keep]], ids[j[keep]], s[keep]))
                            held += int(keep.sum())
                            if held > HELD_PAIRS:
                                found = [_first(*(np.concatenate(c) for c in zip(*found)), most)]
                                held = 0
            if found:
                k, i, s = _first(*(np.concatenate(c) for c in zip(*found)), most)
                yield pa.RecordBatch.from_arrays([pa.array(qid[k], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

        one = rows.join(vectors, "id").select("id", "base", "factor", "usage", "neg", "v").mapInArrow(run, "query_id long, id long, score double")
        out = out.unionByName(one)
    out = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # a prohibition may be in both
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def hybrid_search(memories: DataFrame, vectors: DataFrame, lexical: DataFrame, queries: DataFrame, used: DataFrame, as_of: Column, limit: int = 5, least: float = 0.2, words: int = 50) -> DataFrame:
    """(query_id, id, score, rank): the best memories of each query by words, vectors, recency and feedback.

    memories are the valid ones; vectors (memory_id, vector); lexical the (query_id, doc, bm25) of the at most ``words``
    best by words; queries (query_id, vector), a null, zero or unlike vector leaving the words alone to count; used (id,
    helped, misled). Every memory counts, whether words met it or not: what words met is scored by a join, and the
    best limit + words of the others are found in a pass over all memories. Repeated memory ids in vectors count once
    (the smallest vector); ties go to the smaller id; empty tables give no rows."""
    m = materialize(_factors(memories, used, as_of))  # read three times
    stored = vectors.where("memory_id is not null").where(_usable("vector")).groupBy(F.col("memory_id").alias("id")).agg(F.min("vector").alias("vector"))
    asked = queries.groupBy("query_id").agg(F.min(F.when(_usable("vector"), F.col("vector"))).alias("q"))
    lexical = materialize(lexical.select("query_id", F.col("doc").alias("id"), "bm25"))  # counted by key before it is joined
    met = lookup_join(lexical, m, "id", "inner")
    met = lookup_join(met, stored, "id", "left").join(asked, "query_id", "left")
    v = F.greatest(F.lit(0.0), F.round(_likeness()("q", "vector"), 6))
    signal = F.when(F.col("q").isNotNull(), WITH_VECTOR[0] * v + WITH_VECTOR[1] * F.col("bm25")).otherwise(WITHOUT_VECTOR[1] * F.col("bm25"))
    by_word = materialize(met.select("query_id", "id", _score(signal).alias("score"), ((signal >= LEAST_SIGNAL) | F.col("neg")).alias("kept")))
    asked = materialize(unit_vectors(asked.select(F.col("query_id").alias("id"), F.col("q").alias("v"))).select(F.col("id").alias("query_id"), "u"))  # read for every pass
    others = _by_vector(m, stored.select("id", F.col("vector").alias("v")), asked, limit + words, least)
    others = others.join(by_word.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return best(by_word.where("kept").drop("kept").unionByName(others), limit, least)


def drifted(said: DataFrame, memories: DataFrame, vectors: DataFrame, least: float = 0.40) -> DataFrame:
    """(id, against, similarity) of statements (id, content, vector) that are close to another active memory, its cosine
    being at least ``least``, and whose wording marks a change: the memory nearest to it (equal ones: the smaller id).
    A statement that is stored itself is not compared with itself; unusable vectors are near nothing."""
    alive = memories.where("is_active").select("id")
    stored = vectors.where("memory_id is not null").where(_usable("vector")).groupBy(F.col("memory_id").alias("id")).agg(F.min("vector").alias("v"))
    factor = F.lit(1.0 / WITH_VECTOR[0])  # the signal of a vector alone, without its weight
    rows = alive.select("id", F.lit(0.0).alias("base"), factor.alias("factor"), F.lit(1.0).alias("usage"), F.lit(False).alias("neg"))
    change = F.lit(False)
    for w in W.CONTRAST:
        change = change | F.lower("content").contains(w)
    turns = said.where("content is not null").where(change).where(_usable("vector")).groupBy("id").agg(F.min("vector").alias("v"))
    near = _by_vector(rows, stored, unit_vectors(turns).select(F.col("id").alias("query_id"), "u"), 2, least).where("query_id != id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = near.withColumn("_n", F.row_number().over(w)).where("_n = 1").where(F.col("score") >= least)
    return first.select(F.col("query_id").alias("id"), F.col("id").alias("against"), F.round("score", 2).alias("similarity"))


def best(scored: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def resonant(found: DataFrame, links: DataFrame, memories: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, id, score, rank) of results after spreading activation from each query's best three.

    links (a, b, w) are walked both ways to active memories. A parent gives its neighbours score x weight x rate x the
    hop's factor: known ones add it, from every parent; new ones enter with the largest of it and spread on. Breadth
    first, each memory once."""
    alive = memories.where("is_active").select(F.col("id").alias("dst"))
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(links.select("b", "a", "w"))
    edges = materialize(lookup_join(edges, alive, "dst", "left_semi"))  # read by every hop
    low, high = edges.agg(F.min("w"), F.max("w")).first()
    grows = low is not None and low >= 0 and (found.agg(F.min("score")).first()[0] or 0) >= 0
    known = found.select("query_id", "id", "score")
    front = found.where("rank <= 3").select("query_id", F.col("id").alias("src"), "score")
    for hop in HOPS[:-1] if grows else HOPS:
        step = front.join(edges, "src").select("query_id", F.col("dst").alias("id"), _boost(hop))
        boosts = step.groupBy("query_id", "id").agg(F.sum("boost").alias("all"), F.max("boost").alias("most"))
        both = known.join(boosts, ["query_id", "id"], "full")
        known = materialize(both.select("query_id", "id", F.coalesce(F.col("score") + F.coalesce("all", F.lit(0.0)), F.col("most")).alias("score"), F.col("score").isNull().alias("new")))
        front = known.where("new").select("query_id", F.col("id").alias("src"), "score")
        known = known.drop("new")
    if grows:
        known = _last_hop(known, front, edges, high, limit)
    return best(known.select("query_id", "id", F.round(_clamped(F.col("score")), 9).alias("score")), limit)


def _boost(hop: float) -> Column:
    return F.round(F.col("score") * F.col("w") * RESONANCE * hop, 12).alias("boost")


def _last_hop(known: DataFrame, front: DataFrame, edges: DataFrame, high: float, limit: int) -> DataFrame:
    """(query_id, id, score) after the last hop, of all that can be among the ``limit`` best.

    No boost is negative, so a query's ``limit`` best stay at least where they are. What is known and cannot get there
    with all that the front gives out, at the greatest weight, is left out, and so is what is new and gets too little.
    The others are met from their own links, as the front may be next to hubs with thousands."""
    hop = HOPS[-1]
    most, near = F.lit(float(high) * RESONANCE * hop), 1e-6  # near: more than any sum of rounded boosts is off
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floor = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == limit).select("query_id", F.least(F.lit(1.0), "score").alias("floor"))
    given = front.groupBy("query_id").agg(F.sum("score").alias("given"))
    bounds = materialize(given.join(floor, "query_id", "left"))  # read three times; a query without front keeps what it has
    open_ = F.col("floor").isNull()
    able = known.join(bounds, "query_id", "left").where(open_ | (F.col("score") + F.coalesce("given", F.lit(0.0)) * most + near >= F.col("floor"))).select("query_id", "id", "score")
    able = materialize(able)  # read twice
    met = able.select("query_id", "id").join(edges.withColumnRenamed("dst", "id"), "id").join(front, ["query_id", "src"])
    more = met.select("query_id", "id", _boost(hop)).groupBy("query_id", "id").agg(F.sum("boost").alias("all"))
    out = able.join(more, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("all", F.lit(0.0))).alias("score"))
    from_ = front.join(bounds.select("query_id", "floor"), "query_id").where(open_ | (F.col("score") * most + near >= F.col("floor")))
    new = from_.join(edges, "src").select("query_id", F.col("dst").alias("id"), _boost(hop), "floor").where(open_ | (F.col("boost") + near >= F.col("floor")))
    new = new.groupBy("query_id", "id").agg(F.max("boost").alias("score")).join(known, ["query_id", "id"], "left_anti")
    return out.unionByName(new)


def _around(found: DataFrame, both: DataFrame, said: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, id): the active memories in the graph around the results of each query. both are the links (id, other,
    w) from either end, said the active triples (memory_id, subject, object).

    Of each memory's links and of each entity's memories the MOST_NEIGHBOURS first are enough for any query, so they
    are held as lists, and what is moved by query is a list for each result and each entity."""
    seeds = found.select("query_id", "id")
    w = Window.partitionBy("id").orderBy(F.desc("w"), "other")
    some = both.join(seeds.select("id").distinct(), "id", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_NEIGHBOURS)
    w = Window.partitionBy("query_id").orderBy(F.desc("w"), "other")
    near = seeds.join(some.select("id", "other", "w"), "id").groupBy("query_id", "other").agg(F.max("w").alias("w")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_NEIGHBOURS)
    w = Window.partitionBy("query_id").orderBy("subject", "object")
    pairs = seeds.join(said, seeds["id"] == said["memory_id"]).select("query_id", "subject", "object").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_NEIGHBOURS)
    names = pairs.select("query_id", F.explode(F.array("subject", "object")).alias("e")).where(T.informative(F.col("e"))).distinct()
    holders = said.select("memory_id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("e")).where(T.informative(F.col("e")))
    holders = lookup_join(holders, names.select("e").distinct(), "e", "left_semi").distinct()
    first = Window.partitionBy("e").orderBy("memory_id")
    holders = holders.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MOST_NEIGHBOURS).groupBy("e").agg(F.collect_list("memory_id").alias("l"))
    lists = names.join(holders, "e").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("l"))).alias("l"))  # of 2 * MOST_NEIGHBOURS names at most
    shared = lists.select("query_id", F.explode(F.slice(F.array_sort("l"), 1, MOST_NEIGHBOURS)).alias("id"))
    everyone = seeds.union(near.select("query_id", "other")).union(shared).distinct()
    return everyone.join(memories.where("is_active").select("id"), "id", "left_semi").select("query_id", "id")


def _walked(rows: DataFrame) -> DataFrame:
    """(query_id, id, pr): where the walk of each query ends, of memories that are results or have NEW_LEAST or so.

    rows (query_id, src, dst, name, x) are a query's results (src, x: score), the memories of its graph (src), links to
    be looked at (src, dst, x: weight) and entities named by a memory (src, name, x: weight). All rows of a query are
    together and in order, and as many queries as a batch holds walk at once, in arrays over all their nodes."""

    def walk(q: np.ndarray, src: np.ndarray, dst: pa.Array, name: pa.Array, x: pa.Array) -> pa.RecordBatch:
        to, named = ~np.asarray(dst.is_null()), ~np.asarray(name.is_null())
        weight = x.fill_null(0.0).to_numpy(zero_copy_only=False)
        result = ~(to | named | np.asarray(x.is_null()))
        member = ~(to | named | result)
        queries, q = np.unique(q, return_inverse=True)
        memories, at = np.unique(np.concatenate([src, dst.fill_null(0).to_numpy(zero_copy_only=False)]), return_inverse=True)
        at, other = at[: len(src)], at[len(src) :]
        entity = np.zeros(len(src), np.int64)
        entity[named] = np.asarray(name.filter(pa.array(named)).dictionary_encode().indices)
        here = q * len(memories) + at  # a memory of a query
        nodes = np.unique(here[member])
        place = lambda k: np.minimum(np.searchsorted(nodes, k), len(nodes) - 1)
        known = lambda k: nodes[place(k)] == k
        if not len(nodes):
            nodes = np.array([-1])  # the results of these queries are no longer active
        there = q * len(memories) + other
        link = to & known(here) & known(there)
        words, word = np.unique(q[named] * (entity.max(initial=0) + 1) + entity[named], return_inverse=True)
        word, holder = word + len(nodes), place(here[named])
        of = np.concatenate([nodes // len(memories), words // (entity.max(initial=0) + 1)])  # the query of each node
        a, b = place(here[link]), place(there[link])
        begin, end = np.concatenate([a, b, holder, word]), np.concatenate([b, a, word, holder])
        w = np.concatenate([weight[link], weight[link], weight[named], weight[named]])
        count = len(of)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = w / np.bincount(begin, w, count)[begin]
        out = np.bincount(begin, minlength=count) > 0
        start = result & known(here)
        p0 = np.bincount(place(here[start]), np.maximum(0.1, weight[start]), count)
        total = np.bincount(of, p0, len(queries))
        p0 = p0 / np.where(total == 0, 1.0, total)[of]
        rank = p0
        for _ in range(ROUNDS):
            lost = np.bincount(of[~out], rank[~out], len(queries))
            with np.errstate(invalid="ignore"):
                moved = np.where(rank[begin] == 0, 0.0, rank[begin] * p)
            rank = DAMPING * np.bincount(end, moved, count) + p0 * (1 - DAMPING + DAMPING * lost[of])
        rank = rank[: len(nodes)]
        some = np.flatnonzero((p0[: len(nodes)] > 0) | ~(rank < NEW_LEAST - 1e-6))
        some = some[nodes[some] >= 0]
        return pa.RecordBatch.from_arrays([pa.array(queries[nodes[some] // len(memories)], pa.int64()), pa.array(memories[nodes[some] % len(memories)], pa.int64()), pa.array(rank[some], pa.float64())], names=["query_id", "id", "pr"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def table(parts: list[pa.RecordBatch]) -> list[pa.Array]:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0].columns

        for b in batches:
            if not b.num_rows:
                continue
            q = np.asarray(b.column(0))
            cut = int(np.searchsorted(q, q[-1]))  # the last query may go on
            if cut and rows + cut >= WALKED_ROWS:
                c = table([*held, b.slice(0, cut)])
                yield walk(np.asarray(c[0]), np.asarray(c[1]), *c[2:])
                held, rows, b = [], 0, b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held:
            c = table(held)
            yield walk(np.asarray(c[0]), np.asarray(c[1]), *c[2:])

    return rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, id long, pr double")


def ranked_by_graph(found: DataFrame, links: DataFrame, facts: DataFrame, memories: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, id, score, rank) of results after a personalized PageRank over memories and entities around them.

    The walk restarts at the results in proportion to their score (0.1 at least) and returns there from nodes without
    edge. A result gains a quarter of its rank; others with a rank above 0.05 enter with 0.4 of it. A link is looked
    for from the end that has fewer of them, so a hub's links are not written out for each query next to it."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").union(links.select("b", "a", "w"))
    said = facts.where("is_active and memory_id is not null and subject is not null and object is not null").select("memory_id", "subject", "object", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    said = materialize(said)  # read three times
    passages = materialize(_around(found, both, said, memories))  # read three times
    degree = both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select("a", "b", "w").join(degree.toDF("a", "n"), "a").join(degree.toDF("b", "k"), "b")
    fewer = F.col("n") <= F.col("k")
    ends = ends.select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("dst"), "w")
    linked = passages.join(ends, "id").select("query_id", F.col("id").alias("src"), "dst", F.lit(None).cast("string").alias("name"), F.col("w").cast("double").alias("x"))
    named = said.select(F.col("memory_id").alias("id"), F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("name"), (ENTITY_WEIGHT * F.col("confidence")).alias("x")).where(T.informative(F.col("name")))
    named = passages.join(named, "id").select("query_id", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "name", F.col("x").cast("double").alias("x"))
    nodes = passages.select("query_id", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("x"))
    results = found.select("query_id", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("string").alias("name"), F.col("score").alias("x"))
    pr = _walked(results.unionByName(nodes).unionByName(linked).unionByName(named)).select("query_id", "id", F.round("pr", 10).alias("pr"))
    both = found.select("query_id", "id", "score").join(pr, ["query_id", "id"], "full")
    score = F.when(F.col("score").isNotNull(), F.col("score") + SEED_GAIN * F.coalesce("pr", F.lit(0.0))).when(F.col("pr") > NEW_LEAST, NEW_GAIN * F.col("pr"))
    return best(both.select("query_id", "id", F.round(_clamped(score), 9).alias("score")).where("score is not null"), limit)


def attached(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, id, triple_id, subject, predicate, object): the active triples of each result."""
    t = facts.where("is_active and memory_id is not null").select(F.col("id").alias("triple_id"), "subject", "predicate", "object", F.col("memory_id").alias("id"))
    return found.select("query_id", "id").join(t, "id").select("query_id", "id", "triple_id", "subject", "predicate", "object")


def side_effects(found: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """What a recall leaves to be written: (id, recalled), accesses to add to the memories, and (a, b, n, w), links
    between memories recalled together."""
    from sediment.operators.graph import cooccurrences

    return found.groupBy("id").agg(F.count(F.lit(1)).alias("recalled")), cooccurrences(found, "query_id", "id", most)
