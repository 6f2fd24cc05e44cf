"""Graph expansion and clustering over associative links and entity triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.operators.components import connected_components
from sediment.runtime import materialize


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(links.select("b", "a", "w"))


def resonance(seeds: DataFrame, links: DataFrame, hops: int = 3, rate: float = 0.15) -> DataFrame:
    """(id, hop, boost): spreading activation from (id, score), breadth first. A node first reached on a hop
    gets the largest of parent's score x weight x rate x 0.5^hop; each node is entered once."""
    edges = both_ways(links)
    seen = seeds.select("id", F.lit(0).alias("hop"), F.col("score").cast("double").alias("boost"))
    front = seen
    for hop in range(1, hops + 1):
        factor = rate * 0.5 ** (hop - 1)
        step = front.join(edges, front["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.round(F.max(F.col("boost") * F.col("w") * factor), 12).alias("boost"))
        front = materialize(step.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop"), "boost"))
        seen = materialize(seen.unionByName(front))
    return seen.where("hop > 0")


def page_rank(seeds: DataFrame, links: DataFrame, rounds: int = 4, damping: float = 0.85) -> DataFrame:
    """(id, pr): personalized PageRank on the whole weighted graph, restarting at seeds (id, p0), whose p0 add
    up to one; the mass of nodes without link returns to the seeds."""
    edges = both_ways(links)
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    flow = materialize(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    rank = materialize(seeds.select("id", F.col("p0").alias("pr")))
    sources = flow.select(F.col("src").alias("id")).distinct()
    for _ in range(rounds):
        moved = rank.join(flow, rank["id"] == flow["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("p")).alias("m"))
        lost = rank.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("lost"))
        back = seeds.join(F.broadcast(lost)).select("id", (F.col("p0") * (1 - damping + damping * F.col("lost"))).alias("m"))  # one row
        rank = materialize(moved.select("id", (F.col("m") * damping).alias("m")).unionByName(back).groupBy("id").agg(F.sum("m").alias("pr")))
    return rank


def cooccurrences(log: DataFrame, group: str, item: str, most: int = 8) -> DataFrame:
    """(a, b, n, w): how often two of the first ``most`` items of a group go together and the link's weight."""
    w = Window.partitionBy(group).orderBy(item)
    first = log.select(group, item).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    lists = first.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("l"))  # ``most`` at most
    pairs = lists.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a != b")
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.select("a", "b", "n", F.round(F.least(F.lit(0.95), 0.5 + 0.05 * (F.col("n") - 1)), 6).alias("w"))


def communities(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """(community, id): memories connected by informative entities of their active triples; a memory without
    any is a community of its own. The bipartite graph keeps the edges linear in the triples; a community is
    named by its smallest memory."""
    act = memories.where("is_active").select("id")
    t = facts.where("is_active and memory_id is not null").where(T.informative(F.col("object"))).select(F.col("memory_id").alias("id"), F.lower("object").alias("e"))
    t = t.join(act, "id", "left_semi").distinct()
    name = t.select("e").distinct().withColumn("node", -F.abs(F.xxhash64("e")) - 1)
    comp = connected_components(t.join(name, "e").select(F.col("id").alias("src"), F.col("node").alias("dst")))
    member = comp.where("node >= 0").select(F.col("node").alias("id"), "component")
    first = member.groupBy("component").agg(F.min("id").alias("community"))
    found = member.join(first, "component").select("community", "id")
    return found.unionByName(act.join(found, "id", "left_anti").select(F.col("id").alias("community"), "id"))


def described(members: DataFrame, facts: DataFrame, memories: DataFrame, most: int = 5) -> DataFrame:
    """(community, members, category, entities) of communities (community, id): how many, their commonest category and
    the commonest informative entities of their active triples; ties in alphabetical order."""
    m = memories.where("is_active").select("id", "category")
    rows = members.join(m, "id")
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("members"))
    by_category = rows.groupBy("community", "category").agg(F.count(F.lit(1)).alias("n"))
    top = by_category.groupBy("community").agg(F.min_by("category", F.struct((-F.col("n")).alias("n"), F.col("category").isNull().alias("none"), "category")).alias("category"))
    said = facts.where("is_active and memory_id is not null").where(T.informative(F.col("object"))).select(F.col("memory_id").alias("id"), F.lower("object").alias("e")).distinct()
    w = Window.partitionBy("community").orderBy(F.desc("n"), "e")
    named = said.join(members, "id").groupBy("community", "e").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    named = named.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("l")).select("community", F.array_join(F.transform("l", lambda x: x["e"]), ", ").alias("entities"))
    return size.join(top, "community").join(named, "community", "left").select("community", "members", "category", F.coalesce("entities", F.lit("")).alias("entities"))
