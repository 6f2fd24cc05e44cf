"""Filling containers of fixed capacity with items by bin completion.

Items are spread over groups of a bounded number of containers. In a group the largest item left opens a
container, and branch and bound looks for the fillings around it that no other filling dominates,
fullest first, pruned as soon as the waste so far shows that the best packing known cannot be beaten;
best-fit solutions serve as incumbents. What a group leaves in badly filled containers is packed again
together with the leavings of other groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.runtime import materialize, shuffle_partitions

#: Groups that a task packs one after the other.
TASK_GROUPS = 32
#: A group holds about this many containers' worth of items.
GROUP_CONTAINERS = 128
#: Fillings that the search of one group may look at.
NODES = 2_000
#: (fillings tried at each container, partial sets looked at for them): plain completion first, then with returns.
SEARCHES = ((1, 60), (4, 200))
#: Item sizes tried at a place of a filling before all of them are.
NARROW = 4
#: Capacities are a small table; more rows than this are refused, not cut.
MOST_CAPACITIES = 1_000
#: Containers filled less than this are packed again.
WELL_FILLED = 0.98


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items per container, largest items first, each into the fullest container it fits."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            insort(room, (left - sizes[i], b))
    return bins


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the sizes b can be shared out into parts that fit under different sizes of a (both largest first): then a
    packing with b is no better than one with a. Told by first fit, so some dominated sets are kept."""
    if b and (not a or b[0] > a[0]):
        return False
    room = list(a)
    for s in b:
        for i, r in enumerate(room):
            if s <= r:
                room[i] = r - s
                break
        else:
            return False
    return True


def _grow(sizes: list[int], order: list[int], neg: list[int], room: int, most: int, wide: int, full: bool) -> tuple[list[tuple[int, list[int]]], int, bool]:
    """(maximal sets with the room they leave, partial sets seen, whether all sets were seen)."""
    found: list[tuple[int, list[int]]] = []
    seen, whole = 0, True
    stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
    while stack:
        at, left, taken = stack.pop()
        if seen == most:
            return found, seen, False
        seen += 1
        p = max(at, bisect_left(neg, -left))
        if p >= len(order):
            found.append((left, taken))
            if full and not left:
                return found, seen, False
            continue
        options = []
        while p < len(order) and len(options) < wide:
            options.append(p)
            p = bisect_right(neg, neg[p], p)  # equal items give equal fillings
        whole &= p >= len(order)
        stack += [(q + 1, left - sizes[order[q]], [*taken, order[q]]) for q in reversed(options)]
    return found, seen, whole


def fillings(sizes: list[int], order: list[int], room: int, most: int, keep: int) -> tuple[list[list[int]], bool]:
    """(sets, all): the ``keep`` fullest undominated fillings of ``room`` from the items of ``order`` (largest first),
    maximal sets, to which no further item fits. At most about ``most`` partial sets are looked at, first those that
    take one of the NARROW largest sizes at each place, then any; ``all`` tells whether no filling was left out.
    For a single filling the search ends at one that leaves no room."""
    neg = [-sizes[i] for i in order]
    found, seen, whole = _grow(sizes, order, neg, room, most, NARROW, keep == 1)
    if not whole and seen < most and not (keep == 1 and any(not left for left, _ in found)):
        found, _, whole = _grow(sizes, order, neg, room, most, len(order), keep == 1)
    found.sort(key=lambda x: (x[0], len(x[1])))
    out: list[list[int]] = []
    kept: list[list[int]] = []  # their sizes, largest first, as items are taken in that order
    for _, taken in found:
        if len(out) == keep:
            return out, False
        mine = [sizes[i] for i in taken]
        if not any(dominates(o, mine) for o in kept):
            out.append(taken)
            kept.append(mine)
    return out, whole


def fewest(sizes: list[int], capacity: int) -> int:
    """A number of containers below which no packing can go: by the sum, and for each size a of at most half a container
    by the items above capacity - a and above a half, which share no container, and what of the items of at least a does
    not fit beside the latter."""
    ordered = sorted(sizes)
    sums = [0]
    for x in ordered:
        sums.append(sums[-1] + x)
    out = -(-sums[-1] // capacity)
    half = bisect_right(ordered, capacity // 2)
    for a in sorted(set(ordered[:half])):
        low, high = bisect_left(ordered, a), bisect_right(ordered, capacity - a)
        room = (high - half) * capacity - (sums[high] - sums[half])
        out = max(out, len(ordered) - half + max(0, -(-(sums[half] - sums[low] - room) // capacity)))
    return out


def complete(sizes: list[int], capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """(containers, proved): containers as lists of item indices, every item in exactly one, none above capacity;
    proved if no packing has fewer. All sizes must lie between 1 and capacity.

    Depth first over the fillings around the largest item left, so the last containers vary first; a branch ends
    where its waste shows that it cannot beat the best packing known. Stops at the lower bound or after ``nodes``
    fillings; what is found by then is never worse than best fit."""
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = fewest(sizes, capacity)
    budget, proved = nodes, False
    first = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for width, most in SEARCHES:
        if len(incumbent) <= bound or proved:
            break
        proved = True  # until something is left out
        frames: list[tuple[list[int], list[list[int]], int, list[list[int]]]] = []
        step: tuple[list[int], list[list[int]], int] | None = (first, [], 0)
        while step or frames:
            if step:
                left, bins, waste = step
                options, whole = fillings(sizes, left[1:], capacity - sizes[left[0]], most, width)
                proved &= whole
                frames.append((left, bins, waste, options[::-1]))
                step = None
            left, bins, waste, options = frames[-1]
            if not options:
                frames.pop()
                continue
            taken = options.pop()
            lost = capacity - sizes[left[0]] - sum(sizes[i] for i in taken)
            if waste + lost > capacity * (len(incumbent) - 1) - total:
                frames.pop()  # fullest first: the others lose more
                continue
            if budget <= 0 or len(incumbent) <= bound:
                proved = False
                break
            budget -= 1
            drop = {left[0], *taken}
            rest, filled = [i for i in left if i not in drop], [*bins, [left[0], *taken]]
            if rest:
                step = (rest, filled, waste + lost)
            elif len(filled) < len(incumbent):
                incumbent = filled
    return incumbent, proved or len(incumbent) <= bound


def _pack_groups(items: DataFrame, nodes: int, groups: int) -> DataFrame:
    """items (block_name, capacity, grp, doc_id, part, first_token, size) with the container ``box`` in grp, its filling
    and whether no packing of the group has fewer containers."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("part", "ascending")])
        sizes, capacity = t.column("size").to_pylist(), t.column("capacity")[0].as_py()
        box, full = [0] * len(sizes), [0] * len(sizes)
        boxes, proved = complete(sizes, capacity, nodes)
        for b, members in enumerate(boxes):
            total = sum(sizes[i] for i in members)
            for i in members:
                box[i], full[i] = b, total
        return t.append_column("box", pa.array(box, pa.int64())).append_column("filled", pa.array(full, pa.int64())).append_column("proved", pa.array([proved] * len(sizes), pa.bool_()))

    # the rows are few for the work they make, so the number of tasks follows that of the groups
    parts = max(shuffle_partitions(items.sparkSession), -(-groups // TASK_GROUPS))
    schema = "block_name string, capacity long, grp string, doc_id long, part long, first_token long, size long, box long, filled long, proved boolean"
    return items.select("block_name", "capacity", "grp", "doc_id", "part", "first_token", "size").repartition(parts, "block_name", "grp").groupBy("block_name", "grp").applyInArrow(run, schema)


def packed_documents(sizes: DataFrame, capacities: DataFrame, group_containers: int = GROUP_CONTAINERS, nodes: int = NODES, rounds: int = 3) -> DataFrame:
    """(block_name, container, doc_id, part, first_token, size, proved): every document laid into containers of
    each capacity; proved tells whether the items its container was packed with have no packing in fewer containers.

    sizes is (doc_id, tokens); of repeated doc_ids the largest counts, documents without token take no
    room and have no row. capacities is the small table (name, token_limit), whose null and non-positive
    limits are left out. A document is split only if it is larger than the capacity: into full containers
    and one rest, which is packed like any other item. first_token is the part's place in the document."""
    spark = sizes.sparkSession
    caps = [(r[0], int(r[1])) for r in capacities.where("name is not null and token_limit > 0").groupBy("name").agg(F.max("token_limit")).orderBy("name").limit(MOST_CAPACITIES + 1).collect()]
    if len(caps) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    docs = materialize(sizes.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    total = docs.agg(F.sum("tokens")).first()[0] or 0
    out = "block_name string, container string, doc_id long, part long, first_token long, size long, proved boolean"
    if not caps or not total:
        return spark.createDataFrame([], out)
    many = {n: max(1, round(total / (c * group_containers))) for n, c in caps}
    limits = F.broadcast(spark.createDataFrame([(n, c, many[n]) for n, c in caps], "block_name string, capacity long, groups long"))
    pieces = docs.join(limits).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / F.col("capacity")) - 1)))
    first = F.col("part") * F.col("capacity")
    pieces = pieces.select("block_name", "capacity", "groups", "doc_id", "part", first.alias("first_token"), F.least("capacity", F.col("tokens") - first).alias("size"))
    whole = pieces.where("size = capacity").select("block_name", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("container"), "doc_id", "part", "first_token", "size", F.lit(True).alias("proved"))
    todo = pieces.where("size < capacity").withColumn("grp", F.concat(F.lit("0-"), F.pmod(F.xxhash64("doc_id", "part"), F.col("groups"))))
    done = whole
    for r in range(rounds):
        packed = materialize(_pack_groups(todo, nodes, sum(many.values())))
        last = r == rounds - 1
        good = packed if last else packed.where(F.col("filled") >= WELL_FILLED * F.col("capacity"))
        done = done.unionByName(good.select("block_name", F.concat_ws("-", "grp", "box").alias("container"), "doc_id", "part", "first_token", "size", "proved"))
        if last:
            break
        rest = packed.where(F.col("filled") < WELL_FILLED * F.col("capacity"))
        left = {x[0]: x[1] for x in rest.groupBy("block_name").agg(F.sum("size")).collect()}
        if not left:
            break
        many = {n: max(1, round(left.get(n, 0) / (c * group_containers))) for n, c in caps}
        again = F.broadcast(spark.createDataFrame(list(many.items()), "block_name string, groups long"))
        todo = rest.drop("grp", "box", "filled", "proved").join(again, "block_name").withColumn("grp", F.concat(F.lit(f"{r + 1}-"), F.pmod(F.xxhash64("part", "doc_id"), F.col("groups"))))
    return done


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(block_name, containers, least, proved, items, tokens, unused): least is a bound below which no packing can go,
    proved the share of containers of groups packed with as few as possible, unused the share of room left over."""
    caps = F.broadcast(capacities.where("name is not null and token_limit > 0").groupBy(F.col("name").alias("block_name")).agg(F.max("token_limit").alias("capacity")))  # MOST_CAPACITIES at most
    per = packed.groupBy("block_name", "container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("tokens"), F.min("proved").alias("proved"))
    total = per.groupBy("block_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.avg(F.col("proved").cast("int")).alias("proved"))
    room = F.col("containers") * F.col("capacity")
    return total.join(caps, "block_name").select(
        "block_name", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.round("proved", 6).alias("proved"), "items", "tokens", F.round(1 - F.col("tokens") / room, 6).alias("unused")
    )
