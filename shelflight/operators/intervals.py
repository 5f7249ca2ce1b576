"""Interval labels of a forest: below a node lie exactly the nodes whose number is in the node's range.

Numbers come from pointer doubling: a node knows an ancestor 1, 2, 4, ... steps up,
so levels, subtree sizes and numbers take as many rounds as the depth has binary
digits. Stored by their number, a subtree is a range that the file statistics
prune, and the number of descendants is a difference; no ancestor list is exploded.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.sources.tables import materialise

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def _earlier_siblings(nodes: DataFrame) -> DataFrame:
    """(node_id, earlier): the sizes of all siblings before each node, in order of node_id; roots are siblings.

    Siblings are sorted by ranges and added up inside their range first, so a parent
    with any number of children stays spread.
    """
    ranged = nodes.select("node_id", "parent", "size").repartitionByRange("parent", "node_id").sortWithinPartitions("parent", "node_id")
    placed = materialise(ranged.withColumn("turn", F.monotonically_increasing_id()), "siblings")
    # a root's parent is null, which no join would meet
    placed = placed.select(
        "node_id", "size", "turn", F.coalesce(F.concat(F.lit("="), "parent"), F.lit("")).alias("above"), F.shiftright("turn", _ROW_BITS).alias("part")
    )
    totals = placed.groupBy("above", "part").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("above").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("above", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("above", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    added = placed.select("node_id", "above", "part", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("inside"))
    return added.join(starts.hint("merge"), ["above", "part"]).select("node_id", (F.col("start") + F.col("inside")).alias("earlier"))


def _jumped(state: DataFrame, added: str) -> DataFrame:
    """A round of doubling: ``up`` moves on to what it knows itself, and ``added`` grows by what it has gathered.

    Nodes that are through have no ``up`` and stay out of the join, where their nulls would meet in one task.
    """
    known = state.select(F.col("node_id").alias("up"), F.col("up").alias("further"), F.col(added).alias("more"))
    joined = state.where("up is not null").join(known.hint("merge"), "up", "left")
    kept = [c for c in state.columns if c not in ("up", added)]
    moved = joined.select(*kept, F.col("further").alias("up"), (F.col(added) + F.coalesce("more", F.lit(0))).alias(added))
    return moved.unionByName(state.where("up is null"))


def interval_labels(nodes: DataFrame) -> DataFrame:
    """(node_id, parent, level, size, pre, last, post, cyclic) of each node of an adjacency list (node_id, parent_node_id).

    pre numbers the nodes from 0 in pre-order, siblings and roots by node_id; the
    subtree of a node, itself included, has the numbers pre to last, and size of
    them. post is the number in post-order. A node whose parent is blank or missing
    is a root at level 0; repeated node ids count once and null ids are left out.
    Nodes on a cycle or below one are cyclic and have no numbers.
    """
    named = nodes.where("node_id is not null").groupBy("node_id")
    parents = named.agg(F.max(F.nullif(F.trim("parent_node_id"), F.lit(""))).alias("parent"))
    parents = materialise(parents, "parents")
    ids = parents.select(F.col("node_id").alias("parent"), F.lit(True).alias("there"))
    named_parents = parents.where("parent is not null").join(ids.hint("merge"), "parent", "left")
    known = named_parents.select("node_id", F.when(F.col("there"), F.col("parent")).alias("parent")).unionByName(parents.where("parent is null"))
    state = known.select("node_id", "parent", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("level"), F.lit(1).cast("long").alias("size"))
    state = materialise(state, "labels")
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):  # a path has no more nodes than the forest; who still climbs then is on a cycle
        if state.where("up is not null").isEmpty():
            break
        gained = state.where("up is not null").groupBy(F.col("up").alias("node_id")).agg(F.sum("size").alias("gained"))
        grown = state.join(gained.hint("merge"), "node_id", "left")
        grown = grown.withColumn("size", F.col("size") + F.coalesce("gained", F.lit(0))).drop("gained")
        # sizes are those before this round's jump: what lies 2^k to 2^(k+1) below comes through who is 2^k below
        state = materialise(_jumped(grown.select("node_id", "parent", "up", "size", "level"), "level"), "labels")
    whole = state.where("up is null").select("node_id", "parent", "level", "size")
    # the way down: each node's own number is its parent's, 1, and the sizes of its earlier siblings
    steps = whole.join(_earlier_siblings(whole).hint("merge"), "node_id")
    walk = steps.select(
        "node_id", "parent", "level", "size", F.col("parent").alias("up"), (F.col("earlier") + F.col("parent").isNotNull().cast("long")).alias("pre")
    )
    walk = materialise(walk, "numbers")
    while not walk.where("up is not null").isEmpty():
        walk = materialise(_jumped(walk, "pre"), "numbers")
    last = F.col("pre") + F.col("size") - F.lit(1)
    numbered = walk.select("node_id", "parent", "level", "size", "pre", last.alias("last"), (last - F.col("level")).alias("post"), F.lit(False).alias("cyclic"))
    none = F.lit(None).cast("long")
    looped = state.where("up is not null").select(
        "node_id", "parent", *[none.alias(c) for c in ("level", "size", "pre", "last", "post")], F.lit(True).alias("cyclic")
    )
    return numbered.unionByName(looped)


def store_labels(labels: DataFrame, path: str) -> DataFrame:
    """Write labels sorted by pre, so that a subtree lies in few files and row groups; the stored table."""
    labels.repartitionByRange("pre").sortWithinPartitions("pre").write.mode("overwrite").parquet(path)
    return labels.sparkSession.read.schema(labels.schema).parquet(path)


def ranges_of(labels: DataFrame, roots: list[str]) -> list[tuple[int, int, int]]:
    """(pre, last, level) of a short list of nodes."""
    found = labels.where(F.col("node_id").isin(roots) & F.col("pre").isNotNull()).select("pre", "last", "level").distinct()
    return sorted(tuple(r) for r in found.collect())


def subtree_in_range(labels: DataFrame, roots: list[str]) -> DataFrame:
    """(node_id, level) of the nodes below a short list of roots, roots included; level counts from the nearest root.

    A scan with bounds on pre, which reach the files of a stored table; no join.
    """
    ranges = ranges_of(labels, roots)
    if not ranges:
        return labels.limit(0).select("node_id", F.col("level").cast("int").alias("level"))

    def inside(low: int, high: int) -> Column:
        return (F.col("pre") >= low) & (F.col("pre") <= high)

    outer: list[tuple[int, int]] = []
    for low, high, _ in ranges:  # by their beginning: a range lies in the one before or behind it
        if not outer or low > outer[-1][1]:
            outer.append((low, high))
    wanted = labels.where(reduce(lambda a, b: a | b, [inside(*r) for r in outer]))
    nearest = F.array_max(F.array(*[F.when(inside(a, b), F.lit(level)) for a, b, level in ranges]))
    return wanted.select("node_id", (F.col("level") - nearest).cast("int").alias("level"))


def descendants(labels: DataFrame) -> DataFrame:
    """(node_id, descendants) of every node that is not cyclic."""
    return labels.where("not cyclic").select("node_id", (F.col("last") - F.col("pre")).alias("descendants"))
