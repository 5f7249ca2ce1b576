"""Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups.

Rows become leaves, numbered inside their group. On each level eight consecutive
nodes are a run; lag and lead columns of fixed offsets, masked by a node's slot in
its run and by the run's length, are its siblings, and the rows of slot 0 hash
their run into the next level. Each level is written once. A leaf's way to the
root is then a join with its parents from level to level, so a row carries the
siblings of its own way only, and no level, group or run is ever gathered: a run
has eight nodes, however many rows a group holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.llm.common import join_per_key, materialise

#: Nodes of a run.
FAN = 8
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def digest(text: Column) -> Column:
    """SHA-256 as lowercase hexadecimal digits."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and the value as text; a null as ``-``."""
    texts = [v.cast("string") for v in values]
    sized = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return digest(F.concat(*[F.coalesce(s, F.lit("-")) for s in sized]))


def group_key(group: Column) -> Column:
    """A text for each group that sorts as the groups do: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``rows`` with k, their place from 0 in their ``tree`` by ``order``, and n, the tree's size; the greatest n.

    Rows are sorted by ranges and numbered inside their range; a range starts where
    the ranges before it end, and a tree where its first row lies.
    """
    by = [F.col("tree"), *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialise(ranged.withColumn("turn", F.monotonically_increasing_id()), name)
    part = F.shiftright("turn", _ROW_BITS)
    # a row for each partition
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), f"{name}-parts")
    within = F.col("turn").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counted = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    counted = counted.withColumn("place", F.col("start") + within).drop("part", "start", "turn")
    trees = materialise(counted.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n")), f"{name}-trees")
    most = trees.agg(F.max("n")).first()[0] or 0
    numbered = join_per_key(counted, trees, "tree")
    return numbered.withColumn("k", F.col("place") - F.col("first")).drop("place", "first"), most


def _siblings(level: DataFrame) -> DataFrame:
    """``level`` (tree, k, n, hash, ...) with run, slot, and the joined digests of the run before and behind each node.

    The window of a run is a partition of its own: a tree of any size is spread by its runs.
    """
    run = F.floor(F.col("k") / F.lit(FAN)).cast("long")
    placed = level.withColumn("run", run).withColumn("slot", F.col("k") - F.col("run") * F.lit(FAN))
    length = F.least(F.lit(FAN).cast("long"), F.col("n") - F.col("run") * F.lit(FAN))
    within = Window.partitionBy("tree", "run").orderBy("slot")
    lags = [F.when(F.col("slot") >= j, F.lag("hash", j).over(within)) for j in range(FAN - 1, 0, -1)]
    leads = [F.when(F.col("slot") + j < length, F.lead("hash", j).over(within)) for j in range(1, FAN)]
    return placed.select("*", F.concat_ws("", *lags).alias("before"), F.concat_ws("", *leads).alias("behind"))


def _parents(level: DataFrame) -> DataFrame:
    """The next level of all trees that still have several nodes: the first node of each run hashes it."""
    firsts = _siblings(level.where("n > 1").select("tree", "k", "n", "hash")).where("slot = 0")
    size = F.ceil(F.col("n") / F.lit(FAN)).cast("long")
    return firsts.select("tree", F.col("run").alias("k"), size.alias("n"), digest(F.concat("hash", "behind")).alias("hash"))


def _levels(leaves: DataFrame, most: int, name: str) -> list[DataFrame]:
    """All levels of a forest whose largest tree has ``most`` leaves, each written but the first."""
    levels = [leaves]
    while most > 1:
        levels.append(materialise(_parents(levels[-1]), name))
        most = -(-most // FAN)
    return levels


_WAY = "way array<struct<before: string, behind: string>>"


def _ways(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """Leaves with ``way``, the siblings on each level up to the root, and the columns of ``tops``.

    ``tops`` has a row for each tree: tree, way (from the tree's own root on) and more.
    """
    more = [c for c in tops.columns if c not in ("tree", "way")]
    above = None
    for depth, level in reversed(list(enumerate(levels))):
        own = keep if depth == 0 else []
        ended = level.where("n = 1").join(tops.hint("merge"), "tree").select("tree", "k", "hash", "way", *more, *own)
        if above is None:
            above = ended
            continue
        step = _siblings(level.where("n > 1"))
        upper = above.select("tree", F.col("k").alias("run"), F.col("way").alias("upper"), *more)
        joined = step.join(upper.hint("merge"), ["tree", "run"])
        way = F.concat(F.array(F.struct("before", "behind")), "upper").alias("way")
        above = joined.select("tree", "k", "hash", way, *more, *own).unionByName(ended)
    return above


def prove(
    df: DataFrame, columns: list[str], group: str, order: str, claimed: dict[str, Column] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: ``order``, ``keep``, leaf, subroot, root, proof, proof_sha256, folded_root and verified.

    leaf is the digest of ``columns``, subroot that of the row's ``group`` and root
    that of all groups in their order (null first, then bytewise). proof holds the
    siblings of each level up to the root, as joined hexadecimal digits before and
    behind the node; proof_sha256 is the digest of all of them in order. ``claimed``
    gives other values for some columns, over the columns of ``df``: folded_root is
    the root that those values and the true siblings lead to, and verified says
    whether it is the true one.

    Leaves of a group ascend by ``order``, nulls first; rows with equal values go by
    their digests, so rows that repeat exactly have proofs of their own, dealt in
    any order. Null and empty values differ. A table of one row has its leaf as its
    root and the digest of the empty text as proof_sha256; an empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    claimed = claimed or {}
    values = {c: F.col(f"`{c}`") for c in columns}
    own = {f"keep_{i}": c for i, c in enumerate((order, *keep))}
    rows = df.select(
        group_key(F.col(f"`{group}`")).alias("tree"),
        leaf_digest(list(values.values())).alias("hash"),
        leaf_digest([claimed.get(c, v) for c, v in values.items()]).alias("claim"),
        *[F.col(f"`{c}`").alias(a) for a, c in own.items()],
    )
    # texts are read and hashed once; what follows moves digests only
    rows = materialise(rows, "merkle-leaves")
    first = F.col("keep_0").asc_nulls_first()
    leaves, most = _numbered(rows, [first, F.col("hash")], "merkle")
    levels = _levels(leaves, most, "merkle-level")
    ended = reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", "hash") for level in levels])
    # the groups' roots are the leaves of a tree of their own
    roots = ended.select(F.lit("").alias("tree"), "hash", F.col("tree").alias("group"))
    upper, groups = _numbered(roots, [F.col("group")], "merkle-groups")
    upper_levels = _levels(upper, groups, "merkle-top")
    last = upper_levels[-1].where("n = 1").select(
        "tree", F.col("hash").alias("root"), F.from_json(F.lit('{"way": []}'), _WAY)["way"].alias("way")
    )
    tops = _ways(upper_levels, last, ["group"])
    tops = materialise(tops.select(F.col("group").alias("tree"), "way", F.col("hash").alias("subroot"), "root"), "merkle-tops")
    proven = _ways(levels, tops, ["claim", *own])
    siblings = F.array_join(F.transform("way", lambda s: F.concat(s["before"], s["behind"])), "")
    folded = F.aggregate("way", F.col("claim"), lambda h, s: digest(F.concat(s["before"], h, s["behind"])))
    out = proven.select(
        *[F.col(a).alias(c) for a, c in own.items()],
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.col("way").alias("proof"),
        digest(siblings).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
