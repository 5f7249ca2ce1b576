"""The listings that a catalogue browser asks for: one function for each.

Each returns one page of rows, at most ``limit`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import fields, urls
from shelflight.operators import filters, quality, tree

_SHOWN = ["name", "node_id", "depth", "slug", "na_valid", "child_count"]


def _matching(rows: DataFrame, test: Column, text: str) -> DataFrame:
    return rows.where(test) if text else rows


def capable(nodes: DataFrame, site: str, text: str = "", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Flat list of the nodes of a site that have the newest-first capability, by depth and name."""
    rows = nodes.where((F.col("site") == site) & (F.col("na_valid") == 1))
    rows = _matching(rows, filters.name_contains(F.col("name"), text), text).withColumn("child_count", F.lit(0).cast("long"))
    return rows.select(*_SHOWN).orderBy("depth", "name", "node_id").offset(offset).limit(filters.clamp(limit, 50, 200))


def site_roots(nodes: DataFrame, site: str) -> DataFrame:
    """The roots of a site with the number of all its nodes as child_count; one row for the whole site if it has no root."""
    own = nodes.where(F.col("site") == site)
    total = own.agg(F.count("*").alias("child_count"))  # one row
    roots = own.where("depth = 0").select("name", "node_id")
    whole = own.agg(F.count_if(F.col("depth") == 0).alias("n")).where("n = 0")
    stand_in = whole.select(F.lit("All Categories").alias("name"), F.lit("_root_").alias("node_id"))
    rows = roots.unionByName(stand_in).crossJoin(F.broadcast(total))
    nothing = {"slug": F.lit(None).cast("string"), "na_valid": F.lit(None).cast("int"), "depth": F.lit(0)}
    return rows.withColumns(nothing).select(*_SHOWN)


def tree_children(
    nodes: DataFrame, parent: str, site: str, text: str = "", limit: int | None = 50, offset: int = 0, paths: DataFrame | None = None
) -> DataFrame:
    """Children of a node with the number of their descendants as child_count, by name.

    ``root`` gives ``site_roots``. With ``text`` only children whose name holds it
    or is similar to it, the most similar first. ``paths`` is ``tree.paths`` of
    the nodes, where the caller has it.
    """
    if parent == "root":
        return site_roots(nodes, site)
    name = F.col("name")
    score = fields.similarity(name, F.lit(text))
    rows = nodes.where((F.col("parent_node_id") == parent) & (F.col("site") == site))
    rows = _matching(rows, filters.fuzzy_name(name, text), text)
    order = [F.desc(score), "name", "node_id"] if text else ["name", "node_id"]
    rows = rows.drop("child_count").orderBy(*order).offset(offset).limit(filters.clamp(limit, 50, 200))
    # at most 200 rows, so that each member of a path is asked whether it is one of them without a shuffle
    wanted = F.broadcast(rows.select(F.col("node_id").alias("above")).distinct())
    members = (tree.paths(nodes) if paths is None else paths).select("node_id", F.explode("path").alias("above"))
    counts = members.where("above <> node_id").join(wanted, "above").groupBy("above").agg(F.count("*").alias("child_count"))
    joined = rows.join(counts.hint("merge"), F.col("node_id") == F.col("above"), "left")
    return joined.withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("long"))).select(*_SHOWN).orderBy(*order)


def stored_children(nodes: DataFrame, parent: str, site: str = "", text: str = "") -> DataFrame:
    """Children of a node with their stored child counts, by name.

    ``root`` gives the roots of the site, or of all sites for ''; where there is
    none, the nodes of depth 1.
    """
    own = _matching(nodes, F.col("site") == site, site)
    found = filters.name_contains(F.col("name"), text)
    if parent == "root":
        # the least depth there is of 0 and 1, one row
        top = own.where("depth in (0, 1)").agg(F.min("depth").alias("top"))
        rows = own.crossJoin(F.broadcast(top)).where("depth = top")
        rows = rows.where(found | (F.col("depth") == 0)) if text else rows
    else:
        rows = _matching(own.where(F.col("parent_node_id") == parent), found, text)
    return rows.select("name", "node_id", "depth", "slug", "child_count").orderBy("name", "node_id")


_LISTED = ["name", "url", "node_id", "depth", "source", "explored"]


def listed_roots(nodes: DataFrame, text: str = "", limit: int = 2000, offset: int = 0) -> DataFrame:
    """Top entries without an id, with slug and the nodes below it: stored child counts plus rows of the nodes of that slug."""
    tops = nodes.where("depth = 1 and node_id is null")
    tops = _matching(tops, filters.name_contains(F.col("name"), text), text)
    slug = F.coalesce(F.nullif(F.regexp_extract("url", r"/gp/new-releases/([a-z][a-z0-9-]+)", 1), F.lit("")), F.lit(""))
    tops = tops.select(*_LISTED, slug.alias("slug"))
    below = nodes.where("node_id is not null and slug is not null").groupBy("slug")
    below = below.agg((F.sum("child_count") + F.count("*")).alias("child_count"))
    joined = tops.join(below, "slug", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("long")))
    return joined.select(*_LISTED, "slug", "child_count").orderBy("name", "url").offset(offset).limit(limit)


def listed(
    nodes: DataFrame, cache: DataFrame, flags: list[str], parent: str = "", text: str = "", depth: int | None = None,
    limit: int = 2000, offset: int = 0,
) -> DataFrame:
    """Nodes with an id, flags filled from the link cache and stored child counts.

    With ``parent`` its children, by name: a parent that is no number may also be
    a slug, whose nodes without a parent are found by their URL. Else all nodes,
    or those of a depth (5 is 5 and more), by depth and name.
    """
    own = nodes.where("node_id is not null")
    if parent:
        test = F.col("parent_node_id") == parent
        if not parent.isdigit():
            test = test | (filters.is_blank(F.col("parent_node_id")) & (urls.list_slug(F.col("url")) == parent))
        own = own.where(test)
    else:
        own = own.where(filters.depth_is(F.col("depth"), depth))
    own = _matching(own, filters.name_or_id(F.col("name"), F.col("node_id"), text), text)
    rows = quality.with_cache(own, cache, flags).select(*_LISTED, *flags, "child_count")
    return rows.orderBy(*([] if parent else ["depth"]), "name", "node_id").offset(offset).limit(limit)
