"""Category trees kept as adjacency lists (node_id, parent_node_id, ...).

Paths double in length each round, so a tree of depth d takes log d joins. Other
walks join one level at a time and stop at nodes seen before, so cycles end; no
walk stops at a fixed depth unless it is asked to. Descendants are counted by
exploding each node's ancestors: linear in nodes times depth, with no self join
on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.functions import fields, urls
from shelflight.functions.urls import slug_name
from shelflight.operators.filters import is_blank
from shelflight.sources.tables import first_rows, materialise


def child_counts(nodes: DataFrame) -> DataFrame:
    """``nodes`` with child_count, the number of rows that name the node as parent; 0 for none."""
    counts = (
        nodes.where(~is_blank(F.col("parent_node_id")))
        .groupBy("parent_node_id")
        .agg(F.count("*").alias("child_count"))
        .withColumnRenamed("parent_node_id", "__parent")
    )
    plain = nodes.drop("child_count")
    return plain.join(counts, plain["node_id"] == F.col("__parent"), "left").drop("__parent").withColumn(
        "child_count", F.coalesce("child_count", F.lit(0).cast("long"))
    )


def paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path, labels, cyclic) with the ancestors of each node, root first, itself last.

    A node whose parent is blank or missing is a root. Nodes on a cycle or below
    one have cyclic true and the part of the path up to the first node that comes
    twice. Repeated node ids count once. Each round a node takes over what its
    furthest known ancestor knows, on a table that is written out each time.
    """
    parent = nodes.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.max("parent_node_id").alias("parent"))
    walk = materialise(
        parent.select(
            "node_id", F.array("node_id").alias("up"), F.nullif(F.trim("parent"), F.lit("")).alias("next"), F.lit(False).alias("cyclic")
        ),
        "paths",
    )
    while not walk.where("next is not null").isEmpty():
        known = walk.select(F.col("node_id").alias("at"), F.col("up").alias("more"), F.col("next").alias("further"), F.col("cyclic").alias("loops"))
        step = walk.where("next is not null").join(known, F.col("next") == F.col("at"), "left")
        # from the first node that comes twice on all have been met before
        whole = F.concat("up", F.coalesce("more", F.array().cast("array<string>")))
        step = step.select("node_id", F.array_distinct(whole).alias("up"), "further", "loops", F.size(whole).alias("n"))
        loop = (F.size("up") < F.col("n")) | F.coalesce("loops", F.lit(False))
        step = step.select("node_id", "up", F.when(~loop, F.col("further")).alias("next"), loop.alias("cyclic"))
        walk = materialise(walk.where("next is null").unionByName(step), "paths")
    path = F.reverse("up")
    return walk.select("node_id", path.alias("path"), F.array_join(F.transform(path, fields.path_label), ".").alias("labels"), "cyclic")


def descendant_counts(path_table: DataFrame) -> DataFrame:
    """(node_id, descendants) for every node of a path table, itself not counted."""
    members = path_table.select(F.explode("path").alias("above"), "node_id")
    return members.groupBy(F.col("above").alias("node_id")).agg(F.count_if(F.col("above") != F.col("node_id")).alias("descendants"))


def subtree(nodes: DataFrame, roots: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(node_id, level) of the nodes below ``roots`` (node_id), roots included at level 0.

    A node reached by several roots has the least level. Works level by level,
    to the deepest or to ``most_levels``; a node that was reached is not visited
    again. What was found is written as one table every eight levels.
    """
    edges = nodes.where(~is_blank(F.col("parent_node_id"))).select("node_id", F.col("parent_node_id").alias("parent"))
    edges = materialise(edges.distinct(), "edges")
    first = nodes.join(roots.select("node_id").distinct(), "node_id", "left_semi").select("node_id").distinct()
    found = frontier = materialise(first.withColumn("level", F.lit(0)), "subtree")
    level = 0
    while level != most_levels:
        level += 1
        below = edges.join(frontier.select(F.col("node_id").alias("parent")), "parent", "left_semi").select("node_id").distinct()
        frontier = materialise(below.join(found, "node_id", "left_anti").withColumn("level", F.lit(level)), "subtree")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if level % 8 == 0:
            found = materialise(found, "subtree")
    return found


def expanded(nodes: DataFrame, roots: DataFrame | None = None, depths: list[int] | None = None) -> DataFrame:
    """The rows of ``nodes`` in the subtrees of ``roots`` (all below depth 0 for None), of those the given depths if there are any."""
    rows = nodes.where("depth > 0") if roots is None else nodes.join(subtree(nodes, roots).select("node_id"), "node_id", "left_semi")
    return rows.where(F.col("depth").isin(*depths)) if depths else rows


def subtree_by_path(path_table: DataFrame, roots: list[str]) -> DataFrame:
    """Nodes whose path holds any of a few roots: one scan, no join."""
    return path_table.where(F.arrays_overlap("path", F.array(*[F.lit(r) for r in roots])))


#: Prefixes and ids of roots up to which they are sent to the tasks, and copies of each beyond.
ROOTS_SENT, ROOT_COPIES = 100_000, 64


def subtree_by_url(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes whose URL begins with a root's URL, or whose id is a root's.

    ``roots`` (node_id, url) is a short list given by the caller; the prefix
    match goes by the URL's own prefixes, so it is an equi join.
    """
    parts = F.split(F.col("url"), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))
    )
    keyed = nodes.withColumn("__prefix", F.explode(F.array_distinct(F.concat(prefixes, F.array(F.concat(F.lit("id:"), "node_id"))))))
    wanted = roots.select(urls.normalize_url(F.col("url")).alias("__prefix")).unionByName(
        roots.select(F.concat(F.lit("id:"), "node_id").alias("__prefix"))
    )
    wanted = wanted.distinct()
    if wanted.limit(ROOTS_SENT + 1).count() <= ROOTS_SENT:
        # a prefix that most nodes share stays where its rows lie
        return keyed.join(F.broadcast(wanted), "__prefix", "left_semi").drop("__prefix").distinct()
    # more roots are dealt out in copies, so that no prefix is one task's alone
    copies = wanted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(ROOT_COPIES - 1))))
    dealt = keyed.withColumn("__part", F.pmod(F.xxhash64("node_id", "url"), F.lit(ROOT_COPIES)).cast("int"))
    return dealt.join(copies.hint("merge"), ["__prefix", "__part"], "left_semi").select(*nodes.columns).distinct()


def children(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where(F.col("parent_node_id") == parent)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that no row names as parent."""
    parents = nodes.where(~is_blank(F.col("parent_node_id"))).select(F.col("parent_node_id").alias("node_id")).distinct()
    return nodes.join(parents, "node_id", "left_anti")


def unseen(found: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``found`` whose url and node_id are both unknown, the first of each by ``order``."""
    fresh = found.join(known.select("url").distinct(), "url", "left_anti")
    fresh = fresh.join(known.select("node_id").distinct(), "node_id", "left_anti").select(*found.columns)
    for key in ("url", "node_id"):
        # rows without a key are no duplicates of each other
        first = first_rows(fresh.where(F.col(key).isNotNull()), [key], order)
        fresh = first.unionByName(fresh.where(F.col(key).isNull()))
    return fresh


def placed_below(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with depth one below its parent's (1 if unknown) and the parent's slug ('' if unknown)."""
    parents = known.groupBy("node_id").agg(F.min("depth").alias("__depth"), F.min("slug").alias("__slug"))
    parents = parents.withColumnRenamed("node_id", "__id")
    return found.drop("depth", "slug").join(parents, F.col("parent_node_id") == F.col("__id"), "left").select(
        *[F.col(c) for c in found.columns if c not in ("depth", "slug")],
        F.coalesce(F.col("__depth") + 1, F.lit(1)).alias("depth"),
        F.coalesce("__slug", F.lit("")).alias("slug"),
    )


def site_totals(nodes: DataFrame) -> DataFrame:
    """The roots of each site with child_count, the number of all nodes of the site."""
    totals = nodes.groupBy("site").agg(F.count("*").alias("child_count"))
    return nodes.where("depth = 0").drop("child_count").join(totals, "site")


def root_rows(nodes: DataFrame) -> DataFrame:
    """Entry rows of each site: its roots at depth 0, else a row for each parent of depth-1 rows, else one synthetic row."""
    first = nodes.where("depth = 0").select("site", "node_id", "name", F.lit(1).alias("choice"))
    second = (
        nodes.where((F.col("depth") == 1) & ~is_blank(F.col("parent_node_id")))
        .select("site", F.col("parent_node_id").alias("node_id"), F.col("parent_node_id").alias("name"), F.lit(2).alias("choice"))
        .distinct()
    )
    third = nodes.select("site", F.lit("").alias("node_id"), F.col("site").alias("name"), F.lit(3).alias("choice")).distinct()
    every = first.unionByName(second).unionByName(third)
    best = every.groupBy("site").agg(F.min("choice").alias("best"))
    return every.join(best, "site").where("choice = best").drop("best")


def top_level(nodes: DataFrame) -> DataFrame:
    """(slug, name, child_count, discovered) sorted by name.

    The depth-1 rows, one per slug with the least name, and slugs that occur in
    the URLs of deeper rows only, named after themselves. child_count is the
    number of deeper rows with the slug in their URL.
    """
    top = (F.col("depth") == 1) & (F.col("slug") != "")
    deep = F.col("depth") > 1
    keyed = nodes.where(top | deep).select(
        F.when(top, F.col("slug")).otherwise(urls.chart_slug(F.col("url"))).alias("slug"),
        F.when(top, F.col("name")).alias("name"),
        top.alias("top"),
    )
    counted = keyed.where("slug is not null").groupBy("slug").agg(
        F.min("name").alias("name"), F.max("top").alias("listed"), F.count_if(~F.col("top")).alias("child_count")
    )
    shown = F.when(F.col("listed"), F.col("name")).otherwise(slug_name(F.col("slug")))
    return counted.select(
        "slug", shown.alias("name"), "child_count", F.when(F.col("listed"), 0).otherwise(1).alias("discovered")
    ).orderBy("name", "slug")


def chart_targets(nodes: DataFrame, lists: DataFrame, domain: Column) -> DataFrame:
    """A row for each node and list with the URL of the list's page; ``lists`` is the short table of list types."""
    return nodes.crossJoin(F.broadcast(lists.select("list_type"))).select(
        "node_id", "list_type", urls.chart_url(domain, F.col("list_type"), F.col("slug"), F.col("node_id")).alias("url")
    )


def edges_of_crumbs(crumbs: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, pos, node_id, name, parent_node_id): unknown crumbs with the parent they attach to.

    ``crumbs`` has page_id, pos, node_id, name. Once a known node has gone before
    in a page's crumbs, each unknown one attaches to its predecessor; an unknown
    one without a known ancestor is dropped. Of a node found on several pages the
    first by (page_id, pos) stays.
    """
    marked = crumbs.join(known.select("node_id", F.lit(1).alias("known")).distinct().hint("merge"), "node_id", "left")
    placed = marked.selectExpr(
        "page_id",
        "pos",
        "node_id",
        "name",
        "known",
        "lag(node_id) over (partition by page_id order by pos) as parent_node_id",
        """max(known) over (partition by page_id order by pos
           rows between unbounded preceding and 1 preceding) as rooted""",
    ).where("known is null and rooted = 1")
    first = F.expr("row_number() over (partition by node_id order by page_id, pos)")
    return placed.withColumn("first", first).where("first = 1").select("page_id", "pos", "node_id", "name", "parent_node_id")


def fill_from_crumbs(crumbs: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes that breadcrumbs add to ``known`` (node_id, depth, slug, url), with depth, slug and URL.

    Rounds go on while a page's crumbs attach below nodes that another page added.
    """
    # crumbs often come from pages: they are read once, not in each round
    crumbs = materialise(crumbs.select("page_id", "pos", "node_id", "name"), "crumbs-read")
    known = known.select("node_id", F.col("depth").cast("int").alias("depth"), "slug")
    added = None
    while True:
        new = edges_of_crumbs(crumbs, known)
        step = materialise(new, "crumbs")
        if step.isEmpty():
            break
        # depth follows the chain inside the round: one level per pass
        placed = step.select("page_id", "pos", "node_id", "name", "parent_node_id")
        fresh = materialise(placed_below(placed.join(known, F.col("parent_node_id") == known["node_id"], "left_semi"), known), "crumbs")
        if fresh.isEmpty():
            break
        added = fresh if added is None else added.unionByName(fresh)
        known = known.unionByName(fresh.select("node_id", "depth", "slug"))
    if added is None:
        added = placed_below(edges_of_crumbs(crumbs.limit(0), known), known)
    return added.withColumn("source", F.lit("breadcrumb"))


def grow(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """Breadth-first growth over captured pages.

    ``edges`` (parent_url, name, url, node_id, slug) are the children found on
    captured pages, ``roots`` (url, node_id, name, slug) the start. Returns every
    node with its depth and parent_node_id; a node is placed where it is met
    first, ties going to the least parent url. Edges are extracted once; each
    level is one join and two anti joins. The growth ends where nothing new is
    found, or at ``most_depth``.
    """
    edges = materialise(edges, "grown-edges")
    known = materialise(roots.select("url", "node_id", "name", "slug").withColumns({"depth": F.lit(0), "parent_node_id": F.lit(None).cast("string")}), "grown")
    frontier = known
    depth = 0
    while depth != most_depth:
        depth += 1
        parents = frontier.select(F.col("url").alias("parent_url"), F.col("node_id").alias("parent_node_id"))
        found = edges.join(parents, "parent_url").withColumn("depth", F.lit(depth))
        fresh = unseen(found, known, ["parent_url", "url", "name"])
        frontier = materialise(fresh.select("url", "node_id", "name", "slug", "depth", "parent_node_id"), "grown")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % 8 == 0:
            known = materialise(known, "grown")
    return known


def search_fuzzy(nodes: DataFrame, text: str, least: float = 0.3) -> DataFrame:
    """Nodes whose name holds a text or is similar to it, with similarity, the most similar first.

    Candidates share a trigram with the text or hold it, so the similarity is
    worked out for those only.
    """
    score = fields.similarity(F.col("name"), F.lit(text))
    contains = F.lower("name").contains(text.lower())
    near = F.arrays_overlap(fields.trigrams(F.col("name")), fields.trigrams(F.lit(text)))
    scored = nodes.where(contains | near).withColumn("similarity", score)
    return scored.where(contains | (F.col("similarity") >= least)).orderBy(F.desc("similarity"), "name", "node_id")
