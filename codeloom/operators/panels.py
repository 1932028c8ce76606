"""What a change touches, as rows for a viewer: matching, stories, trees, groups and layout of a graph's nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators import search
from codeloom.operators.traverse import neighbourhood, suggest_tests
from codeloom.plans.fixpoint import components, cut


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")), "/"), -1)


def match_changed(g: PropertyGraph, ids: DataFrame, names: DataFrame, file: str) -> DataFrame:
    """The nodes of a change and by which tier they match: the first of four with any match counts.

    The tiers: ids(id); the names(name) in files whose path ends with the file's name; all nodes of
    such files; those whose file has just that name.
    """
    base = file.rsplit("/", 1)[-1]
    ends = F.coalesce(F.col("file_path").endswith(base), F.lit(False)) & F.lit(base != "")
    asked = g.nodes.join(ids.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left").join(names.select("name").distinct().withColumn("named", F.lit(True)), "name", "left")
    tier = F.when(F.col("asked"), 1).when(F.col("named") & F.col("file_path").endswith(base), 2).when(ends, 3).when((basename("file_path") == base) & F.lit(base != ""), 4)
    found = asked.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier").select("id", "tier")


def links_of(g: PropertyGraph, changed: DataFrame, edge_types: tuple[str, ...]) -> DataFrame:
    """changed id, direction ("out" or "in"), id at the other end: a row an edge of the types."""
    edges = g.edges.where(F.col("edge_type").isin(*edge_types))
    sides = []
    for direction, own, other in (("out", "source_id", "target_id"), ("in", "target_id", "source_id")):
        sides.append(edges.join(changed.select(F.col("id").alias(own)).distinct(), own).select(F.col(own).alias("changed"), F.lit(direction).alias("direction"), F.col(other).alias("id")))
    return sides[0].unionByName(sides[1])


def change_story(g: PropertyGraph, changed: DataFrame) -> DataFrame:
    """direction, id, name, label and file of the distinct nodes that the changed(id) call or are called by, changed ones left out."""
    around = links_of(g, changed, ("CALLS",)).select("direction", "id").distinct().join(changed.select("id"), "id", "left_anti")
    return around.join(g.nodes.select("id", "name", "label", "file_path"), "id").select("direction", "id", "name", "label", basename("file_path").alias("file"))


def removed_callers(g: PropertyGraph, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """name, id and exact of the callers that each removed(name) leaves behind: callers of the changed with an edge to a node of that name, else all callers of the changed."""
    callers = change_story(g, changed).where("direction = 'in'").select("id")
    targets = g.edges.join(callers.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("source_id", F.col("target_id").alias("id")).join(g.nodes.select("id", "name"), "id")
    exact = removed.select("name").distinct().join(targets.select("name", F.col("source_id").alias("id")).distinct(), "name").withColumn("exact", F.lit(True))
    rest = removed.select("name").distinct().join(exact, "name", "left_anti").crossJoin(callers).withColumn("exact", F.lit(False))  # removed names of one change
    return exact.unionByName(rest)


def impact_nodes(g: PropertyGraph, changed: DataFrame, expanded: str | None = None, cap: int = 60) -> DataFrame:
    """id, name, label and role ("changed", "caller" or "callee") of the changed(id) and their neighbours by calls; of the expanded node's by imports too.

    A node that both calls and is called is a caller. All changed stay; beyond the cap, the others are
    the first in the graph's order.
    """
    around = links_of(g, changed, ("CALLS",))
    if expanded is not None:
        around = around.unionByName(links_of(g, changed.where(F.col("id") == expanded), ("IMPORTS",)))
    role = F.when(F.max(F.col("direction") == "in"), "caller").otherwise("callee")
    others = around.groupBy("id").agg(role.alias("role")).join(changed.select("id"), "id", "left_anti")
    known = g.nodes.select("id", "name", "label", "ordinal")
    first = known.join(changed.select("id").distinct(), "id", "left_semi").withColumn("role", F.lit("changed"))
    ranked = known.join(others, "id").orderBy("ordinal", "id").limit(cap).withColumn("place", F.row_number().over(Window.orderBy("ordinal", "id")))  # at most cap rows
    room = first.agg((F.lit(cap) - F.count("*")).alias("room"))
    kept = ranked.join(F.broadcast(room)).where("place <= room").select("id", "name", "label", "ordinal", "role")
    return first.unionByName(kept).select("id", "name", "label", "role")


def links_among(g: PropertyGraph, ids: DataFrame, edge_types: tuple[str, ...] = ("CALLS", "IMPORTS")) -> DataFrame:
    """source_id, target_id and edge_type of the edges with both ends among ids(id)."""
    edges = g.edges.where(F.col("edge_type").isin(*edge_types))
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges.select("source_id", "target_id", "edge_type")


def change_chain(g: PropertyGraph, changed: DataFrame, max_depth: int = 2) -> DataFrame:
    """id and depth of what lies within the depth of any of the changed(id), whatever the edge and its direction."""
    seeds = changed.select(F.lit(0).alias("seed"), "id").distinct()
    return neighbourhood(g, seeds, max_depth).where("depth > 0").select("id", "depth")


def impact_tree(g: PropertyGraph, changed: DataFrame, shown: int = 10) -> DataFrame:
    """changed, direction, place, id and more: the first calls out of and into each changed(id), in the graph's order, with the number of those not shown.

    Files have no branch. Calls are counted by call site, as long as their other end is known.
    """
    own = changed.join(g.nodes.where("label <> 'File'").select("id"), "id", "left_semi")
    rows = links_of(g, own, ("CALLS",)).groupBy("changed", "direction", "id").agg(F.count("*").alias("sites")).join(g.nodes.select("id", "ordinal"), "id")
    side = Window.partitionBy("changed", "direction")
    order = side.orderBy("ordinal", "id")
    upto = F.sum("sites").over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = rows.withColumn("upto", upto).withColumn("total", F.sum("sites").over(side)).where(F.col("upto") - F.col("sites") < shown)
    places = F.explode(F.sequence(F.col("upto") - F.col("sites") + 1, F.least("upto", F.lit(shown).cast("long"))))
    return first.select("changed", "direction", places.alias("place"), "id", F.greatest(F.col("total") - shown, F.lit(0)).alias("more"))


def merged_tests(g: PropertyGraph, seeds: DataFrame, order: str, most: int = 5) -> DataFrame:
    """file_path, name and depth of the tests for the first of the seeds(seed, id, order); one row a test, the first seed's."""
    first = seeds.orderBy(order, "seed").limit(most)
    found = suggest_tests(g, first.select("seed", "id")).join(F.broadcast(first.select("seed", F.col(order).alias("at"))), "seed")
    return found.groupBy("file_path", "name").agg(F.min_by("depth", F.struct("at", "depth")).alias("depth"))


def palette(g: PropertyGraph, commands: DataFrame, text: str, nodes: int = 10, most: int = 8) -> DataFrame:
    """kind, place and name of what a text finds, letter case aside: nodes in the graph's order, then commands(name, place)."""
    order = lambda c: F.row_number().over(Window.orderBy(*c))  # noqa: E731  (over rows already limited)
    hits = search.search(g, text, nodes).select(F.lit("node").alias("kind"), order(["ordinal", "id"]).alias("place"), "name")
    found = commands.where(F.lower("name").contains(text.lower())).orderBy("place", "name").limit(most)
    return hits.unionByName(found.select(F.lit("command").alias("kind"), order(["place", "name"]).alias("place"), "name"))


def group_extent(nodes: DataFrame, group: str, x: str, y: str, z: str, least: int = 2) -> DataFrame:
    """group, n, centre (cx, cy, cz) and radius (1.4 times the farthest node's distance, 20 at least) of groups of at least two nodes; a missing coordinate is 0."""
    rows = nodes.select(F.coalesce(F.col(group), F.lit("other")).alias("group"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))))
    centre = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz")).where(F.col("n") >= least)
    far = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")))
    spread = rows.join(centre, "group").groupBy("group", "n", "cx", "cy", "cz").agg(F.max(F.sqrt(far)).alias("far"))
    return spread.select("group", "n", "cx", "cy", "cz", F.greatest(F.col("far") * 1.4, F.lit(20.0)).alias("radius"))


def tree_order(g: PropertyGraph) -> DataFrame:
    """parent, place, name and is_dir of all folders and files: within a folder, folders first, then by name."""
    parts = F.split(F.ltrim("file_path", F.lit("/")), "/")
    paths = g.nodes.where("file_path <> ''").select("file_path").distinct().select(parts.alias("p"))
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", F.lit(1), i - 1), "/").alias("parent"), F.get("p", i - 1).alias("name"), (i < F.size("p")).alias("is_dir")))).alias("s"))
    rows = steps.select("s.*").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_dir"), "name")))


def hues(groups: DataFrame, group: str) -> DataFrame:
    """group and hue: the golden angle times the group's place in sorted order, less full turns."""
    names = groups.select(F.col(group).alias("group")).distinct()
    return names.select("group", ((F.row_number().over(Window.orderBy(F.asc_nulls_first("group"))) - 1) * F.lit(137.508) % 360).alias("hue"))  # a row a group


def visible_counts(shown: PropertyGraph, everything: PropertyGraph, group: Column) -> DataFrame:
    """One row: nodes and edges shown, and the distinct groups of all nodes."""
    groups = everything.nodes.select(F.coalesce(group, F.lit("other")).alias("g")).agg(F.countDistinct("g").alias("groups"))
    return shown.counts().select(F.col("node_count").alias("nodes"), F.col("edge_count").alias("edges")).crossJoin(groups)


def with_hotspots(nodes: DataFrame, spots: DataFrame) -> DataFrame:
    """id and file (null without one) of the hotspot of each node: spots(file) whose path is the node's last two parts, or its whole path, or else the longest of those that end it.

    A path's suffixes are made once a file, so that the join is by equality.
    """
    path = F.coalesce("file_path", F.lit(""))
    files = nodes.where("file_path <> ''").select("file_path").distinct()
    ends = files.select("file_path", F.explode(F.sequence(F.lit(1), F.length("file_path"))).alias("at")).select("file_path", F.substr("file_path", F.col("at")).alias("file"), "at")
    two = F.array_join(F.slice(F.split(path, "/"), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)), F.lit(2)), "/")
    rank = F.when(F.col("file") == two, 0).when(F.col("at") == 1, 1).otherwise(2)
    best = ends.join(spots.select("file").distinct(), "file").groupBy("file_path").agg(F.min_by("file", F.struct(rank.alias("r"), F.col("at"))).alias("file"))
    return nodes.select("id", "file_path").join(best, "file_path", "left").select("id", "file")


def semantic_groups(g: PropertyGraph, items: DataFrame) -> DataFrame:
    """Groups of items(name, file, dir, kind) that share a file or whose names' first nodes are linked directly.

    group (its least file), label (the only file without its ending, else the commonest folder, the
    first by name on ties), size, files, added, modified and removed, the largest first. Files are the
    vertices: items of one file are one vertex from the start, so that a large file makes no pairs.
    """
    firsts = g.nodes.join(items.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min_by("id", F.struct("ordinal", "id")).alias("id"))
    at = cut(items.select("name", "file").distinct().join(firsts, "name").select("id", "file"))
    one = at.groupBy("id").agg(F.min("file").alias("file"))
    stars = lambda end: one.select(F.col("id").alias(end), F.col("file").alias(end[0]))
    pairs = g.edges.select("source_id", "target_id").distinct().join(stars("source_id"), "source_id").join(stars("target_id"), "target_id")
    linked = pairs.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    # all files of a name with any link hang together through its neighbour, so they link to the name's least file
    same = at.join(linked, "id", "left_semi").join(one.withColumnRenamed("file", "t"), "id").select(F.col("file").alias("source_id"), F.col("t").alias("target_id"))
    alone = items.select(F.col("file").alias("source_id"), F.col("file").alias("target_id")).distinct()
    group = components(pairs.select(F.col("s").alias("source_id"), F.col("t").alias("target_id")).unionByName(same).unionByName(alone))
    members = items.join(group.toDF("file", "group"), "file")
    folders = members.groupBy("group", "dir").agg(F.count("*").alias("n")).groupBy("group").agg(F.min_by("dir", F.struct(-F.col("n"), F.col("dir"))).alias("top"))
    counts = members.groupBy("group").agg(F.count("*").alias("size"), F.countDistinct("file").alias("files"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "removed")))
    label = F.when(F.col("files") == 1, F.regexp_replace("group", r"\.py", "")).otherwise(F.col("top"))
    return counts.join(folders, "group").select("group", label.alias("label"), "size", "files", "added", "modified", "removed").orderBy(F.desc("size"), "group")


def narrative(added: Column, modified: Column, removed: Column, risk: Column, affected: Column, integrated: Column) -> Column:
    """A sentence on a change, from lists of names; integrated is a list of (name, caller) of added ones that others call. Empty for no names."""
    some = lambda names, verb, shown, noun: F.when(F.size(names) == 0, F.lit(None)).when(F.size(names) <= shown, F.concat(F.lit(f"{verb} "), F.array_join(names, ", "))).otherwise(F.concat(F.lit(f"{verb} "), F.size(names), F.lit(f" {noun}")))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    first = F.get(integrated, F.lit(0))
    more = F.when(F.size(integrated) > 1, F.concat(F.lit(" (+"), F.size(integrated) - 1, F.lit(" more)"))).otherwise("")
    joined = F.when((F.size(listed(added)) > 0) & (F.coalesce(F.size(integrated), F.lit(0)) > 0), F.concat(F.lit("Added "), first["name"], F.lit(" and integrated into "), first["caller"], more))
    parts = F.concat_ws(". ", F.coalesce(joined, some(listed(added), "Added", 3, "new functions")), some(listed(modified), "Modified", 2, "functions"), some(listed(removed), "Removed", 2, "functions"))
    about = F.when(F.coalesce(risk, F.lit("LOW")) != "LOW", F.concat(F.lit(" ("), risk, F.lit(" risk — "), affected, F.lit(" in blast radius)"))).otherwise("")
    return F.when(parts == "", "").otherwise(F.concat(parts, F.lit("."), about))


def heat(changes: DataFrame, *lists: str) -> DataFrame:
    """name and n: how many entries of the lists of changed names each name has."""
    names = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists)))
    return changes.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
