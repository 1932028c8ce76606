"""Execution flows from likely entry points, and names for groups of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph, first_named
from codeloom.operators.traverse import entry_scores
from codeloom.plans.fixpoint import cut


def trace_paths(entries: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    """The paths from entries(entry, rank) over steps(source_id, target_id, k), each to where it ends: entry, rank, path, turns.

    A path ends at max_depth steps or where every step leads back into it; turns are the steps'
    places k, which give the order of a breadth-first search.
    """
    live = entries.select("entry", "rank", F.array("entry").alias("path"), F.array().cast("array<int>").alias("turns"))
    ended = None
    for depth in range(max_depth + 1):
        node = F.element_at("path", -1)
        if depth == max_depth:
            stop = live
        else:
            onward = live.withColumn("source_id", node).join(steps, "source_id").where(~F.array_contains("path", F.col("target_id")))
            following = cut(onward.select("entry", "rank", F.col("path").alias("before"), F.col("turns").alias("earlier"), F.array_append("path", F.col("target_id")).alias("path"), F.array_append("turns", F.col("k")).alias("turns")))
            gone = following.select("entry", F.col("before").alias("path"), F.col("earlier").alias("turns")).distinct()
            stop = live.join(gone, ["entry", "path", "turns"], "left_anti").select("entry", "rank", "path", "turns")
        ended = stop if ended is None else ended.unionByName(stop)
        if depth == max_depth or following.isEmpty():
            return ended
        live = following.select("entry", "rank", "path", "turns")


def execution_flows(g: PropertyGraph, max_depth: int = 10, max_branching: int = 4, min_steps: int = 3, max_processes: int = 75) -> DataFrame:
    """The first max_processes flows: id, entry, terminal, step_count, path.

    Entries go by falling score (see entry_scores), then ordinal and id, in blocks that double, until there are
    flows enough; so only a few entries' paths are followed. At each node the max_branching most
    confident call edges count (ties by edge id), before those that lead back are left out.
    """
    order = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "id")
    ranked = g.edges.where("edge_type = 'CALLS'").select("source_id", "target_id", "confidence", "id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_branching)
    steps = cut(ranked.select("source_id", "target_id", "k"))
    scores = entry_scores(g).where("score > 0").join(g.nodes.select("id", "ordinal"), "id")
    rank = F.struct((-F.col("score")).alias("s"), "ordinal", "id")
    candidates = cut(scores.select(F.col("id").alias("entry"), rank.alias("rank")))
    block, start, found, n = 4 * max_processes, 0, None, 0
    while True:
        entries = cut(candidates.orderBy("rank").offset(start).limit(block))
        if found is not None and entries.isEmpty():
            break
        paths = trace_paths(entries, steps, max_depth).where(F.size("path") >= min_steps)
        flows = cut(paths.groupBy("entry", "rank", "path").agg(F.min("turns").alias("turns")))
        found = flows if found is None else found.unionByName(flows)
        n += flows.count()
        if n >= max_processes:
            break
        start, block = start + block, block * 2
    top = found.orderBy("rank", F.size("path"), "turns").limit(max_processes)
    return top.select(F.substring(F.md5(F.concat_ws(">", "path")), 1, 16).alias("id"), "entry", F.element_at("path", -1).alias("terminal"), F.size("path").alias("step_count"), "path")


def flows_from(g: PropertyGraph, entry_name: str, **limits) -> DataFrame:
    """Of the flows with one step or more, after their cap, those whose entry is the first node of a name."""
    named = first_named(g.nodes, entry_name).select(F.col("id").alias("entry"))
    return execution_flows(g, **{"min_steps": 1, **limits}).join(named, "entry", "left_semi")


def group_labels(members: DataFrame) -> DataFrame:
    """component and label of members(component, file_path, ordinal): the last folder or file that begins all paths, or the stem of the first member's file.

    What begins the least and the greatest path, compared segment by segment, begins all.
    """
    parts = F.split("file_path", "/")
    ends = members.where("file_path IS NOT NULL").groupBy("component").agg(F.min(parts).alias("a"), F.max(parts).alias("b"), F.min_by("file_path", F.struct("ordinal", "file_path")).alias("first"))
    equal = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    length = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)) - 1, F.size("a")).cast("int")
    shared = F.filter(F.slice("a", F.lit(1), length), lambda x: x != "")
    stem = F.regexp_replace(F.element_at(F.split("first", "/"), -1), r"\.[^.]*$", "")
    return ends.select("component", F.when(F.size(shared) > 0, F.try_element_at(shared, F.lit(-1))).otherwise(stem).alias("label"))
