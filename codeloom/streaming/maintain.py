"""A graph kept up with its sources: a change parses the changed files and resolves anew only the files that it can concern."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom.graph import PropertyGraph
from codeloom.operators.build import build_graph, class_bases, edges_of, nodes_of, numbered, unnested
from codeloom.plans.fixpoint import cut
from codeloom.sources.pysource import parse

#: Changes after which the parts of the facts are written as one table again.
PARTS = 8
SYMBOL = ("id", "label", "name", "file_path", "parameter_count", "owner")


@dataclass(frozen=True)
class Kept:
    """The facts of all files and the graph built from them; parts counts the changes since the facts were last written whole."""

    facts: DataFrame
    graph: PropertyGraph
    root: str
    parts: int = 0


def keep(sources: DataFrame, root: str) -> Kept:
    facts = cut(parse(sources))
    return Kept(facts, build_graph(facts, root), root)


def last_part(text: str) -> Column:
    return F.element_at(F.split(F.substring_index(text, "(", 1), r"\."), -1)


def mentions(facts: DataFrame) -> DataFrame:
    """file_path and each name that a file's edges hang on: callees, bases, decorators and classes that are called."""
    calls = unnested(facts, "calls").select("file_path", F.col("callee").alias("name"))
    made = unnested(facts, "assignments").select("file_path", F.col("value_type").alias("name"))
    bases = unnested(facts, "classes").select("file_path", F.explode("bases").alias("t"))
    marks = [unnested(facts, kind).select("file_path", F.explode("decorators").alias("t")) for kind in ("functions", "classes")]
    named = bases.unionByName(marks[0]).unionByName(marks[1]).select("file_path", last_part("t").alias("name"))
    return calls.unionByName(made).unionByName(named).where("name IS NOT NULL").distinct()


def types_named(facts: DataFrame) -> DataFrame:
    """file_path and each class that a receiver in the file may be of."""
    assigned = unnested(facts, "assignments").select("file_path", F.explode(F.array("declared_type", "value_type")).alias("name"))
    given = unnested(facts, "functions").select("file_path", F.explode("parameter_types").alias("name"))
    own = unnested(facts, "classes").select("file_path", "name")
    return assigned.unionByName(given).unionByName(own).where("name IS NOT NULL").distinct()


def below(bases: DataFrame, start: DataFrame) -> DataFrame:
    """The class names of start(name) and of all classes under them, by bases(name, base)."""
    found = reached = cut(start.select("name").distinct())
    while not reached.isEmpty():
        reached = cut(bases.join(reached.select(F.col("name").alias("base")), "base").select("name").distinct().join(found, "name", "left_anti"))
        found = found.unionByName(reached)
    return found


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that only one of both has."""
    return a.subtract(b).unionByName(b.subtract(a))


def concerned(before: Kept, facts: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """file_path of the files whose edges a change of the files paths(file_path) may alter, those that changed included; facts and nodes are the new ones.

    A file is concerned if it mentions the name of a symbol that came, went or changed; if a receiver
    in it may be of a class whose bases changed, or of one under it; and if an import of it may lead
    to a file that came or went, which its last part tells. Only changed files' rows and sets of
    names are compared; of all others, the facts' names are met with these in joins.
    """
    changed = lambda df: df.join(paths, "file_path", "left_semi")
    symbols = lambda df: changed(df.where("label IN ('Function', 'Method', 'Class')")).select(*SYMBOL)
    names = cut(either(symbols(before.graph.nodes), symbols(nodes)).select("name").distinct())
    by_name = mentions(facts).join(names, "name", "left_semi").select("file_path")

    heritage = lambda df: unnested(changed(df), "classes").select("name", "bases")
    moved = cut(either(heritage(before.facts), heritage(facts)).select("name").distinct())
    by_type = facts.select("file_path").limit(0)
    if not moved.isEmpty():
        bases = cut(class_bases(before.facts).unionByName(class_bases(facts)).distinct())
        by_type = types_named(facts).join(below(bases, moved), "name", "left_semi").select("file_path")

    there = lambda df: changed(df).select("file_path")
    stem = F.element_at(F.split(F.regexp_replace("file_path", r"(/__init__)?\.py$", ""), "/"), -1)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.length(stem), F.lit(1))), lambda i: F.substr(stem, i))
    packages = F.when(F.col("file_path").endswith("/__init__.py"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    keys = cut(either(there(before.facts), there(facts)).select(F.explode(F.concat(ends, packages)).alias("key")).distinct())
    asked = unnested(facts, "imports").select("file_path", F.element_at(F.split(F.coalesce("module", F.lit("")), r"\."), -1).alias("key"))
    by_import = asked.join(keys, "key", "left_semi").select("file_path")
    return cut(paths.unionByName(by_name).unionByName(by_type).unionByName(by_import).distinct())


def applied(kept: Kept, changes: DataFrame) -> Kept:
    """What is kept after changes(file_path, event_type, source): the same nodes and edges as a whole build's, but for the numbers of ordinal.

    Only the changed files' sources are parsed. The edges of the files that are concerned (see
    there) are resolved anew against all nodes, and all others stay.
    """
    paths = cut(changes.select("file_path").distinct())
    new = cut(parse(changes.where("event_type <> 'deleted'").dropDuplicates(["file_path"])))
    facts = kept.facts.join(paths, "file_path", "left_anti").unionByName(new)
    parts = kept.parts + 1
    if parts >= PARTS:
        facts, parts = cut(facts), 0
    nodes = kept.graph.nodes.join(paths, "file_path", "left_anti")
    nodes = cut(numbered(nodes.unionByName(nodes_of(new).select(*nodes.columns))))
    files = concerned(kept, facts, nodes, paths)
    gone = cut(kept.graph.nodes.join(files, "file_path", "left_semi").select(F.col("id").alias("owner")))
    owner = F.when(F.col("edge_type") == "DECORATES", F.col("target_id")).otherwise(F.col("source_id"))
    rest = kept.graph.edges.withColumn("owner", owner).join(gone, "owner", "left_anti").drop("owner")
    mine = cut(facts.join(files, "file_path", "left_semi"))
    edges = cut(rest.unionByName(edges_of(mine, nodes, kept.root, facts).select(*rest.columns)))
    return Kept(facts, PropertyGraph(nodes, edges), kept.root, parts)


@F.pandas_udf(StringType())
def read_source(paths: pd.Series) -> pd.Series:
    """The files' sources as they are now; null for one that is gone."""

    def one(path: str) -> str | None:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    return paths.map(one)


class Follower:
    """A listener for streaming.files.watch: keeps a graph up with the batches of changes. A file that is gone by the time it is read counts as deleted."""

    def __init__(self, kept: Kept):
        self.kept = kept

    def __call__(self, batch: DataFrame, number: int) -> None:
        read = cut(batch.select("file_path", "event_type").withColumn("source", F.when(F.col("event_type") != "deleted", read_source("file_path"))))
        rows = read.withColumn("event_type", F.when(F.col("source").isNull(), "deleted").otherwise(F.col("event_type")))
        if not rows.isEmpty():
            self.kept = applied(self.kept, rows)
