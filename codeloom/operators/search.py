"""Structured queries over a property graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph, first_named

SYMBOLS = ("Function", "Method", "Class")


def neighbours_of(g: PropertyGraph, name: str, edge_type: str, side: str, labels: tuple[str, ...] = SYMBOLS) -> DataFrame:
    """Nodes at the other end of the edges of the first node of that name; one row an edge, edges without that node dropped.

    side is the end that the named node has: "target" gives callers or subclasses, "source" callees.
    The named node is one row, so that side is broadcast whatever the graph's size.
    """
    other = "source" if side == "target" else "target"
    seed = first_named(g.nodes, name, labels).select(F.col("id").alias(f"{side}_id"))
    hit = g.edges_by(f"{side}_id").where(F.col("edge_type") == edge_type).join(F.broadcast(seed), f"{side}_id").select(F.col(f"{other}_id").alias("id"), "line")
    return hit.join(g.nodes, "id").select("id", "label", "name", "file_path", "line")


def callers_of(g: PropertyGraph, name: str) -> DataFrame:
    return neighbours_of(g, name, "CALLS", "target")


def callees_of(g: PropertyGraph, name: str) -> DataFrame:
    return neighbours_of(g, name, "CALLS", "source")


def subclasses_of(g: PropertyGraph, name: str) -> DataFrame:
    return neighbours_of(g, name, "EXTENDS", "target", ("Class",))


def implementations_of(g: PropertyGraph, name: str) -> DataFrame:
    return g.by_label("Method").where(F.col("name") == name)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of *, ?, [seq] and [!seq]; an unclosed bracket is a plain character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + pattern[i + 1 : i + 2].count("!")) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return f"(?s)\\A{''.join(out)}\\z"


def by_pattern(g: PropertyGraph, pattern: str) -> DataFrame:
    return g.nodes.where(F.col("name").rlike(glob_regex(pattern)))


def by_decorator(g: PropertyGraph, decorator: str) -> DataFrame:
    return g.nodes.where(F.array_contains("decorators", decorator))


def search(g: PropertyGraph, text: str, limit: int = 20) -> DataFrame:
    """The first nodes whose name has the text, letter case aside; none for an empty text."""
    hit = F.lower("name").contains(text.lower()) if text else F.lit(False)
    return g.nodes.where(hit).orderBy("ordinal").limit(limit)


def keyword_search(g: PropertyGraph, text: str) -> DataFrame:
    """All symbols and processes whose name has the text; an empty text matches all."""
    return g.nodes.where(F.col("label").isin(*SYMBOLS, "Process") & F.lower("name").contains(text.lower()))


def context(g: PropertyGraph, name: str, keep_dangling: bool = True) -> DataFrame:
    """Edges of the first node of the name, in and out, with the node at the other end; a missing one gives its id as name."""
    seed = F.broadcast(first_named(g.nodes, name).select(F.col("id").alias("seed")))
    sides = []
    for direction, own, other in (("in", "target_id", "source_id"), ("out", "source_id", "target_id")):
        sides.append(g.edges_by(own).join(seed, F.col(own) == F.col("seed")).select(F.lit(direction).alias("direction"), "edge_type", "line", F.col(other).alias("id")))
    found = sides[0].unionByName(sides[1])
    joined = found.join(g.nodes.select("id", "name", "label"), "id", "left" if keep_dangling else "inner")
    return joined.select("direction", "edge_type", "line", "id", F.coalesce("name", "id").alias("name"), "label")


def execute_query(g: PropertyGraph, query_type: str, **args) -> DataFrame:
    """A query by its type; an unknown type gives no rows."""
    from codeloom.operators.traverse import path_between

    known = {
        "callers_of": callers_of,
        "callees_of": callees_of,
        "subclasses_of": subclasses_of,
        "implementations_of": implementations_of,
        "by_pattern": by_pattern,
        "by_decorator": by_decorator,
        "by_file": lambda g, file_path: g.by_file(file_path),
        "path_between": path_between,
    }
    return known[query_type](g, **args) if query_type in known else g.nodes.limit(0)
