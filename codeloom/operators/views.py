"""Data products of a graph: exports, views, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators.health import view_group
from codeloom.plans.fixpoint import cut


def file_tree(g: PropertyGraph) -> DataFrame:
    """Symbols of each file by line: file_path, symbols (names joined by commas) and n."""
    rows = g.nodes.where("label <> 'File'").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "ordinal", "name"))).alias("s"), F.count("*").alias("n"))
    return rows.select("file_path", F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("symbols"), "n")


def export_json_nodes(g: PropertyGraph) -> DataFrame:
    """id and json of each node; null and empty properties are left out."""
    keep = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in g.nodes.dtypes if not t.startswith("array")]
    lists = [F.when(F.size(F.filter(c, lambda x: x != "")) > 0, F.col(c)).alias(c) for c, t in g.nodes.dtypes if t.startswith("array")]
    return g.nodes.select("id", F.to_json(F.struct(*keep, *lists)).alias("json"))


def export_json(g: PropertyGraph) -> DataFrame:
    """kind ("node" or "edge"), id and json; of a node, null and empty properties are left out."""
    nodes = export_json_nodes(g).select(F.lit("node").alias("kind"), "id", "json")
    ends = F.struct("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("edge_type").alias("type"), "confidence")
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("kind"), "id", F.to_json(ends).alias("json")))


def filtered(g: PropertyGraph, labels: tuple[str, ...], edge_types: tuple[str, ...]) -> PropertyGraph:
    """The nodes of the labels, and the edges of the types with both ends among them."""
    nodes = g.nodes.where(F.col("label").isin(*labels))
    edges = g.edges.where(F.col("edge_type").isin(*edge_types))
    for end in ("source_id", "target_id"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return PropertyGraph(nodes, edges)


def importance(g: PropertyGraph) -> DataFrame:
    """id, size (it grows with the logarithm of the node's edges) and kind ("hub" from ten edges, "linked" from three, else "leaf")."""
    ends = g.edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return g.nodes.select("id").join(ends, "id", "left").select("id", (2 + F.log2(n + 1)).alias("size"), F.when(n >= 10, "hub").when(n >= 3, "linked").otherwise("leaf").alias("kind"))


def export_dot(g: PropertyGraph) -> DataFrame:
    """Lines of a DOT file, nodes before edges: part, line."""
    label = F.replace("name", F.lit('"'), F.lit('\\"'))
    nodes = g.nodes.select(F.lit(0).alias("part"), F.concat(F.lit('  "'), "id", F.lit('" [label="'), label, F.lit('"];')).alias("line"))
    edges = g.edges.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), "source_id", F.lit('" -> "'), "target_id", F.lit('" [label="'), "edge_type", F.lit('"];')).alias("line"))
    return nodes.unionByName(edges)


#: What a view shows first, what each mode shows, and its greatest number of nodes.
PRIORITY = {
    "ROS2Node": 0, "Topic": 1, "Service": 1, "Action": 1, "Parameter": 2, "Class": 3, "Function": 4, "File": 5, "Module": 6, "Method": 7, "Variable": 8, "Decorator": 8, "Property": 8,
}
OTHER_PRIORITY = 50
MODES = {
    "architecture": (("File",), ("IMPORTS",), 200),
    "logic": (("File", "Function", "Class", "Method"), ("CALLS", "IMPORTS", "EXTENDS", "HAS_METHOD", "CONTAINS", "DECORATES"), 600),
    "deep": (None, None, 2000),
}
DOC_LENGTH, SOURCE_LENGTH, CUT_MARK, OPEN_LINES = 200, 2000, "\n# ... truncated", 30


def view_nodes(g: PropertyGraph, mode: str = "logic", root: str = "", cap: int | None = None, sources: DataFrame | None = None, scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a view of a mode shows: its foremost nodes, and the links of the mode's types with both ends among them.

    Nodes come by priority of their label, then in the graph's order, `cap` of them (the mode's
    number by default); an unknown mode is "logic". Each has its group, file, line, end_line, the
    first 200 characters of its docstring, and fan_in and fan_out: its edges of all types from and
    to nodes shown. With sources(file_path, source), functions, methods and classes have their
    source, cut after 2000 characters. With scores (see health.complexity), complexity, risk and
    line_count. In the mode "architecture" files have their numbers of functions and classes.
    """
    labels, types, most = MODES.get(mode, MODES["logic"])
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("label")), F.lit(OTHER_PRIORITY))
    some = g.nodes.where("label <> 'Folder'") if labels is None else g.nodes.where(F.col("label").isin(*labels))
    first = cut(some.orderBy(rank, "ordinal", "id").limit(most if cap is None else cap))
    ids = F.broadcast(first.select("id"))  # `cap` rows at most
    inside = g.edges
    for end in ("source_id", "target_id"):
        inside = inside.join(ids.withColumnRenamed("id", end), end, "left_semi")
    inside = cut(inside)
    fans = [inside.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name)) for end, name in (("target_id", "fan_in"), ("source_id", "fan_out"))]
    doc = F.left("docstring", F.lit(DOC_LENGTH)) if "docstring" in g.nodes.columns else F.lit(None).cast("string")
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = first.select("*", view_group(root).alias("group"), text("file_path").alias("file"), F.coalesce("start_line", F.lit(0)).alias("line"), F.when(doc != "", doc).alias("doc"))
    for fan in fans:
        shown = shown.join(fan, "id", "left")
    columns = ["id", "name", "label", "group", "file", "line", F.coalesce("end_line", F.lit(0)).alias("end_line"), "doc", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out")]
    if mode == "architecture":
        counts = g.nodes.groupBy("file_path").agg(F.count_if(F.col("label") == "Function").alias("function_count"), F.count_if(F.col("label") == "Class").alias("class_count"))
        shown = shown.join(counts, "file_path", "left")
        columns += ["function_count", "class_count"]
    if sources is not None:
        start = F.greatest(F.col("start_line"), F.lit(1))
        lines = F.slice(F.split("source", r"\r?\n"), start, F.greatest(F.coalesce("end_line", start + OPEN_LINES - 1) - start + 1, F.lit(0)))
        snippet = F.array_join(lines, "\n")
        snippet = F.when(F.length(snippet) > SOURCE_LENGTH, F.concat(F.left(snippet, F.lit(SOURCE_LENGTH)), F.lit(CUT_MARK))).otherwise(snippet)
        coded = F.col("label").isin("Function", "Method", "Class") & (F.col("start_line") > 0)
        shown = shown.join(sources.select("file_path", "source"), "file_path", "left").withColumn("source", F.when(coded, snippet))
        columns.append("source")
    if scores is not None:
        shown = shown.join(scores.select("id", F.col("cc").alias("complexity"), F.col("risk").alias("health_risk"), "line_count"), "id", "left")
        columns += ["complexity", "health_risk", "line_count"]
    links = inside if types is None else inside.where(F.col("edge_type").isin(*types))
    return shown.select(*columns), links.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("edge_type").alias("type"), "confidence")


def graph_view(g: PropertyGraph, labels: tuple[str, ...], edge_types: tuple[str, ...], cap: int) -> PropertyGraph:
    """The foremost nodes of the labels, in the order the labels are given, and the edges with both ends among them."""
    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    nodes = g.nodes.where(F.col("label").isin(*labels)).orderBy(rank, "ordinal").limit(cap)
    ids = F.broadcast(nodes.select("id"))  # at most `cap` rows
    edges = g.edges.where(F.col("edge_type").isin(*edge_types))
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return PropertyGraph(nodes, edges)


def sse_frame(event: str, data) -> object:
    """A server-sent event: its type, and a column's value as JSON."""
    return F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(data), F.lit("\n\n"))


def page_graph(g: PropertyGraph, max_nodes: int = 500, include_files: bool = False, edge_types: tuple[str, ...] | None = None) -> PropertyGraph:
    """What a page shows: the first nodes in the graph's order, files only if asked for, and the edges of the types among them."""
    nodes = (g.nodes if include_files else g.nodes.where("label <> 'File'")).orderBy("ordinal", "id").limit(max_nodes)
    ids = F.broadcast(nodes.select("id"))  # at most max_nodes rows
    edges = g.edges if edge_types is None else g.edges.where(F.col("edge_type").isin(*edge_types))
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return PropertyGraph(nodes, edges)


def summary_lines(g: PropertyGraph) -> DataFrame:
    """metric and count: files, functions (methods too), classes, imports, call edges, nodes and edges."""
    metrics = {"Files": F.col("label") == "File", "Functions": F.col("label").isin("Function", "Method"), "Classes": F.col("label") == "Class", "Total nodes": F.lit(True)}
    links = {"Imports": F.col("edge_type") == "IMPORTS", "Call edges": F.col("edge_type") == "CALLS", "Total edges": F.lit(True)}
    stacked = []
    for rows, wanted in ((g.nodes, metrics), (g.edges, links)):
        one = rows.agg(*(F.count_if(c).alias(k) for k, c in wanted.items()))
        stacked.append(one.unpivot([], list(wanted), "metric", "count"))
    return stacked[0].unionByName(stacked[1])


def impact_lines(found: DataFrame, shown: int = 30) -> DataFrame:
    """depth, edge_type, name, file and more of the first rows of an impact; more is the number of those not shown."""
    total = found.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    rows = found.orderBy("depth", "name", "id").limit(shown).select("depth", "edge_type", "name", F.element_at(F.split("file_path", "/"), -1).alias("file"))
    return rows.join(F.broadcast(total))  # one row
