"""One object for a folder of sources, its tools by name, and a command line."""

from __future__ import annotations

import argparse
import inspect
import json
import os
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph, first_named
from codeloom.operators import flows, health, search, traverse, views
from codeloom.operators.build import build_graph
from codeloom.sources import gitlog, pysource
from codeloom.streaming import changes


class CodeGraph:
    """A folder's graph, built when first asked for; its answers are DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(os.path.expanduser(root))

    @cached_property
    def graph(self) -> PropertyGraph:
        return build_graph(pysource.parse(pysource.read_python(self.spark, self.root)), self.root)

    def analyze(self) -> DataFrame:
        """metric and count of the graph, which is built anew."""
        self.__dict__.pop("graph", None)
        return views.summary_lines(self.graph)

    def seeds(self, name: str) -> DataFrame:
        return first_named(self.graph.nodes, name).select(F.col("id").alias("seed"), "id")

    def impact(self, target: str, direction: str = "upstream", max_depth: int = 3) -> DataFrame:
        if direction not in ("upstream", "downstream"):
            raise ValueError("direction is upstream or downstream")
        return traverse.impact(self.graph, self.seeds(target), direction, int(max_depth))

    def trace(self, entry: str) -> DataFrame:
        return flows.flows_from(self.graph, entry)

    def cycles(self) -> DataFrame:
        return traverse.cycles(self.graph)

    def orphans(self) -> DataFrame:
        return traverse.orphans(self.graph)

    def query(self, query_type: str, **args) -> DataFrame:
        return search.execute_query(self.graph, query_type, **args)

    def health(self) -> DataFrame:
        return health.module_report(self.graph, root=self.root)

    def export(self, format: str = "json") -> DataFrame:
        return views.export_dot(self.graph) if format == "dot" else views.export_json(self.graph)

    def commits(self, days: int = 90) -> DataFrame:
        return gitlog.read_log(self.spark, self.root, days)


class Tools:
    """The tools of a graph by name, for callers that send a name and arguments; events(ts, event_type, file_path) are the changes seen so far."""

    def __init__(self, code: CodeGraph, events: DataFrame | None = None):
        self.code = code
        self.events = events if events is not None else code.spark.createDataFrame([], "ts timestamp, event_type string, file_path string")

    def path(self, given: str) -> str:
        return os.path.normpath(os.path.join(self.code.root, given))

    def tool_query(self, query: str = "") -> DataFrame:
        return search.keyword_search(self.code.graph, query)

    def tool_context(self, name: str) -> DataFrame:
        return search.context(self.code.graph, name)

    def tool_impact(self, target: str, direction: str = "upstream", max_depth: int = 3) -> DataFrame:
        return self.code.impact(target, direction, max_depth)

    def tool_detect_changes(self) -> DataFrame:
        """Nothing: changes come from what_changed."""
        return self.events.limit(0)

    def tool_graph_query(self, query_type: str = "", **args) -> DataFrame:
        return self.code.query(query_type, **args)

    def tool_export(self, format: str = "json") -> DataFrame:
        return self.code.export(format)

    def tool_cycles(self) -> DataFrame:
        return self.code.cycles()

    def tool_orphans(self) -> DataFrame:
        return self.code.orphans()

    def tool_health(self) -> DataFrame:
        return self.code.health()

    def tool_complexity(self, name: str = "") -> DataFrame:
        return health.complexity_of(self.code.graph.nodes, name)

    def tool_impact_preview(self, name: str = "") -> DataFrame:
        row = self.code.seeds(name).head()
        return health.impact_preview(self.code.graph, row.id if row else "")

    def tool_safe_to_modify(self, file_path: str = "") -> DataFrame:
        return health.safe_to_modify(self.code.graph).where(F.col("file_path").isin(file_path, self.path(file_path)))

    def tool_what_changed(self) -> DataFrame:
        """kind ("type" or "event") and json: the session's events by type, and the last ten."""
        order = [F.desc("ts"), "file_path"]
        last = changes.newest(self.events, order, limit=10).select(F.lit("event").alias("kind"), F.to_json(F.struct("ts", "event_type", "file_path")).alias("json"))
        summary = changes.session_summary(self.events)
        return summary.select(F.lit("type").alias("kind"), F.to_json(F.struct(*summary.columns)).alias("json")).unionByName(last)

    def tool_suggest_tests(self, name: str = "") -> DataFrame:
        return traverse.suggest_tests(self.code.graph, self.code.seeds(name))

    def tool_dependency_check(self, module: str = "") -> DataFrame:
        return health.dependency_check(self.code.graph)

    def tool_hotspot_report(self, file_path: str = "", days: int = 90) -> DataFrame:
        """The ten files that change most, or the one asked for."""
        spots = health.hotspots(self.code.commits(int(days)), F.current_timestamp(), int(days))
        if file_path:
            return spots.where(F.col("file").isin(file_path, self.path(file_path)))
        return spots.orderBy(F.desc("score"), "file").limit(10)

    def tool_co_change(self, file_path: str, days: int = 90) -> DataFrame:
        return health.co_changes_of(self.code.commits(int(days)), F.current_timestamp(), self.path(file_path), int(days))

    @classmethod
    def names(cls) -> list[str]:
        return [n.removeprefix("tool_") for n in vars(cls) if n.startswith("tool_")]

    @classmethod
    def schemas(cls) -> list[dict]:
        """name and parameters (name to whether it must be given) of each tool."""
        out = []
        for name in cls.names():
            given = [p for p in inspect.signature(getattr(cls, f"tool_{name}")).parameters.values() if p.name != "self" and p.kind != p.VAR_KEYWORD]
            out.append({"name": name, "parameters": {p.name: p.default is p.empty for p in given}})
        return out

    def call(self, name: str, arguments: dict | None = None) -> DataFrame | dict:
        """A tool's rows; for an unknown tool or arguments that don't fit, {"error": what is wrong}."""
        if name not in self.names():
            return {"error": f"unknown tool: {name}"}
        try:
            return getattr(self, f"tool_{name}")(**(arguments or {}))
        except (TypeError, ValueError) as error:
            return {"error": str(error)}

    def resource(self, uri: str) -> DataFrame | dict:
        if uri == "graph://context":
            return views.summary_lines(self.code.graph)
        if uri == "graph://processes":
            return flows.execution_flows(self.code.graph, min_steps=1)
        return {"error": f"unknown resource: {uri}"}

    def respond(self, request: str) -> Iterator[str]:
        """JSON lines for a request {"tool": name, "arguments": {...}} or {"resource": uri}: a row each, read partition by partition, or an error."""
        try:
            asked = json.loads(request)
            found = self.resource(asked["resource"]) if "resource" in asked else self.call(asked["tool"], asked.get("arguments"))
        except (ValueError, KeyError, TypeError) as error:
            found = {"error": f"bad request: {error}"}
        if isinstance(found, dict):
            yield json.dumps(found)
            return
        for row in found.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            yield row.j


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom", description="The graph of a folder of Python sources")
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("--impact", metavar="NAME", help="what a change of NAME affects")
    parser.add_argument("--direction", choices=["upstream", "downstream"], default="upstream")
    parser.add_argument("--depth", type=int, default=3)
    parser.add_argument("--orphans", action="store_true", help="symbols that nothing uses")
    parser.add_argument("--export", choices=["json", "dot"])
    parser.add_argument("--max-nodes", type=int, default=2000, help="of the page's graph with --serve")
    parser.add_argument("--serve", action="store_true", help="print the page's nodes and edges as JSON lines")
    parser.add_argument("--tools", action="store_true", help="answer requests from standard input, a line each")
    parser.add_argument("--watch", action="store_true", help="print changes until interrupted")
    args = parser.parse_args(argv)
    root = os.path.abspath(os.path.expanduser(args.root))
    if not os.path.isdir(root):
        parser.exit(1, f"{args.root} is not a folder\n")
    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    code = CodeGraph(spark, root)
    if args.impact:
        show(views.impact_lines(code.impact(args.impact, args.direction, args.depth)))
    elif args.orphans:
        show(code.orphans().select("label", "name", "file_path"))
    elif args.export:
        rows = code.export(args.export)
        if args.export == "dot":
            print("digraph {")
        for row in rows.orderBy(rows.columns[0]).toLocalIterator():
            print(row[-1])
        if args.export == "dot":
            print("}")
    elif args.serve:
        page = views.page_graph(code.graph, args.max_nodes)
        show(views.export_json(page).select("json"))
    elif args.tools:
        import sys

        tools = Tools(code)
        for line in sys.stdin:
            for answer in tools.respond(line):
                print(answer, flush=True)
    elif args.watch:
        from codeloom.plans.fixpoint import shared_folder
        from codeloom.streaming.files import watch

        watch(spark, root, os.path.join(shared_folder(spark), "watch"), lambda batch, n: show(batch)).awaitTermination()
    else:
        show(code.analyze())
    return 0


def show(rows: DataFrame) -> None:
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    raise SystemExit(main())
