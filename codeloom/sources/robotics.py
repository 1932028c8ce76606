"""Robot software read from source: message definitions in SQL functions, launch files and node classes from syntax trees in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.slices import split_lines

#: Base classes as written, and the calls on `self` that declare something: kind, places of its type, name and callback.
NODE_BASES = ("Node", "rclpy.node.Node", "LifecycleNode", "rclpy_lifecycle.node.LifecycleNode")
DECLARED = {
    "create_publisher": ("publisher", 0, 1, None),
    "create_subscription": ("subscriber", 0, 1, 2),
    "create_service": ("service", 0, 1, 2),
    "declare_parameter": ("parameter", None, 0, None),
}
ACTIONS = {"ActionServer": "action_server", "ActionClient": "action_client"}
#: Names of the sections of a definition file, by its ending.
SECTIONS = {"msg": ("fields",), "srv": ("request", "response"), "action": ("goal", "result", "feedback")}


def definitions(files: DataFrame, path: str = "file_path", text: str = "source") -> DataFrame:
    """file_path, name, kind ("msg", "srv" or "action"), section, place, type_name, field_name and default_value of each field.

    A line of three dashes ends a section, but a message has just one; fields of sections beyond those of the kind, and lines of
    one word, are left out. A "#" starts a comment, in a default too. Files of other endings have no rows.
    """
    base = F.element_at(F.split(path, "/"), -1)
    kind = F.regexp_extract(base, r"\.(msg|srv|action)$", 1)
    numbered = F.aggregate(
        split_lines(text),
        F.struct(F.lit(0).alias("section"), F.array().cast("array<struct<section:int,line:string>>").alias("kept")),
        lambda a, line: F.struct(
            F.when(F.trim(line) == "---", a["section"] + 1).otherwise(a["section"]).alias("section"),
            F.when(F.trim(line) == "---", a["kept"]).otherwise(F.concat(a["kept"], F.array(F.struct(a["section"].alias("section"), line.alias("line"))))).alias("kept"),
        ),
    )["kept"]
    rows = files.where(kind != "").select(F.col(path).alias("file_path"), F.regexp_replace(base, r"\.[^.]*$", "").alias("name"), kind.alias("kind"), F.posexplode(numbered).alias("place", "x"))
    bare = F.regexp_replace(F.col("x.line"), "(?s)#.*", "")
    sides = F.split(bare, "=", 2)
    words = F.split(F.regexp_replace(F.get(sides, F.lit(0)), r"^\s+|\s+$", ""), r"\s+")
    default = F.regexp_replace(F.get(sides, F.lit(1)), r"^\s+|\s+$", "")
    names = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    section = F.get(names[F.col("kind")], F.when(F.col("kind") == "msg", 0).otherwise(F.col("x.section")))
    out = rows.select("file_path", "name", "kind", section.alias("section"), "place", words.alias("w"), F.when(default != "", default).alias("default_value"))
    return out.where("size(w) >= 2 AND section IS NOT NULL").select("file_path", "name", "kind", "section", "place", F.col("w")[0].alias("type_name"), F.col("w")[1].alias("field_name"), "default_value")


def literal(node: ast.expr | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def written(node: ast.expr | None) -> str | None:
    """A string's value, and other expressions as they are written."""
    if node is None:
        return None
    text = literal(node)
    return ast.unparse(node) if text is None else text


def spelled(node: ast.expr | None) -> str | None:
    """A name, the last part of a dotted one, and other expressions as they are written."""
    if node is None:
        return None
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ast.unparse(node)


def tree_of(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def launch_of(source: str | None) -> tuple[list[dict], list[str]]:
    """The nodes and the arguments that a launch file declares; none unless it defines generate_launch_description."""
    tree = tree_of(source)
    nodes: list[dict] = []
    arguments: list[str] = []
    if tree is None or not any(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name == "generate_launch_description" for n in ast.walk(tree)):
        return nodes, arguments
    for call in in_order(tree):
        if not isinstance(call, ast.Call):
            continue
        called = call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else None
        if called == "DeclareLaunchArgument" and call.args and literal(call.args[0]):
            arguments.append(literal(call.args[0]))
        if called != "Node":
            continue
        given = {k.arg: k.value for k in call.keywords}
        package, executable = written(given.get("package")), written(given.get("executable"))
        if not (package and executable):
            continue
        items = lambda key: given[key].elts if isinstance(given.get(key), ast.List) else []
        parameters = [k for x in items("parameters") for k in ([literal(y) for y in x.keys] if isinstance(x, ast.Dict) else [literal(x)]) if k is not None]
        pairs = [(literal(x.elts[0]), literal(x.elts[1])) for x in items("remappings") if isinstance(x, ast.Tuple) and len(x.elts) == 2]
        renamed = [{"source": a, "target": b} for a, b in pairs if a is not None and b is not None]
        nodes.append({"package": package, "executable": executable, "name": written(given.get("name")), "parameters": parameters, "remappings": renamed})
    return nodes, arguments


def in_order(tree: ast.AST) -> Iterator[ast.AST]:
    """All nodes below a tree, a parent before its children and in the order of the source; without recursion."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        yield node
        waiting.extend(reversed(list(ast.iter_child_nodes(node))))


def classes_of(tree: ast.Module) -> Iterator[ast.ClassDef]:
    """Classes outside other classes, wherever else they stand."""
    waiting: list[ast.AST] = [tree]
    while waiting:
        node = waiting.pop()
        if isinstance(node, ast.ClassDef):
            yield node
        else:
            waiting.extend(reversed(list(ast.iter_child_nodes(node))))


def robots_of(source: str | None) -> list[dict]:
    """Node classes: class_name, node_name and entries (kind, name, type, detail) in the order of the source."""
    tree = tree_of(source)
    found = []
    for owner in classes_of(tree) if tree else ():
        if not any(ast.unparse(b) in NODE_BASES for b in owner.bases):
            continue
        node_name, entries = None, []
        for call in in_order(owner):
            if not isinstance(call, ast.Call):
                continue
            at = lambda i: call.args[i] if i is not None and i < len(call.args) else None
            if isinstance(call.func, ast.Attribute):
                method = call.func.attr
                if method == "__init__" and node_name is None:
                    node_name = literal(at(0)) or None
                if method not in DECLARED or not (isinstance(call.func.value, ast.Name) and call.func.value.id == "self"):
                    continue
                kind, of_type, of_name, of_callback = DECLARED[method]
                detail = spelled(at(of_callback))
                if kind == "publisher":
                    detail = next((written(k.value) for k in call.keywords if k.arg == "qos_profile"), None)
                if kind == "parameter":
                    detail = ast.unparse(at(1)) if at(1) is not None else None
            elif isinstance(call.func, ast.Name) and call.func.id in ACTIONS:
                kind, of_type, of_name, detail = ACTIONS[call.func.id], 1, 2, None
            else:
                continue
            name, type_name = literal(at(of_name)), spelled(at(of_type))
            if name and (type_name or of_type is None):
                entries.append({"kind": kind, "name": name, "type": type_name, "detail": detail})
        found.append({"class_name": owner.name, "node_name": node_name, "entries": entries})
    return found


def launches(files: DataFrame, path: str = "file_path", text: str = "source") -> DataFrame:
    """file_path, nodes and arguments of each file; both are empty where nothing is launched or the source doesn't parse."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [launch_of(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"file_path": batch.column(0), "nodes": pa.array([n for n, _ in rows], LAUNCHED), "arguments": pa.array([a for _, a in rows], pa.list_(pa.string()))})

    entry = "struct<package:string,executable:string,name:string,parameters:array<string>,remappings:array<struct<source:string,target:string>>>"
    return files.select(F.col(path).alias("file_path"), F.col(text).alias("source")).mapInArrow(read, f"file_path string, nodes array<{entry}>, arguments array<string>")


PAIR = pa.struct([("source", pa.string()), ("target", pa.string())])
LAUNCHED = pa.list_(pa.struct([("package", pa.string()), ("executable", pa.string()), ("name", pa.string()), ("parameters", pa.list_(pa.string())), ("remappings", pa.list_(PAIR))]))
ROBOTS = pa.list_(pa.struct([("class_name", pa.string()), ("node_name", pa.string()), ("entries", pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "name", "type", "detail")])))]))


def robots(files: DataFrame, path: str = "file_path", text: str = "source", order: str = "ordinal") -> DataFrame:
    """file_path, ordinal (of the file), place, class_name, node_name and entries of each node class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"file_path": batch.column(0), "ordinal": batch.column(1), "r": pa.array([robots_of(s) for s in batch.column(2).to_pylist()], ROBOTS)})

    entry = "struct<kind:string,name:string,type:string,detail:string>"
    shape = f"file_path string, ordinal long, r array<struct<class_name:string,node_name:string,entries:array<{entry}>>>"
    found = files.select(F.col(path).alias("file_path"), F.col(order).cast("long").alias("ordinal"), F.col(text).alias("source")).mapInArrow(read, shape)
    return found.select("file_path", "ordinal", F.posexplode("r").alias("place", "x")).select("file_path", "ordinal", "place", "x.*")
