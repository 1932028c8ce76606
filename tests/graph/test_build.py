"""A small package parsed and made a graph, against edges known by hand."""

from pyspark.sql import functions as F

from codeloom.operators.build import ancestors, build_graph, local_types, type_bindings
from codeloom.sources.pysource import parse, read_python

FILES = {
    "__init__.py": "",
    "models.py": "class Base:\n    def save(self, deep):\n        return check(deep)\n\n\nclass Item(Base):\n    def name(self):\n        return self.save(1)\n",
    "utils.py": "def check(x):\n    return x\n\n\ndef wrap(f):\n    return f\n\n\n@wrap\ndef later():\n    pass\n",
    "views.py": (
        "from .models import Item\nfrom . import utils\nimport os\nfrom .utils import check as test\n\n\nclass View:\n    def __init__(self):\n        self.item = Item()\n\n    async def show(self, other: Item):\n"
        "        self.item.save(2)\n        other.name()\n        return check(3)\n\n\ndef main():\n    v = View()\n    v.show(1)\n    v.missing()\n    i: Item = None\n    i.save(1, 2, 3)\n\n\nmain()\n"
    ),
    "apart.py": "def alone():\n    '''Nobody calls it.'''\n",
}


def made(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "x.py").write_text("def hidden(): pass")
    return parse(read_python(spark, str(tmp_path)))


def test_sources_become_a_graph(spark, tmp_path):
    facts = made(spark, tmp_path)
    g = build_graph(facts, str(tmp_path))
    nodes = {r.id: r for r in g.nodes.collect()}
    name = lambda i: nodes[i].name if nodes[i].label != "Method" else f"{nodes[i].owner}.{nodes[i].name}"
    edges = {(name(r.source_id), r.edge_type, name(r.target_id)) for r in g.edges.collect()}
    assert sorted(n.name for n in nodes.values() if n.label == "File") == sorted(FILES)
    assert {t for t in edges if t[1] == "IMPORTS"} == {("views.py", "IMPORTS", x) for x in ("models.py", "__init__.py", "utils.py")}
    assert {t for t in edges if t[1] == "EXTENDS"} == {("Item", "EXTENDS", "Base")}
    assert {t for t in edges if t[1] == "DECORATES"} == {("wrap", "DECORATES", "later")}
    assert {t for t in edges if t[1] == "HAS_METHOD"} == {("Base", "HAS_METHOD", "Base.save"), ("Item", "HAS_METHOD", "Item.name"), ("View", "HAS_METHOD", "View.__init__"), ("View", "HAS_METHOD", "View.show")}
    calls = {(name(r.source_id), name(r.target_id)): (r.confidence, r.reason) for r in g.edges.where("edge_type = 'CALLS'").collect()}
    typed = (0.95, "type-inferred resolution")
    assert calls[("Item.name", "Base.save")] == typed and calls[("View.show", "Base.save")] == typed
    assert calls[("main", "View.show")] == typed
    assert calls[("View.show", "check")] == (0.9, "named-import resolution") and calls[("Base.save", "check")][1] == "global resolution"
    assert ("main", "Base.save") not in calls and not any(a == "alone" or b == "alone" for a, b in calls)
    show = next(n for n in nodes.values() if n.name == "show")
    assert show.is_async and show.parameter_count == 2 and next(n for n in nodes.values() if n.name == "alone").docstring == "Nobody calls it."
    assert g.nodes.orderBy("ordinal").select("file_path").distinct().count() == len(FILES)


def test_types_and_heritage(spark, tmp_path):
    facts = made(spark, tmp_path)
    types = {(r.scope, r.variable): (r.type, r.confidence) for r in type_bindings(facts).collect()}
    assert types[("View", "self.item")] == ("Item", 0.9) and types[("show", "other")] == ("Item", 0.95) and types[("<module>", "v")] == ("View", 0.9) and types[("<module>", "i")] == ("Item", 0.95)
    assert {(r.name, r.ancestor) for r in ancestors(facts).collect()} == {("Base", "Base"), ("Item", "Item"), ("Item", "Base"), ("View", "View")}
    env = {r.file_path.split("/")[-1]: r.types for r in local_types(facts).collect()}
    assert env == {"views.py": {"item": "Item", "v": "View", "i": "Item"}}


def test_no_files_make_an_empty_graph(spark):
    facts = parse(spark.createDataFrame([], "file_path string, source string"))
    g = build_graph(facts, "/r")
    assert g.nodes.count() == g.edges.count() == 0


def test_module_health_counts_all_that_leaves_a_group(spark):
    from codeloom.graph import PropertyGraph
    from codeloom.operators.health import module_report, rounded, safe_to_modify
    from codeloom.operators.traverse import cycles

    rows = [(f"a{i}", "Function", f"a{i}", "/w/x/a.py", 1) for i in range(3)] + [("b", "Function", "b", "/w/y/b.py", 1), ("t", "Function", "t", "/w/y/test_b.py", 1), ("f", "File", "a.py", "/w/x/a.py", None), ("o", "Function", "o", "/w/z/o.py", 7)]
    nodes = spark.createDataFrame(rows, "id string, label string, name string, file_path string, cc int")
    ends = [("a0", "a1", "CALLS"), ("a0", "b", "CALLS"), ("a1", "b", "CALLS"), ("a2", "gone", "CALLS"), ("t", "f", "IMPORTS"), ("a1", "a0", "EXTENDS"), ("b", "b", "CALLS"), ("a2", "a2", "CONTAINS")]
    edges = spark.createDataFrame([(str(i), *e) for i, e in enumerate(ends)], "id string, source_id string, target_id string, edge_type string")
    g = PropertyGraph(nodes, edges)
    got = {r.grp: r for r in module_report(g, root="/w").collect()}
    assert (got["x"].calls, got["x"].cross_calls, got["x"].internal, got["x"].coupling, got["x"].cohesion, got["x"].risk) == (4, 3, 1, 0.75, 0.167, "MEDIUM")
    assert got["z"].risk == "MEDIUM" and got["z"].avg_cc == 7.0
    safe = {r.file_path: r for r in safe_to_modify(g).collect()}
    assert safe["/w/x/a.py"].has_tests and safe["/w/x/a.py"].risk == "LOW" and safe["/w/x/a.py"].incoming == 0
    assert not safe["/w/y/b.py"].has_tests and (safe["/w/y/b.py"].incoming, safe["/w/y/b.py"].dependent_files) == (2, 1)
    assert {(tuple(r.node_ids), tuple(r.edge_types)) for r in cycles(g).collect()} == {(("a0", "a1"), ("CALLS", "EXTENDS")), (("b",), ("CALLS",))}
    values = spark.createDataFrame([(2.675,), (0.125,), (None,)], "v double")
    assert [r.v for r in values.select(rounded(F.col("v"), F.lit(2)).alias("v")).collect()] == [2.67, 0.12, None]
