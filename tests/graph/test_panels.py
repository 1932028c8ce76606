from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators import panels
from codeloom.sources import slices
from codeloom.streaming import changes


def graph(spark, edges, files=None):
    names = sorted({x for s, t, _ in edges for x in (s, t)})
    nodes = spark.createDataFrame([(n, "Function", n, (files or {}).get(n, f"/w/{n}.py"), i) for i, n in enumerate(names)], "id string, label string, name string, file_path string, ordinal long")
    rows = spark.createDataFrame([(f"e{i}", s, t, k, 0.9) for i, (s, t, k) in enumerate(edges)], "id string, source_id string, target_id string, edge_type string, confidence double")
    return PropertyGraph(nodes, rows)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_imports_count_for_the_expanded_node_only(spark):
    g = graph(spark, [("a", "x", "IMPORTS"), ("b", "y", "IMPORTS"), ("z", "a", "CALLS"), ("a", "z", "CALLS")])
    found = {r.id: r.role for r in panels.impact_nodes(g, ids(spark, "a", "b"), expanded="a").collect()}
    assert found == {"a": "changed", "b": "changed", "x": "callee", "z": "caller"}
    assert {r.id for r in panels.impact_nodes(g, ids(spark, "a", "b"), expanded="a", cap=3).collect()} == {"a", "b", "x"}
    assert {r.id for r in panels.impact_nodes(g, ids(spark, "a", "b"), cap=1).collect()} == {"a", "b"}


def test_groups_join_over_a_link_and_over_a_name_in_two_files(spark):
    g = graph(spark, [("a", "b", "CALLS"), ("c", "c", "CALLS"), ("d", "q", "CALLS")])
    rows = [("a", "1.py", "u", "added"), ("b", "2.py", "v", "removed"), ("b", "3.py", "v", "modified"), ("c", "4.py", "u", "added"), ("c", "5.py", "w", "added"), ("d", "6.py", "u", "added"), ("d", "7.py", "u", "added"), (None, "8.py", "u", "added")]
    items = spark.createDataFrame(rows, "name string, file string, dir string, kind string")
    got = {r.group: (r.label, r.size, r.files, r.added, r.modified, r.removed) for r in panels.semantic_groups(g, items).collect()}
    assert got == {"1.py": ("v", 3, 3, 1, 1, 1), "4.py": ("u", 2, 2, 2, 0, 0), "6.py": ("6", 1, 1, 1, 0, 0), "7.py": ("7", 1, 1, 1, 0, 0), "8.py": ("8", 1, 1, 1, 0, 0)}
    assert panels.semantic_groups(g, items.limit(0)).collect() == []


def test_match_takes_the_first_tier_that_finds_something(spark):
    g = graph(spark, [("a", "b", "CALLS")], {"a": "/w/x/m.py", "b": "/w/y/m.py"})
    none, names = ids(spark).limit(0), lambda *n: ids(spark, *n).toDF("name")
    found = lambda *args: {(r.id, r.tier) for r in panels.match_changed(g, *args).collect()}
    assert found(ids(spark, "a", "zz"), names("b"), "m.py") == {("a", 1)}
    assert found(none, names("b"), "/q/m.py") == {("b", 2)}
    assert found(none, names("zz"), "/q/m.py") == {("a", 3), ("b", 3)}
    assert found(none, names("zz"), "") == set()


def test_hotspots_by_two_parts_then_whole_path_then_ending(spark):
    nodes = spark.createDataFrame([("a", "/w/x/m.py"), ("b", "k.py"), ("c", "/w/deep/in/z.py"), ("d", None), ("e", "")], "id string, file_path string")
    spots = spark.createDataFrame([("x/m.py",), ("m.py",), ("k.py",), ("deep/in/z.py",), ("z.py",)], "file string")
    got = {r.id: r.file for r in panels.with_hotspots(nodes, spots).collect()}
    assert got == {"a": "x/m.py", "b": "k.py", "c": "deep/in/z.py", "d": None, "e": None}


def test_source_windows(spark):
    text = "\n".join(f"l {i}" for i in range(1, 121)) + "\n"
    rows = spark.createDataFrame([("/w/a.py", text), ("/v/a.py", text), ("/w/b.py", None), ("/wx/a.py", text), ("/w/e.py", "")], "p string, t string")
    got = {r.p: r.s for r in rows.select("p", slices.window("p", "t", "/w", F.lit(60), F.lit(61)).alias("s")).collect()}
    assert (got["/w/a.py"].start_line, got["/w/a.py"].end_line, got["/w/a.py"].total) == (10, 111, 120) and got["/w/a.py"].content.startswith("l 10\nl 11\n")
    assert got["/v/a.py"].error == got["/wx/a.py"].error == "path outside project root" and got["/w/b.py"].error == "file not found" and got["/w/e.py"].total == 0
    whole = rows.where("p = '/w/a.py'").select(slices.window("p", "t", "/w").alias("s")).head().s
    assert whole.content == text[:-1] and (whole.start_line, whole.end_line) == (1, 120)
    cut = rows.where("p = '/w/a.py'").select(slices.lines("t", F.lit(-3), F.lit(2)).alias("a"), slices.lines("t", F.lit(120), F.lit(500)).alias("b"), slices.lines("t", F.lit(9), F.lit(8)).alias("c")).head()
    assert tuple(cut) == ("l 1\nl 2", "l 120", "")


def test_lines_of_a_session(spark):
    rows = spark.createDataFrame([("a.py", ["f"], [], ["g"], "HIGH", ["w/x"]), ("a.py", [], ["h"], [], "LOW", ["w/x", "a"])], "file_path string, added array<string>, modified array<string>, removed array<string>, risk string, groups array<string>")
    said = [r.line for r in changes.summary_lines(rows, F.col("groups")).orderBy("place").collect()]
    assert said[1:] == ["Changes:  2", "Files:    1", "Nodes:    +1 added  ~1 modified  -1 removed", "High risk: 1", "Groups:   a, w/x"]
