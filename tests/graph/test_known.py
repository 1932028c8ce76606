"""Operators without a query of their own, on graphs known by hand."""

from codeloom.graph import PropertyGraph
from codeloom.operators import flows, health, traverse, views
from codeloom.streaming import changes
from pyspark.sql import functions as F


def graph(spark, edges, names):
    nodes = spark.createDataFrame([(n, "Function", n, f"/w/{n}.py", i) for i, n in enumerate(names)], "id string, label string, name string, file_path string, ordinal long")
    rows = spark.createDataFrame([(f"e{i}", s, t, "CALLS", c) for i, (s, t, c) in enumerate(edges)], "id string, source_id string, target_id string, edge_type string, confidence double")
    return PropertyGraph(nodes, rows)


def test_communities_need_confident_edges_and_known_ends(spark):
    g = graph(spark, [("a", "b", 0.9), ("c", "b", 0.5), ("c", "d", 0.4), ("d", "e", 0.9), ("f", "f", 0.9), ("f", "zz", 0.9)], "abcdef")
    assert {(r.id, r.component) for r in traverse.communities(g).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_dependency_check_counts_cycles(spark):
    g = graph(spark, [("a", "b", 0.9), ("b", "a", 0.9), ("c", "c", 0.9), ("c", "d", 0.9)], "abcd")
    row = health.dependency_check(g).head()
    assert (row.n_cycles, row.cycles) == (2, [["a", "b"], ["c"]])


def test_flows_from_a_name(spark):
    g = graph(spark, [("main", "a", 0.9), ("a", "b", 0.9), ("other", "b", 0.9)], ["main", "a", "b", "other"])
    assert [(r.entry, r.path) for r in flows.flows_from(g, "main").collect()] == [("main", ["main", "a", "b"])]
    assert flows.flows_from(g, "nobody").collect() == []


def test_snapshots_and_frames(spark):
    shape = "file_path string, name string, label string, signature string, ordinal int"
    old = spark.createDataFrame([("m", "f", "F", "1", 0), ("m", "f", "F", "2", 1), ("m", "g", "F", "1", 2), ("m", "h", "F", "1", 3)], shape)
    new = spark.createDataFrame([("m", "f", "F", "2", 0), ("m", "g", "F", "9", 1), ("m", "i", "F", "1", 2)], shape)
    assert {(r.name, r.change) for r in changes.snapshot_diff(old, new).collect()} == {("g", "modified"), ("h", "removed"), ("i", "added")}
    frame = old.limit(1).select(views.sse_frame("change", F.struct("name")).alias("x")).head().x
    assert frame == 'event: change\ndata: {"name":"f"}\n\n'
