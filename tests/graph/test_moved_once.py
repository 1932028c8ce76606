"""The star graph's edges are merged where they lie, and their ids aren't kept."""

from pyspark.sql import functions as F

from codeloom.operators import health
from codeloom.plans import fixpoint, star, stored

SF = "/root/testdata/sf0.001"


def test_edges_are_moved_once_for_a_table(spark):
    for key in ("source_id", "target_id"):
        plan = star.merged(star.bound(spark, SF, star.UNMERGED).repartition(3, key))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "HashAggregate" in plan and "l_orderkey" in plan
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("l_orderkey" in line or "l_suppkey" in line)]


def test_stored_edges_equal_the_sql_and_hold_no_ids(spark):
    g = star.star_graph(spark, SF)
    plain = fixpoint.checksum(star.bound(spark, SF, star.EDGES))
    assert fixpoint.checksum(g.edges) == plain == fixpoint.checksum(g.by_target)
    assert all("id" not in spark.table(name).columns for key, name in g._names.items() if key != "id")


def test_only_calls_of_one_line_are_merged(spark):
    rows = [("a", "b", "CALLS", 0.5, 1, 1), ("a", "b", "CALLS", 0.9, 1, 1), ("a", "b", "CALLS", 0.9, 2, 1), ("a", "b", "CALLS", 0.95, 0, 0), ("a", "b", "CALLS", 0.95, 0, 0), (None, "b", "CALLS", 0.9, 0, 2), (None, "b", "CALLS", 0.9, 0, 2)]
    ends = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, confidence double, line int, kind int")
    want = sorted([("a", "b", "CALLS", 0.9, 1), ("a", "b", "CALLS", 0.9, 2), ("a", "b", "CALLS", 0.95, 0), ("a", "b", "CALLS", 0.95, 0), (None, "b", "CALLS", 0.9, 0)], key=str)
    assert sorted(map(tuple, star.merged(ends).collect()), key=str) == want
    g = stored.StoredGraph(ends, ends, F.expr(star.EDGE_ID), 2, star.merged)
    assert sorted((tuple(r)[1:] for r in g.by_target.collect()), key=str) == want == sorted((tuple(r)[1:] for r in g.edges.collect()), key=str)


def test_ends_of_edges_are_looked_up_with_one_move(spark):
    g = star.star_graph(spark, SF)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (health.safe_to_modify(g), health.dependents(g)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning(target_id" in plan and "Exchange hashpartitioning(source_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
