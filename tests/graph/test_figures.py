"""What the queries move and write: edges made once, tables only as they are asked for."""

from pyspark.sql import functions as F

from codeloom.catalog import nodes_with_cc, queries, seeds
from codeloom.operators import resolve, traverse
from codeloom.plans import fixpoint, star, stored

SYMBOLS = "id string, label string, name string, file_path string, parameter_count int, ordinal long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_call_edges_are_not_moved_once_made(spark):
    symbols = spark.createDataFrame(
        [("a1", "Function", "a", "/w/a.py", 0, 1), ("a2", "Method", "a", "/w/a.py", 0, 2), ("g0", "Function", "g", "/w/b.py", 0, 3), ("g2", "Function", "g", "/w/b.py", 2, 4), ("gn", "Function", "g", "/w/c.py", None, 5), ("g3", "Function", "g", "/w/d.py", 3, 6), ("h", "Function", "h", "/w/d.py", 1, 7)],
        SYMBOLS,
    )
    calls = spark.createDataFrame([("/w/a.py", "a", "g", 0), ("/w/a.py", "a", "g", 1), ("/w/a.py", "a", "g", 1), ("/w/a.py", "a", "h", None), ("/w/a.py", "a", "a", 3), ("/w/a.py", "nobody", "h", 1), ("/w/d.py", "h", "g", 2)], "file_path string, caller string, callee string, arg_count int")
    none = spark.createDataFrame([], "file_path string, name string, target_path string")
    imported = spark.createDataFrame([("/w/d.py", "/w/b.py")], "file_path string, target_path string")
    got = resolve.call_edges(calls, symbols, none, imported)
    assert sorted(map(tuple, got.collect())) == [
        ("a2", "g0", "CALLS", 0.5, "global resolution"), ("a2", "g2", "CALLS", 0.5, "global resolution"), ("a2", "gn", "CALLS", 0.5, "global resolution"), ("h", "g3", "CALLS", 0.95, "same-file resolution"),
    ]
    assert "Exchange hashpartitioning" not in plan_of(got).split("Join")[0]  # callers times candidates are the last step
    many = spark.range(3).select(F.lit("/w/a.py").alias("file_path"), F.lit("a").alias("caller"), F.lit("g").alias("callee"), F.col("id").cast("int").alias("arg_count"))
    assert sorted(r.target_id for r in resolve.call_edges(many, symbols, none, imported.limit(0)).collect()) == ["g0", "g2", "g3", "gn"]


def test_every_member_of_every_class_is_looked_up(spark):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    want = {f"m:o{r[0]}" for r in orders.select("o_orderkey").collect()}
    got = [r.id for r in queries()["j6_lookup_member"](spark, sf).collect()]
    assert len(got) == len(want) > 0 and set(got) == want


def test_only_tables_that_are_asked_for_are_written(spark):
    sf = "/root/testdata/sf0.001"
    make = lambda: stored.StoredGraph(star.bound(spark, sf, star.NODES), star.bound(spark, sf, star.ENDS), F.expr(star.EDGE_ID), 3)
    g = make()
    assert nodes_with_cc(g).count() > 0 and set(g._names) == {"id"}
    plain = star.bound(spark, sf, star.EDGES)
    assert g.edges.columns == plain.columns and g.edges.schema["line"].dataType == plain.schema["line"].dataType and set(g._names) == {"id", "source_id"}
    assert fixpoint.checksum(g.by_target) == fixpoint.checksum(plain)
    other = make()
    assert traverse.impact(other, seeds(other, "fn:p1")).count() > 0 and set(other._names) == {"id", "target_id"}


def test_buckets_grow_with_the_input_alone(spark):
    assert stored.buckets_for(0) == 2 and stored.buckets_for(6 << 30) == 6 * stored.buckets_for(1 << 30) > int(spark.conf.get("spark.sql.shuffle.partitions"))
