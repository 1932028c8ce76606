from codeloom.operators.flows import trace_paths
from codeloom.operators.resolve import resolve_imports


def test_paths_end_at_leaves_cycles_and_the_depth(spark):
    steps = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("d", "a", 1), ("c", "c", 1)], "source_id string, target_id string, k int")
    entries = spark.createDataFrame([("a", 0), ("d", 1)], "entry string, rank int")
    got = {tuple(r.path) for r in trace_paths(entries, steps, 10).collect()}
    assert got == {("a", "b", "d"), ("a", "c"), ("d", "a", "b"), ("d", "a", "c")}
    short = {tuple(r.path) for r in trace_paths(entries, steps, 1).collect()}
    assert short == {("a", "b"), ("a", "c"), ("d", "a")}
    assert trace_paths(entries.limit(0), steps, 3).count() == 0


def test_imports_by_the_end_of_a_path(spark):
    files = spark.createDataFrame([("/r/x/mymodels.py",), ("/r/y/pkg/__init__.py",), ("/r/z/deep/tail.py",)], "file_path string")
    asked = spark.createDataFrame([("/r/a.py", "models", 0), ("/r/a.py", "pkg", 0), ("/r/a.py", "q.tail", 0), ("/r/a.py", "gone", 0), ("/r/a.py", None, 0)], "file_path string, module string, level int")
    got = {r.module: r.target_path for r in resolve_imports(asked, files, "/r").collect()}
    assert got == {"models": "/r/x/mymodels.py", "pkg": "/r/y/pkg/__init__.py", "q.tail": "/r/z/deep/tail.py", "gone": None, "": None}
