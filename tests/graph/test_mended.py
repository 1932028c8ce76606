"""Flows of a repeated name, a repository's subfolder, tasks, metrics, views and commits of very many files."""

import os
import subprocess
from datetime import datetime

from pyspark.sql import functions as F

from codeloom import measures
from codeloom.graph import PropertyGraph
from codeloom.operators import flows, health, views
from codeloom.sources import gitlog

NODES = "id string, label string, name string, file_path string, start_line int, end_line int, docstring string, ordinal long"
EDGES = "id string, source_id string, target_id string, edge_type string, confidence double"


def test_only_the_first_node_of_a_name_is_an_entry(spark):
    nodes = spark.createDataFrame([(i, "Function", n, "/w/a.py", 1, 2, None, k) for k, (i, n) in enumerate([("m1", "main"), ("x", "x"), ("m2", "main"), ("y", "y")])], NODES)
    edges = spark.createDataFrame([("1", "m1", "x", "CALLS", 0.9), ("2", "m2", "y", "CALLS", 0.9)], EDGES)
    got = flows.flows_from(PropertyGraph(nodes, edges), "main").collect()
    assert [(r.entry, r.terminal) for r in got] == [("m1", "x")]
    assert flows.flows_from(PropertyGraph(nodes, edges), "nobody").count() == 0


def git(folder, *words, at=None):
    who = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x.example", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x.example", "GIT_CONFIG_GLOBAL": os.devnull}
    subprocess.run(["git", *words], cwd=folder, check=True, capture_output=True, env=os.environ | who)


def test_the_history_of_a_folder_below_the_repository_s_top(spark, tmp_path):
    git(tmp_path, "init", "-q")
    sub = tmp_path / "sub"
    (sub / "in").mkdir(parents=True)
    names = ["sub/a.py", "sub/in/größe é.py", "top.py", "sub/b.txt", 'sub/"q".py']
    for k in range(3):
        for n in names:
            (tmp_path / n).write_text(f"{k}\n")
        git(tmp_path, "add", "-A")
        git(tmp_path, "commit", "-qm", f"COMMIT {k}")
    got = gitlog.read_log(spark, str(sub), commits_per_task=2)
    rows = got.collect()
    assert sorted({r.file for r in rows}) == sorted(str(tmp_path / n) for n in names if n.startswith("sub/") and n.endswith(".py"))
    assert len(rows) == 9 and len({r.commit_idx for r in rows}) == 3 and {r.author for r in rows} == {"a@x.example"} and got.rdd.getNumPartitions() == 2
    assert all(isinstance(r.date, datetime) for r in rows)
    assert gitlog.read_log(spark, str(tmp_path), days=90).where(F.col("file").endswith("/top.py")).count() == 3
    assert gitlog.read_log(spark, "/nowhere").count() == 0
    spots = health.hotspots(gitlog.read_log(spark, str(sub)), F.current_timestamp())
    assert spots.count() == 3


def test_tasks_by_all_criteria_in_order(spark):
    day = lambda d: datetime(2026, 1, d)
    rows = [(1, "Fix", "the Login", "pending", 3, ["a"], day(2), 1), (2, "login", None, "done", 4, ["a", "b"], day(1), 2), (3, "x", "y", "pending", 1, [], None, 3), (4, "LOGIN", "", "pending", 3, ["a"], None, 4)]
    df = spark.createDataFrame(rows, "id int, title string, description string, status string, priority int, tags array<string>, due timestamp, ordinal int")
    ids = lambda **k: [r.id for r in measures.search_tasks(df, **k).collect()]
    assert ids(keyword="login", sort_by="priority") == [2, 1, 4] and ids(sort_by="due_date", ascending=True) == [2, 1, 3, 4] and ids(sort_by="nothing") == [2, 1, 4, 3]
    assert ids(least_priority=3, tag="a", sort_by="due_date") == [4, 1, 2] and ids(overdue_at=F.lit(day(5))) == [1] and ids(status="done") == [2]


def test_metrics_are_summed_replaced_and_appended(spark):
    kind = "kind string, name string, place long, value double"
    left = spark.createDataFrame([("counter", "c", 0, 2.0), ("gauge", "g", 0, 1.0), ("gauge", "only", 0, 5.0), ("histogram", "h", 0, 1.0), ("histogram", "h", 1, 2.0)], kind)
    right = spark.createDataFrame([("counter", "c", 0, 3.0), ("counter", "new", 0, 1.0), ("gauge", "g", 0, 9.0), ("histogram", "h", 0, 7.0), ("histogram", "k", 0, 8.0)], kind)
    got = sorted(map(tuple, measures.merged_metrics(left, right).collect()))
    assert got == [("counter", "c", 0, 5.0), ("counter", "new", 0, 1.0), ("gauge", "g", 0, 9.0), ("gauge", "only", 0, 5.0), ("histogram", "h", 0, 1.0), ("histogram", "h", 1, 2.0), ("histogram", "h", 2, 7.0), ("histogram", "k", 0, 8.0)]


def test_a_view_s_texts_are_cut_and_its_fans_counted_among_what_it_shows(spark):
    source = "\n".join(["x" * 99] * 40)
    nodes = spark.createDataFrame([("f", "File", "a.py", "/w/p/q/r/a.py", None, None, None, 0), ("c", "Class", "C", "/w/p/q/r/a.py", 1, 3, "d" * 300, 1), ("g", "Function", "g", "/w/b.py", 2, None, "", 2), ("m", "Method", "m", "/w/p/q/r/a.py", 2, 3, None, 3), ("v", "Variable", "v", "", 2, None, None, 4)], NODES)
    edges = spark.createDataFrame([("1", "c", "m", "HAS_METHOD", 0.9), ("2", "g", "m", "CALLS", 0.9), ("3", "g", "c", "USES", 0.9), ("4", "g", "v", "CALLS", 0.9), ("5", "gone", "g", "CALLS", 0.9)], EDGES)
    g = PropertyGraph(nodes, edges)
    sources = spark.createDataFrame([("/w/p/q/r/a.py", source), ("/w/b.py", source)], "file_path string, source string")
    shown, links = views.view_nodes(g, "unknown", root="/w", sources=sources)
    got = {r.id: r for r in shown.collect()}
    assert set(got) == {"f", "c", "g", "m"} and [got[i]["group"] for i in "cg"] == ["p/q", "root"] and len(got["c"].doc) == 200 and got["g"].doc is None
    assert got["c"].source == "\n".join(["x" * 99] * 3) and got["g"].source.endswith("\n# ... truncated") and len(got["g"].source) == 2000 + len("\n# ... truncated") and got["f"].source is None
    assert [(got[i].fan_in, got[i].fan_out) for i in "cgm"] == [(1, 1), (0, 2), (2, 0)]  # edges of all types among what is shown
    assert {(r.source, r.target) for r in links.collect()} == {("c", "m"), ("g", "m")}
    few, some = views.view_nodes(g, "logic", root="/w", cap=2)
    assert {r.id for r in few.collect()} == {"c", "g"} and some.count() == 0
    arch = views.view_nodes(g, "architecture", root="/w")[0].collect()
    assert [(r.id, r.function_count, r.class_count) for r in arch] == [("f", 0, 1)]
    assert views.view_nodes(g, "deep", root="")[0].select("group").distinct().collect()[0][0] == "other"


def test_a_commit_of_very_many_files_makes_no_pairs(spark):
    n = 100_000
    large = spark.range(n).select(F.lit("big").alias("commit_idx"), F.concat(F.lit("f"), "id").alias("file"))
    small = spark.createDataFrame([(f"c{i}", f) for i in range(4) for f in ("f1", "f2")] + [("c9", "f3"), ("c9", "f1")], "commit_idx string, file string")
    rows = large.unionByName(small)
    assert health.candidate_pairs(rows, 3).count() <= 1
    log = rows.select("commit_idx", F.lit("a").alias("author"), F.lit("2026-01-01").cast("timestamp").alias("date"), "file")
    got = health.co_changes(log, F.lit("2026-01-02").cast("timestamp")).collect()
    assert [tuple(r) for r in got] == [("f1", "f2", 5, 1.0)]


def test_pairs_equal_those_of_all_commits(spark):
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(3)
    commits = {f"c{i}": sorted(rng.sample(range(25), rng.randint(1, 12))) for i in range(30)}
    rows = spark.createDataFrame([(c, "a", datetime(2026, 1, 1), f"f{x:02d}") for c, fs in commits.items() for x in fs], "commit_idx string, author string, date timestamp, file string")
    alone, both = Counter(x for fs in commits.values() for x in fs), Counter(p for fs in commits.values() for p in combinations(fs, 2))
    want = sorted(((-c, f"f{a:02d}", f"f{b:02d}") for (a, b), c in both.items() if c >= 3 and c / min(alone[a], alone[b]) >= 0.3))[:100]
    got = health.co_changes(rows, F.lit(datetime(2026, 1, 2))).collect()
    assert [(-r["count"], r.file_a, r.file_b) for r in got] == want
