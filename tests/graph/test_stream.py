import time

from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators.build import build_graph
from codeloom.sources.pysource import parse
from codeloom.streaming import files


def wait(query, ready):
    for _ in range(120):
        query.processAllAvailable()
        if ready():
            return
        time.sleep(0.25)
    raise AssertionError(query.exception())


def test_changes_of_files_as_a_stream(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("x = 1")
    (root / "b.py").write_text("y = 1")
    seen, failed = [], []

    def broken(batch, n):
        raise ValueError("no")

    query = files.watch(spark, str(root), str(tmp_path / "check"), broken, lambda batch, n: seen.extend((r.file_path.rsplit("/", 1)[1], r.event_type) for r in batch.collect()), failed=failed)
    try:
        wait(query, lambda: query.lastProgress is not None or query.isActive)
        time.sleep(2)
        (root / "a.py").write_text("x = 22")
        (root / "b.py").rename(root / "c.py")
        (root / "d.txt").write_text("no source")
        wait(query, lambda: len(seen) >= 3)
    finally:
        query.stop()
    assert sorted(seen) == [("a.py", "modified"), ("b.py", "deleted"), ("c.py", "created")] and failed


def test_offsets_can_be_read_again(tmp_path):
    (tmp_path / "a.py").write_text("x")
    reader = files.FileEventReader(str(tmp_path), ".py")
    start = reader.initialOffset()
    (tmp_path / "b.py").write_text("y")
    rows, end = reader.read(start)
    assert list(rows) == list(reader.readBetweenOffsets(start, end)) == [(str(tmp_path / "b.py"), "created")]
    assert list(reader.read(end)[0]) == []


def test_diffs(spark):
    rows = spark.createDataFrame([(1, "a\nb\n", "a\nc\n"), (2, None, "new"), (3, "old", ""), (4, "same", "same"), (5, None, None)], "k int, a string, b string")
    got = {r.k: r.d for r in rows.select("k", files.diff_text("a", "b").alias("d")).collect()}
    assert got[1].startswith("--- before\n+++ after\n@@ -1,2 +1,2 @@\n") and "-b" in got[1] and "+c" in got[1] and {k: got[k] for k in (2, 3, 4, 5)} == {2: "new", 3: "old", 4: None, 5: None}


def test_impact_of_events(spark):
    nodes = spark.createDataFrame([(n, "Function", n, f"/w/{n}/m.py", i) for i, n in enumerate("abcdef")], "id string, label string, name string, file_path string, ordinal long")
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("f", "a")]
    edges = spark.createDataFrame([(f"{s}{t}", s, t, "CALLS", 0.9) for s, t in pairs], "id string, source_id string, target_id string, edge_type string, confidence double")
    changed = spark.createDataFrame([(1, "a"), (1, "d"), (2, "d"), (3, "zz")], "event int, id string")
    got = {r.event: (r.risk, r.affected, r.groups) for r in files.event_impact(PropertyGraph(nodes, edges), changed).collect()}
    assert got == {1: ("MEDIUM", 4, ["b/m.py", "c/m.py", "e/m.py", "f/m.py"]), 2: ("LOW", 0, []), 3: ("LOW", 0, [])}


def test_a_file_built_anew(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "file_path string, source string")
    before = rows(("/w/a.py", "from b import f\n\n\ndef main():\n    f()\n"), ("/w/b.py", "def f():\n    pass\n\n\ndef old():\n    pass\n"))
    g = build_graph(parse(before), "/w")
    change = spark.createDataFrame([("/w/b.py", "modified", "def f():\n    return g()\n\n\ndef g():\n    pass\n")], "file_path string, event_type string, source string")
    after = files.sources_after(before, change)
    got, whole = files.refreshed(g, after, change.select("file_path"), "/w"), build_graph(parse(after), "/w")
    ids = lambda df: {r.id for r in df.select("id").collect()}
    assert ids(got.nodes) == ids(whole.nodes) and ids(got.edges) == ids(whole.edges)
    gone = change.withColumn("event_type", F.lit("deleted"))
    left = files.refreshed(g, files.sources_after(before, gone), gone.select("file_path"), "/w")
    assert {r.name for r in left.nodes.collect()} == {"a.py", "main"}


def test_a_write_split_over_two_batches_is_one_event(spark, tmp_path):
    from pyspark.sql import functions as F  # noqa: F811

    folder = tmp_path / "in"
    folder.mkdir()

    def put(n, *rows):
        part = tmp_path / "part"
        part.write_text("".join(f"{ts},{path},{kind}\n" for ts, path, kind in rows))
        part.rename(folder / f"{n}.csv")

    events = spark.readStream.schema("ts timestamp, file_path string, event_type string").option("maxFilesPerTrigger", 1).csv(str(folder))
    seen = []
    query = files.settled(events).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: seen.append({(r.file_path, r.event_type, r.n) for r in b.collect()})).start()
    try:
        at = "2026-01-01T00:00:0{}Z".format
        put(1, (at("0.000"), "a.py", "modified"), (at("0.010"), "b.py", "deleted"), (at("0.020"), "b.py", "created"))
        query.processAllAvailable()
        put(2, (at("0.200"), "a.py", "modified"), (at("0.210"), "c.py", "created"))
        query.processAllAvailable()
        assert not any(seen)
        put(3, (at("5.000"), "", "quiet"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert set().union(*seen) == {("a.py", "modified", 2), ("b.py", "deleted", 2), ("c.py", "created", 1)}


def test_the_log_of_changes_is_read_again_and_made_short(tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(files, "COMPACT", 3)
    root, log = tmp_path / "src", str(tmp_path / "log")
    root.mkdir()
    (root / "x.egg-info").mkdir()
    (root / "a.py").write_text("x")
    reader = files.LoggedReader(str(root), ".py", log, 10**9)
    start = reader.initialOffset()
    assert start == {"n": 0} and reader.latestOffset() == start
    (root / "x.egg-info" / "no.py").write_text("z")
    for i in range(7):
        (root / f"b{i}.py").write_text("y" * i)
        assert reader.latestOffset() == {"n": i + 1}
    (root / "a.py").unlink()
    end = reader.latestOffset()
    rows = lambda r, a, b: [x[:2] for p in r.partitions(a, b) for x in r.read(p)]
    want = [(str(root / f"b{i}.py"), "created") for i in range(7)] + [(str(root / "a.py"), "deleted")]
    assert rows(reader, start, end) == want
    times = [x[2] for p in reader.partitions(start, end) for x in reader.read(p)]
    assert times == sorted(set(times))
    again = files.LoggedReader(str(root), ".py", log, 10**9)
    assert again.initialOffset() == end and rows(again, {"n": 5}, end) == want[5:] and again.latestOffset() == end
    again.commit(end)
    assert sorted(os.listdir(log)) == ["000000000006.all", "000000000007.log", "000000000008.log"]
    assert files.LoggedReader(str(root), ".py", log, 0).latestOffset() == {"n": 9}


def test_listings_far_apart_in_time_see_one_burst_until_one_finds_no_change(tmp_path, monkeypatch):
    clock = [10**12]
    monkeypatch.setattr(files.time, "time_ns", lambda: clock[0] * 1_000_000)
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("x")
    reader = files.LoggedReader(str(root), ".py", str(tmp_path / "log"), 300)
    start = reader.initialOffset()
    (root / "a.py").write_text("")
    reader.latestOffset()
    clock[0] += 5000  # a batch takes long
    (root / "a.py").write_text("xx")
    reader.latestOffset()
    assert reader.latestOffset() == {"n": 2}  # too early to be quiet
    clock[0] += 300
    end = reader.latestOffset()
    rows = [x for p in reader.partitions(start, end) for x in reader.read(p)]
    times = [r[2].timestamp() for r in rows]
    assert [r[1] for r in rows] == ["modified", "modified", "quiet"] and times[1] - times[0] < 0.3 < times[2] - times[1]
