"""Started streams with keyed state, against the batch forms over the same rows."""

import json
import os
import random

from pyspark.sql import functions as F

from codeloom.streaming import changes, state

ROWS = f"file_path string, ts timestamp, event_type string, symbols {state.SYMBOLS}"


def test_versions_of_a_stream_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(5)
    now, rows = {}, []
    for i in range(60):
        path = rng.choice(["a.py", "b.py", "c.py"])
        kind = "created" if path not in now else rng.choice(["modified", "modified", "modified", "deleted"])
        symbols = [] if kind == "deleted" else [{"name": rng.choice("fgh"), "label": rng.choice(["Function", "Class"]), "signature": str(rng.randint(0, 2)), "source": f"s{rng.randint(0, 2)}\n"} for _ in range(rng.randint(0, 5))]
        rows.append({"file_path": path, "ts": f"2026-01-01T00:{i:02d}:00", "event_type": kind, "symbols": symbols})
        now = {**now, path: symbols} if kind != "deleted" else {k: v for k, v in now.items() if k != path}
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(0, 60, 7):
        (folder / f"{i:02d}.json").write_text("\n".join(map(json.dumps, rows[i : i + 7])))
        os.utime(folder / f"{i:02d}.json", (1.7e9 + i, 1.7e9 + i))  # a stream takes files by their times
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(folder))
    got = []
    query = state.version_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert len(got) == 60
    seen = {(r.file_path, r.ts): r for r in got}
    df = spark.createDataFrame([(r["file_path"], r["ts"], i, r["event_type"], s["name"], s["label"], s["signature"], k) for i, r in enumerate(rows) for k, s in enumerate(r["symbols"])], "file_path string, at string, i int, event_type string, name string, label string, signature string, ordinal long")
    last, flat = {}, {}
    for i, r in enumerate(rows):
        one = df.where(F.col("i") == i).select("file_path", "name", "label", "signature", "ordinal").collect()
        flat[i] = (last.get(r["file_path"], []), one)
        last[r["file_path"]] = one
    schema = "i int, file_path string, name string, label string, signature string, ordinal long"
    sides = [spark.createDataFrame([(i, *x) for i, v in flat.items() for x in v[side]], schema) for side in (0, 1)]
    diff = changes.snapshot_diff(*sides, keys=("i", "file_path", "name", "label")).collect()
    for i, r in enumerate(rows):
        mine = {c: sorted(d.name for d in diff if d.i == i and d.change == c) for c in ("added", "modified", "removed")}
        if r["event_type"] != "modified":
            mine["modified"] = []
        at = next(v for (p, ts), v in seen.items() if p == r["file_path"] and ts.isoformat() == r["ts"])
        assert {c: at[c] for c in mine} == mine, (i, r)


def test_diffs_of_versions(spark, tmp_path):
    rows = [
        {"file_path": "a", "ts": "2026-01-01T00:00:00", "event_type": "created", "symbols": [{"name": "f", "label": "Function", "signature": "1", "source": "def f(): 1"}]},
        {"file_path": "a", "ts": "2026-01-01T00:00:01", "event_type": "modified", "symbols": [{"name": "f", "label": "Function", "signature": "2", "source": "def f(): 2"}]},
        {"file_path": "a", "ts": "2026-01-01T00:00:02", "event_type": "deleted", "symbols": None},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    got = []
    query = state.version_stream(spark.readStream.schema(ROWS).json(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(got, key=lambda r: r.ts)
    assert [(r.added, r.modified, r.removed) for r in got] == [(["f"], [], []), ([], ["f"], []), ([], [], ["f"])]
    assert got[0].diffs == {"f": "def f(): 1"} and "-def f(): 1" in got[1].diffs["f"] and got[2].diffs == {"f": "def f(): 2"}


def test_ring_of_a_session_equals_the_newest_of_all(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{i % 2}", f"f{rng.randint(0, 9)}.py", f"2026-01-01T{i // 60:02d}:{i % 60:02d}:00", ["a"] * rng.randint(0, 2), ["m"], [], rng.choice(["LOW", "HIGH"]), [rng.choice("xyz")]) for i in range(300)]
    kind = "session string, file_path string, ts timestamp, added array<string>, modified array<string>, removed array<string>, risk string, groups array<string>"
    names = [c.split()[0] for c in kind.split(", ")]
    (tmp_path / "in").mkdir()
    for i in range(0, 300, 80):
        (tmp_path / "in" / f"{i:03d}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows[i : i + 80]))
    last = {}
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = state.session_stream(stream, kept=40, shown=5).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, n: last.update({r.session: r for r in b.collect()})).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    table = spark.read.schema(kind).json(str(tmp_path / "in"))
    for s in ("s0", "s1"):
        mine = table.where(F.col("session") == s)
        top = changes.newest(mine, [F.desc("ts"), F.desc("file_path")], limit=40, kept=40)
        panel = changes.session_panel(mine, [F.desc("ts"), F.desc("file_path")], kept=40).first()
        want = (panel.n, top.select("file_path").distinct().count(), panel.added, panel.modified, panel.removed, panel.high_risk)
        r = last[s]
        assert (r.event_count, r.files_changed, r.added, r.modified, r.removed, r.high_risk) == want
        assert r.groups == sorted({g for x in top.collect() for g in x.groups})
        assert [json.loads(e)["file_path"] for e in r.newest] == [x.file_path for x in changes.newest(mine, [F.desc("ts"), F.desc("file_path")], limit=5).collect()]
