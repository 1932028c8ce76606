"""Clients of a stream at different paces, and names found by their trigrams."""

import json
import os

from codeloom.operators import grams
from codeloom.streaming.fanout import FanOut


def test_a_slow_client_is_dropped_and_a_fast_one_gets_all(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    fan = FanOut(str(tmp_path / "fan"), queue=10, order=("ts", "n"))
    fan.add_client("fast")
    fan.add_client("slow")
    stream = spark.readStream.schema("ts long, n int").option("maxFilesPerTrigger", 1).json(str(folder))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(fan).start()
    got, n = [], 0
    try:
        for k in range(5):
            part = tmp_path / "part"
            part.write_text("\n".join(json.dumps({"ts": k, "n": n + i}) for i in range(4)))
            n += 4
            os.rename(part, folder / f"{k}.json")
            query.processAllAvailable()
            got += fan.read("fast")
            if k == 1:
                assert len(fan.read("slow", 3)) == 3
    finally:
        query.stop()
    assert [json.loads(f.split("data: ")[1])["n"] for f in got] == list(range(20)) and got[0].startswith("event: change\n")
    assert fan.read("slow") is None and fan.clients == ["fast"]
    again = FanOut(str(tmp_path / "fan"), queue=10)
    assert again.read("fast") == [] and again.state["total"] == 20
    again.push(spark.createDataFrame([(9, 9)], "ts long, n int"), again.state["batch"])
    assert again.state["total"] == 20
    again.add_client("late")
    again.push(spark.createDataFrame([(9, i) for i in range(11)], "ts long, n int"), again.state["batch"] + 1)
    assert again.clients == [] and len(again.state["frames"]) == 10


def test_names_by_trigrams_equal_a_scan(spark):
    names = ["parse_file", "Parser", "parsed", "sparse", "PARS", "ab", "", None, "a_parse", "éparse", "aaaa"]
    nodes = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)] + [("x", "parsed")], "id string, name string")
    index = grams.build_grams(nodes, 2)
    for part in ("pars", "PARSE", "arse", "se_f", "b", "", "aaa", "zzz", "éparse"):
        want = {r.id for r in nodes.collect() if r.name is not None and part.lower() in r.name.lower()}
        assert {r.id for r in grams.nodes_with(spark, index, part).collect()} == want, part
        want = {r.id for r in nodes.collect() if r.name is not None and part in r.name}
        assert {r.id for r in grams.nodes_with(spark, index, part, ignore_case=False).collect()} == want, part
    plan = grams.names_with(spark, index, "parse")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan  # only these lists are read
