"""A round of a path's search leaves the stored edges where they lie."""

from codeloom.operators import traverse
from codeloom.plans.star import star_graph

SF = "/root/testdata/sf0.001"


def test_a_round_moves_no_edges(spark, monkeypatch):
    plans, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = traverse._Side(star_graph(spark, SF), "fn:p1")
        for _ in range(2):
            side.grow()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    scans = [line for p in plans for line in p.splitlines() if "FileScan" in line and "target_id" in line]
    assert len(scans) == 4 and all("Bucketed: true" in line for line in scans)
    ids = [r.id for level in side.rounds for r in level.select("id").collect()]
    assert len(ids) == len(set(ids)) > 10
