"""Names and calls are resolved without sending what grows with the data through the driver."""

import importlib

from codeloom.plans.star import star_graph

resolution_catalog = importlib.import_module("codeloom.resolution_catalog")

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_call_edges_broadcast_nothing(spark, monkeypatch):
    seen, cut = [], resolution_catalog.cut
    monkeypatch.setattr(resolution_catalog, "cut", lambda df: (seen.append(plan(df)), cut(df))[1])
    edges = resolution_catalog.j14_call_edges(star_graph(spark, SF))
    assert len(seen) == 1 and "SortMergeJoin" in seen[0] and "Broadcast" not in seen[0]
    assert "SortMergeJoin" in plan(edges) and "Broadcast" not in plan(edges)
