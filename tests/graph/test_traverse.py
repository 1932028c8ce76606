"""Label propagation, paths and stored graphs, against plain versions."""

import hashlib
import random
from collections import Counter, deque

import pytest

from codeloom.graph import PropertyGraph
from codeloom.operators import flows, traverse
from codeloom.plans import fixpoint, star, stored


def plain_labels(pairs, rounds=40):
    ways = {}
    for a, b in {tuple(sorted(p)) for p in pairs if p[0] != p[1]}:
        ways.setdefault(a, []).append(b)
        ways.setdefault(b, []).append(a)
    label = {n: n for n in ways}
    for k in range(1, rounds + 1):
        best = {}
        for n in ways:
            votes = Counter(label[m] for m in ways[n])
            most = max(votes.values())
            best[n] = label[n] if votes[label[n]] == most else max(x for x, c in votes.items() if c == most)
        if best == label:
            break
        label = {n: best[n] if hashlib.md5(f"{n}/{k}".encode()).hexdigest()[0] < "8" else label[n] for n in ways}
    return label


def dense_groups_with_a_bridge():
    groups = [[f"{g}{i}" for i in range(8)] for g in "ab"]
    pairs = [(x, y) for g in groups for x in g for y in g if x < y]
    return groups, [*pairs, ("a0", "b7"), ("b7", "a0"), ("a1", "a1")]


def test_labels_keep_dense_groups_with_a_bridge_apart(spark):
    groups, pairs = dense_groups_with_a_bridge()
    edges = spark.createDataFrame([*pairs, (None, "x")], "source_id string, target_id string")
    got = {r.id: r.label for r in fixpoint.propagated_labels(edges).collect()}
    assert got == plain_labels(pairs)
    assert len({got[n] for n in groups[0]}) == len({got[n] for n in groups[1]}) == 1 and got["a0"] != got["b7"]
    assert len({r.component for r in fixpoint.components(edges).collect()}) == 1
    assert fixpoint.propagated_labels(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_labels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(90)]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    assert {r.id: r.label for r in fixpoint.propagated_labels(edges, rounds=12).collect()} == plain_labels(pairs, 12)


def test_weights_count_as_votes(spark):
    edges = spark.createDataFrame([("m", "a", 5.0), ("m", "y", 1.0), ("m", "z", 1.0), ("y", "z", 1.0), ("a", "b", 9.0)], "source_id string, target_id string, w double")
    got = {r.id: r.label for r in fixpoint.propagated_labels(edges, weight="w").collect()}
    assert got["m"] == got["a"] == got["b"] != got["z"]


def small_graph(spark, pairs, types=("CALLS",)):
    names = sorted({n for p in pairs for n in p})
    nodes = spark.createDataFrame([(n, "Function", n, f"/w/{n[0]}/{n}.py", i) for i, n in enumerate(names)], "id string, label string, name string, file_path string, ordinal long")
    edges = spark.createDataFrame([(f"e{i}", a, b, types[i % len(types)], 0.9) for i, (a, b) in enumerate(pairs)], "id string, source_id string, target_id string, edge_type string, confidence double")
    return PropertyGraph(nodes, edges)


def test_communities_by_labels_feed_names_and_cohesion(spark):
    _, pairs = dense_groups_with_a_bridge()
    g = small_graph(spark, pairs)
    members = traverse.communities(g, by="labels")
    assert {(r.size, round(r.cohesion, 3)) for r in traverse.cohesion(members, traverse.symbol_links(g)).collect()} == {(8, 1.0)}
    assert {r.label for r in flows.group_labels(members.join(g.nodes.select("id", "file_path", "ordinal"), "id")).collect()} == {"a", "b"}


def plain_distance(pairs, a, b):
    ways = {}
    for x, y in pairs:
        ways.setdefault(x, set()).add(y)
        ways.setdefault(y, set()).add(x)
    seen, queue = {a: 0}, deque([a])
    while queue:
        n = queue.popleft()
        for m in ways.get(n, ()):
            if m not in seen:
                seen[m] = seen[n] + 1
                queue.append(m)
    return seen.get(b)


def test_paths_from_both_ends_are_shortest_and_hold_together(spark):
    rng = random.Random(8)
    pairs = [(f"n{rng.randint(0, 30):02d}", f"n{rng.randint(0, 30):02d}") for _ in range(34)]
    g = small_graph(spark, pairs, ("CALLS", "IMPORTS"))
    names = sorted({n for p in pairs for n in p})
    edges = {r.id: r for r in g.edges.collect()}
    for a, b in [rng.sample(names, 2) for _ in range(7)] + [[names[0], names[0]]]:
        path = traverse.path_between(g, a, b).orderBy("step").collect()
        want = plain_distance(pairs, a, b)
        assert len(path) == (0 if want is None else want + 1)
        if path:
            assert (path[0].name, path[-1].name, path[0].edge) == (a, b, None)
        for x, y in zip(path, path[1:], strict=False):
            e = edges[y.edge]
            assert {e.source_id, e.target_id} == {x.id, y.id} and e.edge_type == y.edge_type
    assert traverse.path_between(g, names[0], "nobody").count() == 0


def test_a_path_has_no_more_edges_than_asked_for(spark):
    g = small_graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    assert traverse.path_between(g, "n0", "n4", 3).count() == 0 and traverse.path_between(g, "n0", "n4", 4).count() == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_graphs_are_read_by_key(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    g, again = star.star_graph(spark, sf), star.star_graph(spark, sf)
    assert g.edges.inputFiles() == again.edges.inputFiles()
    plain = PropertyGraph(star.bound(spark, sf, star.NODES), star.bound(spark, sf, star.EDGES))
    assert g.edges.columns == plain.edges.columns and g.nodes.columns == plain.nodes.columns
    for mine, other in ((g.nodes, plain.nodes), (g.edges, plain.edges), (g.by_target, plain.edges)):
        assert fixpoint.checksum(mine) == fixpoint.checksum(other)
    assert "EqualTo(target_id,fn:p1)" in plan_of(g.edges_to("fn:p1")) and "EqualTo(source_id,m:o1)" in plan_of(g.edges_from("m:o1"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked = spark.createDataFrame([("fn:p1",)], "target_id string")
        plan = plan_of(g.edges_by("target_id").join(asked, "target_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert plan.count("Exchange hashpartitioning") == 1  # only what is asked is moved
    key, size = stored.fingerprint(spark, [f"{sf}/orders.parquet"])
    assert size > 0 and key != stored.fingerprint(spark, [f"{sf}/part.parquet"])[0]
