"""Entry scores, orphans, tests and flows of random graphs with telling names, against plain versions."""

import random
from collections import Counter, deque

import pytest

from codeloom.graph import PropertyGraph
from codeloom.operators import flows, traverse

NAMES = ["main", "run", "start", "execute", "handle_x", "on_y", "process_z", "dispatch_w", "plain", "test_a", "setup", "Main", "other"]


def made(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{i:02d}", rng.choice(["Function", "Method", "Class"]), rng.choice(NAMES), rng.choice(["/w/a.py", "/w/test_b.py", "/w/c_test.py", "/w/d.py"]), i) for i in range(30)]
    edges = [(f"e{i:02d}", f"n{rng.randint(0, 29):02d}", f"n{rng.randint(0, 29):02d}", rng.choice(["CALLS"] * 4 + ["CONTAINS", "EXTENDS"]), rng.choice([0.5, 0.9, 0.95])) for i in range(45)]
    g = PropertyGraph(spark.createDataFrame(nodes, "id string, label string, name string, file_path string, ordinal long"), spark.createDataFrame(edges, "id string, source_id string, target_id string, edge_type string, confidence double"))
    return g, nodes, edges


def bonus(name):
    n = name.lower()
    fixed = {"main": 3.0, "run": 2.0, "start": 2.0, "execute": 1.5}
    return fixed.get(n) or next((b for p, b in (("handle_", 2.5), ("on_", 2.0), ("process_", 1.5), ("dispatch_", 1.5)) if n.startswith(p)), 0.0)


def scores(nodes, edges):
    out, into = (Counter(e[k] for e in edges if e[3] == "CALLS") for k in (1, 2))
    return {i: (out[i] - 1.5 * into[i] + bonus(n) if out[i] else 0.0) for i, label, n, _, _ in nodes if label != "Class"}


def is_test(path):
    name = path.rsplit("/", 1)[-1]
    return name.startswith("test_") or name.endswith("_test.py")


@pytest.mark.parametrize("seed", range(2))
def test_scores_orphans_and_tests(spark, seed):
    g, nodes, edges = made(spark, seed)
    assert {r.id: r.score for r in traverse.entry_scores(g).collect()} == scores(nodes, edges)
    used = {e[2] for e in edges if e[3] != "CONTAINS"}
    entry = lambda n: n in traverse.ENTRY_NAMES or n.startswith(traverse.ENTRY_PREFIXES)
    assert {r.id for r in traverse.orphans(g).collect()} == {i for i, _, n, p, _ in nodes if i not in used and not entry(n) and not is_test(p)}
    paths, names = {n[0]: n[3] for n in nodes}, {n[0]: n[2] for n in nodes}
    callers = {}
    for _, s, t, kind, _ in edges:
        if kind == "CALLS":
            callers.setdefault(t, set()).add(s)
    want = set()
    for seed_id in ("n00", "n07"):
        seen, queue, found = {seed_id}, deque([(seed_id, 0)]), {}
        while queue:
            at, d = queue.popleft()
            for s in sorted(callers.get(at, set()) - seen):
                seen.add(s)
                if is_test(paths[s]):
                    found.setdefault((paths[s], names[s]), d + 1)
                else:
                    queue.append((s, d + 1))
        want |= {(seed_id, *k, d) for k, d in found.items()}
    seeds = spark.createDataFrame([("n00", "n00"), ("n07", "n07")], "seed string, id string")
    assert {tuple(r) for r in traverse.suggest_tests(g, seeds).select("seed", "file_path", "name", "depth").collect()} == want


def test_flows_of_many_steps(spark):
    g, nodes, edges = made(spark, 5)
    order = {n[0]: n[4] for n in nodes}
    steps = {}
    for e in sorted((e for e in edges if e[3] == "CALLS"), key=lambda e: (-e[4], e[0])):
        if len(steps.setdefault(e[1], [])) < 2:
            steps[e[1]].append(e[2])
    want = []
    for entry, score in sorted(scores(nodes, edges).items(), key=lambda x: (-x[1], order[x[0]])):
        if score > 0:
            queue, seen = deque([[entry]]), set()
            while queue:
                path = queue.popleft()
                onward = [] if len(path) > 4 else [path + [t] for t in steps.get(path[-1], []) if t not in path]
                queue.extend(onward)
                if not onward and len(path) >= 3 and tuple(path) not in seen:
                    seen.add(tuple(path))
                    want.append(path)
    got = [r.path for r in flows.execution_flows(g, max_depth=4, max_branching=2, min_steps=3, max_processes=6).collect()]
    assert got == want[:6] and max(map(len, want)) > 3
