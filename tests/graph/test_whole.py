"""The queries over whole tables against plain versions that read the tables themselves."""

from collections import defaultdict

import duckdb

from codeloom.catalog import queries

SF = "/root/testdata/sf0.001"


def event_links():
    last, links = {}, set()
    for day, kind, user in duckdb.sql(f"SELECT CAST(ts AS DATE), event_type, user_id FROM '{SF}/events.parquet' ORDER BY ts, event_id").fetchall():
        if (day, kind) in last:
            links.add((f"{day}/{last[day, kind]}", f"{day}/{user}"))
        last[day, kind] = user
    return links


def reached(links):
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)
    far = {}
    for a in {x for pair in links for x in pair}:
        seen, todo = set(), [a]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        far[a] = seen
    return far


def test_all_events_make_the_graph(spark):
    links = event_links()
    assert len({x for pair in links for x in pair}) > 350
    far = reached(links)
    cycles = {a: {b for b in far[a] if a in far[b]} for a in far if a in far[a]}
    got = {(r.id, r.scc, r.size) for r in queries()["t3_cycles"](spark, SF).collect()}
    assert got == {(a, min(m), len(m)) for a, m in cycles.items()}
    both = links | {(b, a) for a, b in links}
    joined = reached(both)
    got = {(r.id, r.component) for r in queries()["t4_components"](spark, SF).collect()}
    assert got == {(a, min(m | {a})) for a, m in joined.items()}
    groups = defaultdict(set)
    for a, m in joined.items():
        groups[min(m | {a})].add(a)
    inner = {g: len({(a, b) for a, b in both if a in m and a != b}) for g, m in groups.items()}
    got = {(r.component, r.size, r.links, round(r.cohesion, 9)) for r in queries()["t6_cohesion"](spark, SF).collect()}
    assert got == {(g, len(m), inner[g], round(1.0 if len(m) <= 1 else inner[g] / (len(m) * (len(m) - 1)), 9)) for g, m in groups.items()}


def test_every_key_is_looked_up(spark):
    orders = {r[0] for r in duckdb.sql(f"SELECT o_orderkey FROM '{SF}/orders.parquet' JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey").fetchall()}
    methods = {f"m:o{k}" for k in orders}
    assert {r.id for r in queries()["j6_lookup_member"](spark, SF).collect()} == methods
    others = sum(duckdb.sql(f"SELECT count(*) FROM '{SF}/{t}.parquet'").fetchall()[0][0] for t in ("nation", "nation", "customer", "part", "supplier"))
    for name in ("j3_lookup_exact", "j4_lookup_global"):
        found = [r.id for r in queries()[name](spark, SF).collect()]
        assert len(found) == len(set(found)) == len(methods) + others and methods <= set(found)
