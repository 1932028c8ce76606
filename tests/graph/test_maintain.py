"""A graph kept up with changes of its files, against a whole build after each."""

import random

import pytest

from codeloom.operators.build import build_graph
from codeloom.sources.pysource import parse
from codeloom.streaming import maintain

ROOT = "/w"


@pytest.fixture(autouse=True)
def few_rows(spark):
    """These tables have a few rows each: no time for splitting and compiling."""
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark, files):
    return spark.createDataFrame(sorted(files.items()) or [], "file_path string, source string")


def content(g):
    nodes = {(r.id, r.label, r.name, r.file_path, r.place) for r in g.nodes.collect()}
    order = [r.id for r in g.nodes.orderBy("ordinal").collect()]
    edges = {(r.id, r.source_id, r.target_id, r.edge_type, r.confidence, r.reason, r.line) for r in g.edges.collect()}
    assert len(order) == len(nodes) and g.edges.count() == len(edges)
    return nodes, order, edges


def changed(spark, before, after):
    rows = [(p, "deleted" if p not in after else "created" if p not in before else "modified", after.get(p)) for p in sorted(before.keys() | after.keys()) if before.get(p) != after.get(p)]
    return spark.createDataFrame(rows, "file_path string, event_type string, source string")


BASE = {
    "/w/base.py": "class Base:\n    def save(self, x):\n        pass\n",
    "/w/item.py": "from base import Base\n\n\nclass Item(Base):\n    def show(self):\n        self.save(1)\n",
    "/w/use.py": "from item import Item\n\n\ndef main(i: Item):\n    i.save(2)\n    helper()\n",
    "/w/far.py": "def lonely():\n    pass\n\n\ndef other():\n    lonely()\n",
}
STEPS = [
    # a line above moves every symbol, a decorator comes, a name appears elsewhere
    {"/w/base.py": "# a\n\nclass Base:\n    def save(self, x):\n        pass\n", "/w/far.py": "from deco import wrap\n\n\n@wrap\ndef lonely():\n    pass\n", "/w/deco.py": "def wrap(f):\n    return f\n\n\ndef helper():\n    pass\n"},
    # a class loses its base, a nearer module takes an import
    {"/w/item.py": "from base import Base\n\n\nclass Item:\n    def show(self):\n        self.save(1)\n", "/w/pkg/__init__.py": "", "/w/mybase.py": "class Base:\n    pass\n"},
    # a file goes, arguments change, another no longer parses
    {"/w/base.py": None, "/w/deco.py": "def wrap(f, g, h):\n    return f\n\n\ndef helper(a, b):\n    pass\n", "/w/far.py": "def broken(:\n"},
]


def test_each_kind_of_change(spark):
    after = BASE | STEPS[0] | STEPS[1] | STEPS[2]
    after = {k: v for k, v in after.items() if v is not None}
    kept = maintain.applied(maintain.keep(table(spark, BASE), ROOT), changed(spark, BASE, after))
    assert content(kept.graph) == content(build_graph(parse(table(spark, after)), ROOT))


def test_random_changes(spark):
    rng = random.Random(9)
    names = ["alpha", "beta", "gamma"]

    def source():
        out = [rng.choice(["from m{0} import alpha", "import m{0}", "from . import m{0}", "from .m{0} import beta as b"]).format(rng.randint(0, 3)) for _ in range(rng.randint(0, 2))]
        for c in rng.sample("AB", rng.randint(0, 2)):
            out += [f"class {c}({rng.choice(['', 'A', 'B', 'm1.A'])}):", f"    def {rng.choice(names)}(self, x):", f"        self.{rng.choice(names)}(1)"]
        for _ in range(rng.randint(1, 3)):
            out += ["", f"def {rng.choice(names)}({rng.choice(['', 'q', 'q: A'])}):", f"    v: {rng.choice('AB')} = None", f"    w = {rng.choice('AB')}()", f"    {rng.choice(['v.', 'w.', 'q.', ''])}{rng.choice(names)}({rng.choice(['', '1'])})"]
        return "\n".join(out) + "\n"

    files = {f"/w/m{i}.py": source() for i in range(4)}
    kept = maintain.keep(table(spark, files), ROOT)
    for _ in range(1):
        after = dict(files)
        for path in rng.sample([f"/w/m{i}.py" for i in range(5)], 2):
            if path in after and rng.random() < 0.3:
                del after[path]
            else:
                after[path] = source()
        kept = maintain.applied(kept, changed(spark, files, after))
        files = after
        assert content(kept.graph) == content(build_graph(parse(table(spark, files)), ROOT))


def test_only_changed_files_are_parsed_and_few_resolved(spark, monkeypatch):
    kept = maintain.keep(table(spark, BASE), ROOT)
    parsed, resolved = [], []
    monkeypatch.setattr(maintain, "parse", lambda rows: parsed.extend(r.file_path for r in rows.collect()) or parse(rows))
    edges_of = maintain.edges_of
    monkeypatch.setattr(maintain, "edges_of", lambda mine, *more: resolved.extend(r.file_path for r in mine.collect()) or edges_of(mine, *more))
    after = BASE | {"/w/base.py": "class Base:\n    def save(self, x, y):\n        pass\n"}
    maintain.applied(kept, changed(spark, BASE, after))
    assert parsed == ["/w/base.py"] and sorted(resolved) == ["/w/base.py", "/w/item.py", "/w/use.py"]
