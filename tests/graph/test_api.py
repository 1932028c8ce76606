import json
import subprocess

import pytest
from pyspark.sql import DataFrame

from codeloom.api import CodeGraph, Tools, main
from codeloom.operators import views
from tests.graph.test_build import FILES


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for name, text in FILES.items():
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=a@b.c", *a], cwd=root, check=True, capture_output=True)
    git("init")
    for i in range(3):
        (root / "views.py").write_text(FILES["views.py"] + "\n" * i)
        (root / "utils.py").write_text(FILES["utils.py"] + "\n" * i)
        git("add", "-A")
        git("commit", "-m", "c", "--allow-empty")
    return Tools(CodeGraph(spark, str(root)))


def names(rows, column="name"):
    return sorted(r[column] for r in rows.select(column).collect())


def test_methods_of_a_graph(tools):
    code = tools.code
    assert {r.metric: r["count"] for r in code.analyze().collect()}["Files"] == len(FILES)
    assert {"main", "name", "save", "show", "views.py"} <= set(names(code.impact("check")))
    assert names(code.query("by_pattern", pattern="ma*")) == ["main"] and code.query("no such").collect() == []
    assert code.cycles().collect() == [] and "alone" in names(code.orphans())
    assert code.export("dot").where("part = 0").count() == code.graph.nodes.count() and code.export().count() > 0
    assert code.health().count() >= 1 and code.trace("main").columns


def test_every_tool_answers(tools):
    given = {"context": {"name": "main"}, "impact": {"target": "check"}, "graph_query": {"query_type": "callers_of", "name": "check"}, "co_change": {"file_path": "views.py"}}
    assert len(Tools.names()) == 17
    for name in Tools.names():
        found = tools.call(name, given.get(name))
        assert isinstance(found, DataFrame), (name, found)
        found.collect()
    assert names(tools.call("hotspot_report"), "change_count") == [1, 1, 1, 3, 3]
    assert tools.call("co_change", {"file_path": "views.py"}).count() == 1
    assert tools.call("safe_to_modify", {"file_path": "models.py"}).head().node_count == 4


def test_errors_and_lines(tools):
    assert "error" in tools.call("nothing") and "error" in tools.call("context") and "error" in tools.call("impact", {"target": "x", "direction": "sideways"})
    assert "error" in json.loads(next(tools.respond("not json"))) and "error" in json.loads(next(tools.respond('{"resource": "graph://no"}')))
    lines = [json.loads(x) for x in tools.respond('{"tool": "complexity", "arguments": {"name": "main"}}')]
    assert [x["name"] for x in lines] == ["main"]
    assert {json.loads(x)["metric"] for x in tools.respond('{"resource": "graph://context"}')} >= {"Files", "Call edges"}


def test_page_and_command_line(tools, spark, capsys):
    page = views.page_graph(tools.code.graph, 3)
    assert page.nodes.count() == 3 and "File" not in names(page.nodes, "label") and views.page_graph(tools.code.graph, 500, True, ("IMPORTS",)).edges.count() == 3
    assert main([tools.code.root, "--impact", "check"], spark) == 0 and "main" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["/no/such/folder"], spark)
