"""Symbols, calls, rankings, skills and renderings against small cases."""

import pytest

from tessera.operators import code, render, skill

PY = """import os

def helper(a, b=1):
    if a and b:
        return go(a)
    return 0

class Box:
    def go(self, x):
        return helper(x, 2)

def lonely():
    for i in range(3):
        pass
"""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def found(spark):
    data = [("a.py", PY, "py"), ("b.ts", "export function run2(x: number) {\n  return helper(x);\n}\nclass T {\n}\n", "ts"), ("n.txt", "def x", "txt"), ("e.go", None, "go")]
    return code.symbols(spark.createDataFrame(data, "path string, content string, ext string"))


def test_symbols_end_with_their_block(found):
    assert rows(found, "path", "name", "kind", "line", "end_line") == [("a.py", "Box", "class", 8, 10), ("a.py", "go", "function", 9, 10), ("a.py", "helper", "function", 3, 6), ("a.py", "lonely", "function", 12, 14), ("b.ts", "T", "class", 4, 5), ("b.ts", "run2", "function", 1, 3)]


def test_calls_prefer_the_file_then_imports_then_the_only_name(spark, found):
    none = spark.createDataFrame([], "path string, target string")
    edges = code.call_graph(found, none)
    assert rows(edges, "caller", "callee", "confidence") == [("a.py::go", "a.py::helper", "direct"), ("a.py::helper", "a.py::go", "direct"), ("b.ts::run2", "a.py::helper", "heuristic")]
    linked = code.call_graph(found, spark.createDataFrame([("b.ts", "a.py")], "path string, target string"))
    assert rows(code.at_least(linked, "imported"), "caller") == [("a.py::go",), ("a.py::helper",), ("b.ts::run2",)]
    assert rows(code.call_summary(found, edges).where("isolated"), "symbol") == [("a.py::Box",), ("a.py::lonely",), ("b.ts::T",)]
    assert rows(code.dead_functions(found, edges), "path", "name") == [("a.py", "lonely"), ("b.ts", "run2")]


def test_complexity(found):
    by = code.complexity(found)
    assert dict(rows(by.where("path = 'a.py'"), "name", "complexity")) == {"helper": 3, "go": 1, "lonely": 2}
    assert rows(code.complexity_by_file(by), "path", "functions", "average", "highest", "hottest")[0] == ("a.py", 3, 2.0, 3, "helper")


def test_module_rank_and_size(spark):
    m = [("src/services/service.py", ["a", "b"], "hint"), ("lib/constants.py", ["a"], None), ("lib/types.ts", ["a"], "hint"), ("tests/test_x.py", [], None), ("web/index.ts", list("abcdef"), None)]
    m = spark.createDataFrame(m, "path string, exports array<string>, summary_hint string")
    assert dict(rows(code.rank_modules(m), "path", "score")) == {"src/services/service.py": 20, "lib/constants.py": -13, "lib/types.ts": -5, "tests/test_x.py": -15, "web/index.ts": -6}
    one = code.size_class(spark.createDataFrame([(f"f{i}", "main") for i in range(21)], "path string, layer string")).first()
    assert (one["size"], one["chapters"], one["files"]) == ("medium", 7, 21)


def test_tests_by_convention(spark):
    files = spark.createDataFrame([("src/a.py",), ("src/test_a.py",), ("b.ts",), ("__tests__/b.spec.ts",), ("c.go",), ("src/main/D.java",), ("src/test/DTest.java",)], "path string")
    tests = code.convention_tests(files, files)
    assert rows(tests, "path", "test") == [("b.ts", "__tests__/b.spec.ts"), ("src/a.py", "src/test_a.py"), ("src/main/D.java", "src/test/DTest.java")]
    assert rows(code.untested(files, tests), "path") == [("c.go",)]


GOOD = """---
name: x
description: d
version: 1
---
# X
## When to use
- call `a/b.py` and `run()`
## Critical Rules
- never `rm -rf /`
## Examples
```py
x = run()
```
"""


def test_skill_scores_and_validation(spark):
    s = skill.score(GOOD)
    assert s["safety"] == s["format"] == s["examples"] + 0.3 == 1.0 and s["agent_readiness"] == 1.0
    assert skill.score("rm -rf / and eval(x)")["safety"] == pytest.approx(0.7)
    docs = spark.createDataFrame([(1, GOOD), (2, ""), (3, None), (4, "{{ x }}<div >")], "i long, t string")
    got = {r.id: r for r in skill.skill_scores(docs, "i", "t").collect()}
    assert got[1].overall > 0.7 and got[2].overall == got[3].overall == 0.0 and got[2].grade == "F"
    assert rows(skill.validate(docs.where("i = 1"), "i", "t"), "rule") == []
    assert {r[0] for r in rows(skill.validate(docs.where("i = 4"), "i", "t"), "rule")} >= {"template_tag", "raw_html", "missing_name"}


def test_renderings(spark):
    edges = spark.createDataFrame([("b", "c.d", 1), ("a", "b", 2)], "source string, target string, weight long")
    nodes = spark.createDataFrame([("b", "l"), ("a", "l")], "id string, layer string")
    assert render.mermaid(edges).first()[0] == "graph LR\n    a --> b\n    b --> c_d"
    assert render.mermaid(edges.limit(0)).first()[0] == "graph LR"
    assert render.dot(edges).first()[0].split("\n")[1] == '  "a" -> "b";'
    assert render.graph_json(nodes, edges).first()[0].startswith('{"nodes":[{"id":"a","layer":"l"}')
    assert render.markdown_table(nodes, ["id"]).first()[0] == "| id | layer |\n| --- | --- |\n| a | l |\n| b | l |"
