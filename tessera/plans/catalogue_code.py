"""Queries on a small repository given as literal rows; the SQL holds the rows that reading it by hand gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import code, documents
from tessera.sources import coverage, files, history, locks

QUERIES, ORACLE_SQL = {}, {}

FILES = {
    "src/app.py": '''from .util import load, save
import os.path


class Base:
    def run(self, x):
        if x and x > 1:
            return load(x)
        return save(x)


class Job(Base):
    def step(self, i):
        return i


def _private():
    pass


def unused(a):
    for i in a:
        if i:
            return i
    return a
''',
    "src/util.py": '''import src.app


def load(n):
    return helper(n)


def save(n):
    return n


def helper(n):
    while n > 3:
        n = n - 1
    return n
''',
    "tests/test_app.py": '''from src.app import unused


def test_unused():
    assert unused([1]) == 1
''',
    "web/main.ts": '''import { greet } from './lib/greet';
import lodash from "lodash/fp";

export async function start(name: string) {
  return greet(name);
}
''',
    "web/lib/greet.ts": '''export function greet(name: string) {
  return name;
}
export interface Greeter {
}
export const shout = 1;
export function whisper(a: string) {
  return a;
}
''',
    "web/lib/greet.test.ts": "import { greet } from './greet';\n",
    "cmd/run.go": '''package main

import (
	"fmt"
	"example.com/tool/pkg"
)

func main() {
	fmt.Println(pkg.Answer())
}
''',
    "pkg/answer.go": "package pkg\n\nfunc Answer() int {\n\treturn 42\n}\n",
    "pkg/answer_test.go": "package pkg\n",
    "poetry.lock": "x\n",
    "docs/logo.png": "x\n",
}
DOCS = {
    1: "See src/app.py and `web/lib/greet.ts` for more.\n\n```\nsrc/hidden.py\n```\nAlso util.py, and gone/away.py.",
    2: "# First\n**bold one** text\n## Second\n**bold two**\n",
    3: None,
}


def query(columns: str, *rows: tuple):
    """The SQL is a list of rows: texts, whole numbers, doubles and nulls."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    def add(f):
        QUERIES[f.__name__] = f
        values = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
        ORACLE_SQL[f.__name__] = f"SELECT * FROM (VALUES {values}) AS v({columns})"
        return f

    return add


def _files(spark):
    rows = [(p, t, p.rsplit(".", 1)[-1], len(t)) for p, t in FILES.items()]
    return spark.createDataFrame(rows, "path string, content string, ext string, size long")


def _texts(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def _symbols(spark):
    return code.symbols(_files(spark))


def _links(spark):
    return files.file_graph(files.imports(_files(spark)), _files(spark), "example.com/tool")


def _calls(spark):
    return code.call_graph(_symbols(spark), _links(spark).select(F.col("source").alias("path"), "target"))


@query(
    "path, ord, name",
    ('pkg/answer.go', 0, 'Answer'),
    ('src/app.py', 0, 'Base'),
    ('src/app.py', 1, 'Job'),
    ('src/app.py', 2, 'unused'),
    ('src/util.py', 0, 'load'),
    ('src/util.py', 1, 'save'),
    ('src/util.py', 2, 'helper'),
    ('tests/test_app.py', 0, 'test_unused'),
    ('web/lib/greet.ts', 0, 'greet'),
    ('web/lib/greet.ts', 1, 'Greeter'),
    ('web/lib/greet.ts', 2, 'shout'),
    ('web/lib/greet.ts', 3, 'whisper'),
    ('web/main.ts', 0, 'start'),
)
def code_definitions(spark, d):
    return files.definitions(_files(spark)).withColumn("ord", F.col("ord").cast("long"))


@query(
    "path, ord, source, package",
    ('cmd/run.go', 0, 'fmt', 'fmt'),
    ('cmd/run.go', 1, 'example.com/tool/pkg', 'example'),
    ('src/app.py', 0, '.util', None),
    ('src/app.py', 1, 'os.path', 'os'),
    ('src/util.py', 0, 'src.app', 'src'),
    ('tests/test_app.py', 0, 'src.app', 'src'),
    ('web/lib/greet.test.ts', 0, './greet', None),
    ('web/main.ts', 0, './lib/greet', None),
    ('web/main.ts', 1, 'lodash/fp', 'lodash'),
)
def code_imports(spark, d):
    return files.imports(_files(spark)).select("path", F.col("ord").cast("long").alias("ord"), "source", files.package_of(F.col("source")).alias("package"))


@query(
    "source, target, weight",
    ('cmd/run.go', 'pkg/answer.go', 1),
    ('src/app.py', 'src/util.py', 1),
    ('src/util.py', 'src/app.py', 1),
    ('tests/test_app.py', 'src/app.py', 1),
    ('web/lib/greet.test.ts', 'web/lib/greet.ts', 1),
    ('web/main.ts', 'web/lib/greet.ts', 1),
)
def code_file_graph(spark, d):
    return _links(spark)


@query(
    "path",
    ('cmd/run.go',),
    ('pkg/answer.go',),
    ('pkg/answer_test.go',),
    ('src/app.py',),
    ('src/util.py',),
    ('tests/test_app.py',),
    ('web/lib/greet.test.ts',),
    ('web/lib/greet.ts',),
    ('web/main.ts',),
)
def code_export_listing(spark, d):
    return files.export_listing(_files(spark)).select("path")


@query(
    "path",
    ('docs/logo.png',),
    ('poetry.lock',),
    ('src/util.py',),
    ('web/main.ts',),
)
def code_without_ignored(spark, d):
    lines = spark.createDataFrame([(x,) for x in ("# comment", "", "tests/", "*.go", "web/lib", "app.py")], "line string")
    return files.without_ignored(_files(spark), lines).select("path")


@query(
    "ext, files, bytes",
    ('go', 3, 158),
    ('ts', 3, 330),
)
def code_stats(spark, d):
    return files.repo_stats(_files(spark).where("ext in ('go', 'ts')"))


@query(
    "path, name, kind, line, end_line, params",
    ('cmd/run.go', 'main', 'function', 8, 10, ''),
    ('pkg/answer.go', 'Answer', 'function', 3, 5, ''),
    ('src/app.py', 'Base', 'class', 5, 9, ''),
    ('src/app.py', 'Job', 'class', 12, 14, 'Base'),
    ('src/app.py', '_private', 'function', 17, 18, ''),
    ('src/app.py', 'run', 'function', 6, 9, 'x'),
    ('src/app.py', 'step', 'function', 13, 14, 'i'),
    ('src/app.py', 'unused', 'function', 21, 25, 'a'),
    ('src/util.py', 'helper', 'function', 12, 15, 'n'),
    ('src/util.py', 'load', 'function', 4, 5, 'n'),
    ('src/util.py', 'save', 'function', 8, 9, 'n'),
    ('tests/test_app.py', 'test_unused', 'function', 4, 5, ''),
    ('web/lib/greet.ts', 'Greeter', 'class', 4, 5, ''),
    ('web/lib/greet.ts', 'greet', 'function', 1, 3, 'name'),
    ('web/lib/greet.ts', 'whisper', 'function', 7, 9, 'a'),
    ('web/main.ts', 'start', 'function', 4, 6, 'name'),
)
def code_symbols(spark, d):
    return _symbols(spark).select("path", "name", "kind", "line", "end_line", F.array_join("params", ",").alias("params"))


@query(
    "caller, callee, confidence",
    ('cmd/run.go::main', 'pkg/answer.go::Answer', 'imported'),
    ('src/app.py::run', 'src/util.py::load', 'imported'),
    ('src/app.py::run', 'src/util.py::save', 'imported'),
    ('src/util.py::load', 'src/util.py::helper', 'direct'),
    ('tests/test_app.py::test_unused', 'src/app.py::unused', 'imported'),
    ('web/main.ts::start', 'web/lib/greet.ts::greet', 'imported'),
)
def code_calls(spark, d):
    return _calls(spark)


@query(
    "symbol, calls_in, calls_out, isolated",
    ('cmd/run.go::main', 0, 1, False),
    ('pkg/answer.go::Answer', 1, 0, False),
    ('src/app.py::Base', 0, 0, True),
    ('src/app.py::Job', 0, 0, True),
    ('src/app.py::_private', 0, 0, True),
    ('src/app.py::run', 0, 2, False),
    ('src/app.py::step', 0, 0, True),
    ('src/app.py::unused', 1, 0, False),
    ('src/util.py::helper', 1, 0, False),
    ('src/util.py::load', 1, 1, False),
    ('src/util.py::save', 1, 0, False),
    ('tests/test_app.py::test_unused', 0, 1, False),
    ('web/lib/greet.ts::Greeter', 0, 0, True),
    ('web/lib/greet.ts::greet', 1, 0, False),
    ('web/lib/greet.ts::whisper', 0, 0, True),
    ('web/main.ts::start', 0, 1, False),
)
def code_call_summary(spark, d):
    return code.call_summary(_symbols(spark), _calls(spark))


@query(
    "caller, callee, confidence",
    ('cmd/run.go::main', 'pkg/answer.go::Answer', 'imported'),
    ('src/app.py::run', 'src/util.py::load', 'imported'),
    ('src/app.py::run', 'src/util.py::save', 'imported'),
    ('src/util.py::load', 'src/util.py::helper', 'direct'),
    ('tests/test_app.py::test_unused', 'src/app.py::unused', 'imported'),
    ('web/main.ts::start', 'web/lib/greet.ts::greet', 'imported'),
)
def code_sure_calls(spark, d):
    return code.at_least(_calls(spark), "imported")


@query(
    "path, name, complexity, rating",
    ('cmd/run.go', 'main', 1, 'simple'),
    ('pkg/answer.go', 'Answer', 1, 'simple'),
    ('src/app.py', '_private', 1, 'simple'),
    ('src/app.py', 'run', 3, 'simple'),
    ('src/app.py', 'step', 1, 'simple'),
    ('src/app.py', 'unused', 3, 'simple'),
    ('src/util.py', 'helper', 2, 'simple'),
    ('src/util.py', 'load', 1, 'simple'),
    ('src/util.py', 'save', 1, 'simple'),
    ('tests/test_app.py', 'test_unused', 1, 'simple'),
    ('web/lib/greet.ts', 'greet', 1, 'simple'),
    ('web/lib/greet.ts', 'whisper', 1, 'simple'),
    ('web/main.ts', 'start', 1, 'simple'),
)
def code_complexity(spark, d):
    return code.complexity(_symbols(spark))


@query(
    "path, functions, average, highest, hottest",
    ('cmd/run.go', 1, 1.0, 1, 'main'),
    ('pkg/answer.go', 1, 1.0, 1, 'Answer'),
    ('src/app.py', 4, 2.0, 3, 'run'),
    ('src/util.py', 3, 1.3, 2, 'helper'),
    ('tests/test_app.py', 1, 1.0, 1, 'test_unused'),
    ('web/lib/greet.ts', 2, 1.0, 1, 'greet'),
    ('web/main.ts', 1, 1.0, 1, 'start'),
)
def code_complexity_by_file(spark, d):
    return code.complexity_by_file(code.complexity(_symbols(spark)))


@query(
    "path, name, confidence",
    ('web/lib/greet.ts', 'whisper', 'high'),
)
def code_dead_functions(spark, d):
    return code.dead_functions(_symbols(spark), _calls(spark))


@query(
    "path, score",
    ('cmd/run.go', 0),
    ('docs/logo.png', 0),
    ('pkg/answer.go', 2),
    ('pkg/answer_test.go', -15),
    ('poetry.lock', 0),
    ('src/app.py', 14),
    ('src/util.py', 9),
    ('tests/test_app.py', -13),
    ('web/lib/greet.test.ts', -15),
    ('web/lib/greet.ts', 8),
    ('web/main.ts', 10),
)
def code_ranked_modules(spark, d):
    names = files.definitions(_files(spark)).groupBy("path").agg(F.collect_list("name").alias("exports"))
    return code.rank_modules(_files(spark).join(names, "path", "left").select("path", F.coalesce("exports", F.array().cast("array<string>")).alias("exports"), F.when(F.col("path") == "src/util.py", "Loads and saves.").alias("summary_hint")))


@query(
    "files, layers, size, skills_per_layer, min_exports, files_per_layer, chapters",
    (11, 7, 'large', 3, 3, 100, 9),
)
def code_size_class(spark, d):
    out = code.size_class(_files(spark).select("path", F.substring_index("path", "/", 1).alias("layer")))
    return out.select("files", "layers", "size", *(F.col(c).cast("long").alias(c) for c in ("skills_per_layer", "min_exports", "files_per_layer", "chapters")))


@query(
    "path, test",
    ('pkg/answer.go', 'pkg/answer_test.go'),
    ('src/app.py', 'tests/test_app.py'),
    ('web/lib/greet.ts', 'web/lib/greet.test.ts'),
)
def code_convention_tests(spark, d):
    return code.convention_tests(_files(spark), _files(spark))


@query(
    "path",
    ('cmd/run.go',),
    ('src/util.py',),
    ('web/main.ts',),
)
def code_untested(spark, d):
    some = _files(spark).where("ext in ('py', 'ts', 'go')")
    return code.untested(some, code.convention_tests(some, some))


@query(
    "type, parent, known",
    ('Cat', 'Animal', True),
    ('Cat', 'Named', False),
    ('Cat', 'Pet', False),
    ('Job', 'Base', True),
    ('Job', 'Mixin', False),
)
def code_type_hierarchy(spark, d):
    types = spark.createDataFrame([("Base", "class Base:"), ("Job", "class Job(Base, Mixin):"), ("Cat", "class Cat extends Animal implements Pet, Named {"), ("Animal", "class Animal {")], "name string, signature string")
    return documents.type_hierarchy(types)


@query(
    "id, ref, status, target",
    (1, 'gone/away.py', 'missing', None),
    (1, 'src/app.py', 'valid', 'src/app.py'),
    (1, 'util.py', 'suffix', 'src/util.py'),
    (1, 'web/lib/greet.ts', 'valid', 'web/lib/greet.ts'),
)
def code_checked_refs(spark, d):
    docs = spark.createDataFrame(list(DOCS.items()), "id long, text string")
    return documents.check_refs(documents.file_refs(docs, "id", "text"), _files(spark))


@query(
    "status, n",
    ('missing', 1),
    ('suffix', 1),
    ('valid', 2),
)
def code_ref_counts(spark, d):
    out = code_checked_refs(spark, d)
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "id, topics",
    (1, ''),
    (2, 'First|Second|bold one|bold two'),
    (3, ''),
)
def code_page_topics(spark, d):
    docs = spark.createDataFrame(list(DOCS.items()), "id long, text string")
    return documents.page_topics(docs, "id", "text").select("id", F.array_join("topics", "|").alias("topics"))


@query(
    "chapter, stale",
    ('a', True),
    ('b', False),
    ('c', True),
)
def code_drift(spark, d):
    chapters = spark.createDataFrame([("a", "src/app.py"), ("a", "src/util.py"), ("b", "web/main.ts"), ("c", "pkg/answer.go")], "chapter string, path string")
    now = _files(spark).select("path", "content")
    before = now.withColumn("content", F.when(F.col("path") == "src/util.py", "0").otherwise(F.col("content")))
    return documents.drift(documents.content_hashes(chapters.where("chapter <> 'c'"), before), documents.content_hashes(chapters, now))


@query(
    "id, iterations",
    ('x', 2),
    ('y', 1),
    ('z', 3),
)
def code_refinements(spark, d):
    scores = [("x", 1, 0.5), ("x", 2, 0.7), ("x", 3, 0.9), ("y", 1, 0.66), ("z", 1, 0.1), ("z", 2, 0.2), ("z", 3, 0.3)]
    return documents.first_passing(spark.createDataFrame(scores, "id string, iteration long, overall double"))


# Reports, locks and manifests

REPORTS = {
    "a/coverage.xml": '<?xml version="1.0"?><coverage line-rate="0.5"><packages><package name="p"><classes><class filename="p/x.py"><lines><line number="1" hits="1"/><line number="2" hits="0"/><line number="3" hits="2"/><line number="4" hits="0" branch="true" condition-coverage="50% (1/2)"/></lines></class></classes></package></packages></coverage>',
    "b/lcov.info": "TN:\nSF:web/a.ts\nFNF:2\nFNH:1\nLF:10\nLH:7\nBRF:4\nBRH:1\nend_of_record\nSF:web/b.ts\nLF:0\nLH:0\nend_of_record\n",
    "c/coverage.json": '{"meta": {}, "files": {"m/y.py": {"summary": {"covered_lines": 3, "missing_lines": 1, "percent_covered": 75.0}}}}',
    "d/readme.md": "nothing",
}
LOCKS = {
    "n/package-lock.json": '{"lockfileVersion": 3, "packages": {"": {"name": "x"}, "node_modules/a": {"version": "1.0.0"}, "node_modules/b": {"version": "2.0.0"}, "node_modules/b/node_modules/a": {"version": "0.9.0"}}}',
    "p/uv.lock": '[[package]]\nname = "click"\nversion = "8.1.7"\n\n[[package]]\nname = "idna"\nversion = "3.6"\n',
    "r/requirements.txt": "flask==3.0.0\n# comment\nrequests>=2.0\n",
    "g/go.mod": "module example.com/tool\n\nrequire (\n\tgithub.com/x/y v1.2.3\n)\n",
    "m/package.json": '{"dependencies": {"react": "^18.0.0"}, "devDependencies": {"vite": "5"}}',
    "y/pyproject.toml": '[project]\ndependencies = ["numpy>=1.26", "uvicorn[standard] ~= 0.30; python_version > \'3.9\'"]\n\n[tool.poetry.dependencies]\npython = "^3.12"\nhttpx = {version = "0.27"}\n',
    "z/Cargo.toml": '[package]\nname = "t"\n\n[dependencies]\nserde = { version = "1.0", features = ["derive"] }\n\n[dev-dependencies]\nrand = "0.8"\n',
}


@query(
    "kind, path, lines_covered, lines_total, line_rate",
    ('cobertura', 'p/x.py', 2, 4, 0.5),
    ('coverage_py', 'm/y.py', 3, 4, 0.75),
    ('lcov', 'web/a.ts', 7, 10, 0.7),
    ('lcov', 'web/b.ts', 0, 0, None),
)
def coverage_reports(spark, d):
    out = coverage.parse_reports(_texts(spark, REPORTS))
    return out.select(F.col(out.columns[0]).alias("kind"), "path", "lines_covered", "lines_total", F.round(F.try_divide(F.col("lines_covered").cast("double"), F.col("lines_total")), 4).alias("line_rate"))


@query(
    "path, ecosystem, name, version, depth",
    ('g/go.mod', 'go', 'github.com/x/y', 'v1.2.3', 1),
    ('m/package.json', 'npm', 'react', '^18.0.0', 1),
    ('m/package.json', 'npm', 'vite', '5', 1),
    ('n/package-lock.json', 'npm', 'a', '0.9.0', 2),
    ('n/package-lock.json', 'npm', 'a', '1.0.0', 1),
    ('n/package-lock.json', 'npm', 'b', '2.0.0', 1),
    ('p/uv.lock', 'toml', 'click', '8.1.7', 1),
    ('p/uv.lock', 'toml', 'idna', '3.6', 1),
    ('r/requirements.txt', 'pypi', 'flask', '3.0.0', 1),
    ('y/pyproject.toml', 'pypi', 'httpx', '0.27', 1),
    ('y/pyproject.toml', 'pypi', 'numpy', '>=1.26', 1),
    ('y/pyproject.toml', 'pypi', 'uvicorn', '~= 0.30', 1),
    ('z/Cargo.toml', 'cargo', 'rand', '0.8', 1),
    ('z/Cargo.toml', 'cargo', 'serde', '1.0', 1),
)
def dependency_rows(spark, d):
    return locks.parse_locks(_texts(spark, LOCKS))


@query(
    "issues, max_depth, rating",
    (1, 2, 'moderate'),
)
def dependency_health(spark, d):
    return locks.health(locks.parse_locks(_texts(spark, LOCKS)))


@query(
    "name, version, license, outdated",
    ('b', '0.3.0', 'GPL-3.0', True),
    ('c', '2.0', 'agpl-3.0', False),
)
def license_conflicts(spark, d):
    rows = [("a", "1.0.0", "MIT"), ("b", "0.3.0", "GPL-3.0"), ("c", "2.0", "agpl-3.0"), ("d", "0.1", None)]
    return locks.license_conflicts(spark.createDataFrame(rows, "name string, version string, license string"))


# History as text

LOG = "\x1eaaa\x1fAda\x1f1700000000\x1ffeat: one\x1fbody text\n\x1f\n\nsrc/app.py\nsrc/util.py\n\x1ebbb\x1fBo\x1f1700000100\x1ffix: two\x1f\x1f\n\nsrc/app.py\nsrc/app.py\n\x1eccc\x1fAda\x1f1700000200\x1fempty\x1f\x1f\n"


def _log(spark):
    return history.parse_log(spark.createDataFrame([(LOG,)], "text string"))


@query(
    "sha, author, ts, subject, body, n_paths",
    ('aaa', 'Ada', 1700000000, 'feat: one', 'body text', 2),
    ('bbb', 'Bo', 1700000100, 'fix: two', '', 1),
    ('ccc', 'Ada', 1700000200, 'empty', '', 0),
)
def log_commits(spark, d):
    return _log(spark).select("sha", "author", "ts", "subject", "body", F.size("paths").cast("long").alias("n_paths"))


@query(
    "sha, author, path",
    ('aaa', 'Ada', 'src/app.py'),
    ('aaa', 'Ada', 'src/util.py'),
    ('bbb', 'Bo', 'src/app.py'),
)
def log_paths(spark, d):
    return history.commit_paths(_log(spark))


@query(
    "path, status, old_path",
    ('b.py', 'renamed', 'a.py'),
    ('link', 'other', None),
    ('new.py', 'added', None),
    ('old.py', 'deleted', None),
    ('src/app.py', 'modified', None),
)
def diff_paths(spark, d):
    return history.parse_name_status(spark.createDataFrame([("A\tnew.py\nM\tsrc/app.py\nD\told.py\nR097\ta.py\tb.py\nT\tlink\n",)], "text string"))


@query(
    "path, author, lines",
    ('src/app.py', 'Ada', 2),
    ('src/app.py', 'Bo', 1),
)
def blame_lines(spark, d):
    text = "abc 1 1 2\nauthor Ada\n\tx = 1\nabc 2 2\nauthor Ada\n\ty = 2\ndef 3 3 1\nauthor Bo\n\tauthor = 3\n"
    return history.parse_blame(spark.createDataFrame([("src/app.py", text)], "path string, text string"))
