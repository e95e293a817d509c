"""Symbols, calls, complexity and rankings of source files ``(path, content, ext, ...)``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_test_file

SYMBOLS = "path string, name string, kind string, line long, end_line long, params array<string>, body string"
#: (extensions, pattern of a header with groups: indent, kind, name, parameters)
HEADERS = (
    (("py",), re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)\s*(?:\(([^)]*)\))?")),
    (("js", "jsx", "ts", "tsx"), re.compile(r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface)\s+(\w+)\s*(?:\(([^)]*)\))?")),
    (("go",), re.compile(r"^()(func|type)\s+(?:\([^)]*\)\s*)?(\w+)\s*(?:\(([^)]*)\))?")),
    (("rs",), re.compile(r"^(\s*)(?:pub\s+)?(?:async\s+)?(fn|struct|enum|trait)\s+(\w+)\s*(?:\(([^)]*)\))?")),
    (("java",), re.compile(r"^(\s*)(?:(?:public|private|protected|static|final|abstract)\s+)+(class|interface|enum|[\w<>\[\]]+)\s+(\w+)\s*(?:\(([^)]*)\))?")),
)


def symbols_of(text: str, ext: str) -> list[tuple]:
    """(name, kind, line, end_line, params, body): Python bodies end where the indent falls back, others with their brace."""
    header = next((p for kinds, p in HEADERS if ext in kinds), None)
    if not header:
        return []
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        m = header.match(line)
        if not m:
            continue
        end = i
        if ext == "py":
            base = len(m[1])
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= base:
                        break
                    end = j
        else:
            depth, opened = 0, False
            for j in range(i, len(lines)):
                depth += lines[j].count("{") - lines[j].count("}")
                opened |= "{" in lines[j]
                if opened and depth <= 0 or not opened and lines[j].rstrip().endswith(";"):
                    end = j
                    break
        params = [re.split(r"[:=\s]", p.strip())[0] for p in (m[4] or "").split(",") if p.strip()]
        kind = "class" if m[2] in ("class", "interface", "struct", "enum", "trait", "type") else "function"
        out.append((m[3], kind, i + 1, end + 1, [p for p in params if p not in ("self", "cls")], "\n".join(lines[i + 1 : end + 1])))
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols with their bodies; of equal names in a file the last one stays."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, text, ext in zip(pdf["path"], pdf["content"], pdf["ext"], strict=True):
                out += list({s[0]: (path, *s) for s in symbols_of(text or "", ext)}.values())
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SYMBOLS.split(", ")])

    return files.select("path", "content", "ext").mapInPandas(run, SYMBOLS)


#: Names before a bracket that are no calls.
NO_CALLS = ("if", "for", "while", "switch", "return", "catch", "print", "len", "range", "super", "isinstance", "def", "function", "func", "match", "with", "assert", "not", "and", "or", "in")
#: How sure a call edge is, from least to most.
CONFIDENCE = ("heuristic", "linked", "imported", "direct")


def call_graph(found: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller, callee, confidence) of symbols; ``imports`` is (path, target).

    A call goes to the symbol of its name in the same file, else in an imported file,
    else to the only one of that name anywhere. Names after an underscore and calls of
    oneself give no edge.
    """
    sid = F.concat_ws("::", "path", "name")
    calls = found.where("kind = 'function'").select(sid.alias("caller"), "path", "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z]\w*)\s*\("), 1))).alias("call"))
    calls = calls.where(~F.col("call").isin(*NO_CALLS) & (F.col("call") != F.col("name"))).select("caller", "path", "call")
    target = found.select(F.col("path").alias("t_path"), F.col("name").alias("call"), sid.alias("callee"))
    near = calls.join(target, "call")
    hop = imports.select("path", F.col("target").alias("t_path")).distinct().withColumn("imported", F.lit(True))
    alone = Window.partitionBy("caller", "call")
    rank = F.when(F.col("t_path") == F.col("path"), 3).when(F.col("imported"), 2).otherwise(0)
    near = near.join(hop, ["path", "t_path"], "left").withColumn("rank", rank).withColumn("n", F.count("*").over(alone)).where("rank > 0 or n = 1")
    best = near.groupBy("caller", "call").agg(F.max_by("callee", F.struct("rank", "callee")).alias("callee"), F.max("rank").alias("rank"))
    return best.select("caller", "callee", F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("rank") + 1).alias("confidence")).distinct()


def at_least(edges: DataFrame, confidence: str) -> DataFrame:
    """Edges of this confidence or a higher one."""
    return edges.where(F.col("confidence").isin(*CONFIDENCE[CONFIDENCE.index(confidence) :]))


def call_summary(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, calls_in, calls_out, isolated)."""
    ids = found.select(F.concat_ws("::", "path", "name").alias("symbol")).distinct()
    n_in, n_out = edges.groupBy(F.col("callee").alias("symbol")).agg(F.count("*").alias("i")), edges.groupBy(F.col("caller").alias("symbol")).agg(F.count("*").alias("o"))
    rows = ids.join(n_in, "symbol", "left").join(n_out, "symbol", "left").select("symbol", F.coalesce("i", F.lit(0)).alias("calls_in"), F.coalesce("o", F.lit(0)).alias("calls_out"))
    return rows.withColumn("isolated", (F.col("calls_in") == 0) & (F.col("calls_out") == 0))


BRANCHES = r"(^|[^A-Za-z0-9_])(if|elif|for|while|except|catch|case|and|or)([^A-Za-z0-9_]|$)|&&|\|\|"


def complexity(found: DataFrame) -> DataFrame:
    """(path, name, complexity, rating): branches in the body and one; ratings from 5, 10 and 20 up."""
    n = F.regexp_count(F.col("body"), F.lit(BRANCHES)) + 1
    rows = found.where("kind = 'function'").select("path", "name", n.cast("long").alias("complexity"))
    return rows.withColumn("rating", F.when(F.col("complexity") <= 5, "simple").when(F.col("complexity") <= 10, "moderate").when(F.col("complexity") <= 20, "complex").otherwise("very complex"))


def complexity_by_file(functions: DataFrame) -> DataFrame:
    return functions.groupBy("path").agg(F.count("*").alias("functions"), F.round(F.avg("complexity"), 1).alias("average"), F.max("complexity").alias("highest"), F.min_by("name", F.struct(-F.col("complexity"), "name")).alias("hottest"))


#: Files that start a program.
ENTRY_POINTS = ("main.py", "__main__.py", "app.py", "cli.py", "manage.py", "wsgi.py", "asgi.py", "server.py", "index.js", "index.ts", "main.js", "main.ts", "main.go", "main.rs", "lib.rs", "Main.java", "Program.cs", "__init__.py", "mod.rs")


def is_entry_point(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(*ENTRY_POINTS) | path.startswith("cmd/") | is_test_file(path)


def dead_functions(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, name, confidence): functions that nothing calls, outside entry points and private names."""
    rows = found.where("kind = 'function'").where(~is_entry_point(F.col("path")) & ~F.col("name").startswith("_") & ~F.col("name").isin("main", "run", "setup", "init"))
    rows = rows.select("path", "name", F.concat_ws("::", "path", "name").alias("callee")).join(edges.select("callee"), "callee", "left_anti")
    return rows.select("path", "name", F.when(F.col("name").rlike("^[A-Z]"), "medium").otherwise("high").alias("confidence"))


# What makes a module worth describing. Names that are worth it, folders that are, names that are not.
WORTHY_NAMES = ("auth", "authentication", "authorization", "api", "router", "routes", "endpoints", "handler", "handlers", "service", "services", "repository", "repositories", "middleware", "interceptor", "model", "models", "schema", "schemas", "controller", "controllers", "database", "db", "store", "queue", "worker", "job", "task", "gateway", "client", "app", "main", "core", "root", "context", "provider", "hooks", "composables", "layout")
WORTHY_FOLDERS = ("endpoints", "services", "hooks", "api", "routers", "controllers", "handlers", "composables", "store", "stores")
PLAIN_NAMES = ("__init__", "index", "constants", "types", "config", "accessibility", "icons", "basePath", "env")


def _rank_rules() -> list[tuple[int, Column]]:
    """(weight, condition) of a module ``name, path, exports, summary_hint``; all that hold add up."""
    name, path, hinted = F.col("name"), F.col("path"), F.coalesce(F.length("summary_hint"), F.lit(0)) > 0
    return [
        (3, hinted),
        (8, name.isin(*WORTHY_NAMES)),
        (5, path.rlike(f"/({'|'.join(WORTHY_FOLDERS)})/")),
        (-10, name.isin(*PLAIN_NAMES)),
        (-15, F.lower(path).rlike("test|spec")),
        (-8, (name == "index") & (F.size("exports") > 5)),
        (-5, name.isin("types", "constants") & ~hinted),
    ]


def rank_modules(modules: DataFrame) -> DataFrame:
    """(path, score) of (path, exports, summary_hint): two per export and the weights of the rules that hold."""
    named = modules.withColumn("name", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    score = sum((F.when(holds, weight).otherwise(0) for weight, holds in _rank_rules()), 2 * F.size("exports"))
    return named.select("path", score.cast("long").alias("score"))


#: Per size, skills per layer, least exports, files per layer, chapters.
SIZE_LIMITS = {"small": (10, 1, 200, 5), "medium": (5, 2, 150, 7), "large": (3, 3, 100, 9)}


def size_class(modules: DataFrame) -> DataFrame:
    """One row of (path, layer): counts, size class and its limits."""
    n = modules.agg(F.countDistinct("path").alias("files"), F.countDistinct("layer").alias("layers"))
    small, medium = (F.col("files") <= 20) & (F.col("layers") <= 2), (F.col("files") <= 200) & (F.col("layers") <= 5)
    n = n.withColumn("size", F.when(small, "small").when(medium, "medium").otherwise("large"))
    table = F.create_map(*(x for k, v in SIZE_LIMITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    limits = F.element_at(table, F.col("size"))
    return n.select("files", "layers", "size", *(F.get(limits, i).alias(k) for i, k in enumerate(("skills_per_layer", "min_exports", "files_per_layer", "chapters"))))


def convention_tests(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, test): existing files that naming rules make the tests of a changed file."""
    p = F.col("path")
    directory, stem, ext = F.regexp_replace(p, r"[^/]*$", ""), F.regexp_extract(p, r"([^/]+)\.[^./]+$", 1), F.regexp_extract(p, r"\.([^./]+)$", 1)
    name = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    python = F.array(name(directory, "test_", stem, ".py"), name(directory, stem, "_test.py"), name("tests/test_", stem, ".py"), name(directory, "tests/test_", stem, ".py"))
    script = F.array(*(name(directory, x, stem, f".{k}.", ext) for x in ("", "__tests__/") for k in ("test", "spec")), name(directory, "__tests__/", stem, ".", ext))
    java = F.array(*(name(F.replace(directory, F.lit("/main/"), F.lit(to)), stem, f"{k}.java") for to in ("/main/", "/test/") for k in ("Test", "Tests")))
    rust = F.array(name(directory, stem, "_test.rs"), name("tests/", stem, ".rs"))
    some = F.when(ext == "py", python).when(ext.isin("ts", "tsx", "js", "jsx"), script).when(ext == "go", F.array(name(directory, stem, "_test.go"))).when(ext == "java", java).when(ext == "rs", rust)
    rows = changed.select("path", F.explode(F.array_distinct(some)).alias("test"))
    return rows.join(files.select(F.col("path").alias("test")).distinct(), "test").where("path <> test").select("path", "test")


def untested(changed: DataFrame, tests: DataFrame) -> DataFrame:
    return changed.where(~is_test_file(F.col("path"))).join(tests, "path", "left_anti").select("path")


def hotspots(functions: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` functions (path, name, complexity) of highest complexity, a report."""
    return functions.orderBy(F.desc("complexity"), "path", "name").limit(top).select("path", "name", "complexity")
