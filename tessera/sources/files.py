"""Repository files as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions and folders of a source listing.
EXTENSIONS = ("py", "js", "ts", "jsx", "tsx", "go", "rs", "java", "kt", "rb", "php", "cs", "c", "cpp", "h", "swift")
IGNORED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", "target", ".next", "coverage", "vendor", ".cache", ".tox")


def list_files(spark: SparkSession, root: str, max_kb: int = 100, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path below root, content, ext, size); larger files are never read past their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_kb * 1024)
    base = root.rstrip("/").removeprefix("file://") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    rows = files.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("size"))
    return rows.where(F.col("ext").isin(*extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))))


def repo_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


#: Own patterns, after each language's grammar: (extensions, what stands before a top-level name that others can use).
_PUBLIC = {
    "py": r"^(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z]\w*)",
    "js|jsx|ts|tsx": r"^export[ \t]+(?:default[ \t]+|declare[ \t]+|abstract[ \t]+|async[ \t]+)*(?:function\*?|class|const|let|var|interface|type|enum)[ \t]+([A-Za-z_$][\w$]*)",
    "go": r"^(?:func(?:[ \t]*\([^()]*\))?|type|var|const)[ \t]+([A-Z]\w*)",
    "rs": r"^pub(?:\([a-z:]+\))?[ \t]+(?:(?:async|unsafe|const)[ \t]+)*(?:fn|struct|enum|trait|type|mod|static)[ \t]+([A-Za-z_]\w*)",
    "java": r"^[ \t]*public[ \t]+(?:(?:static|final|abstract|sealed)[ \t]+)*(?:class|interface|enum|record|@interface)[ \t]+([A-Za-z_]\w*)",
}
_USED = {
    "py": r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([\w.]+))",
    "js|jsx|ts|tsx": r"(?:\bfrom|\brequire[ \t]*\(|\bimport[ \t]*\(?)[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\")",
    "go": r"^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?\"([^\"\n]+)\"[ \t]*$",
    "rs": r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+\w)",
    "java": r"^import[ \t]+(?:static[ \t]+)?([\w.]+\w)",
}
DEFINITIONS = tuple((ext, "(?m)" + p) for ext, p in _PUBLIC.items())
IMPORTS = tuple((ext, "(?m)" + p) for ext, p in _USED.items())


def _matches(rules):
    out = F.expr("cast(array() as array<string>)")
    for ext, pattern in rules:
        groups = [F.regexp_extract_all("content", F.lit(pattern), i + 1) for i in range(re.compile(pattern).groups)]
        # One group of a pattern matches at a time; the others are empty.
        found = groups[0] if len(groups) == 1 else F.zip_with(*groups, lambda a, b: F.concat(a, b))
        out = F.when(F.col("ext").rlike(f"^({ext})$"), found).otherwise(out)
    return F.filter(F.array_distinct(out), lambda x: x != "")


def definitions(files: DataFrame) -> DataFrame:
    """(path, ord, name): definitions in order, each once."""
    return files.select("path", F.posexplode(_matches(DEFINITIONS)).alias("ord", "name"))


def imports(files: DataFrame) -> DataFrame:
    """(path, ord, source)."""
    return files.select("path", F.posexplode(_matches(IMPORTS)).alias("ord", "source"))


def resolve_relative(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, target, weight): relative imports tried with each extension, then as an index file; the first that exists."""
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    raw = F.split(F.concat_ws("/", directory, "source"), "/")
    # ``.`` stays, ``..`` takes one off.
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    joined = F.array_join(F.aggregate(raw, F.expr("cast(array() as array<string>)"), step), "/")
    tails = ["", *(f".{e}" for e in ("ts", "tsx", "js", "jsx", "py")), "/index.ts", "/index.js", "/__init__.py"]
    rows = imports_.where(F.col("source").startswith(".")).select("path", "source", joined.alias("base"))
    rows = rows.select("path", "source", F.posexplode(F.transform(F.array(*map(F.lit, tails)), lambda t: F.concat("base", t))).alias("prio", "target"))
    found = rows.join(files.select(F.col("path").alias("target")), "target").where("target <> path")
    one = found.groupBy("path", "source").agg(F.min_by("target", "prio").alias("target"))
    return one.groupBy("path", "target").agg(F.count("*").alias("weight"))


def package_of(source: Column) -> Column:
    """The package that an import names: what stands before the first dot, colon or slash; relative imports name none."""
    return F.when(source.rlike(r"^[./]"), F.lit(None)).otherwise(F.regexp_extract(source, r"^(@[^/]+/[^/]+|[^.:/]+)", 1))


def resolve_dotted(imports_: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, target): Python imports, relative dots or from the root (or ``src``): the module's file, else its package."""
    dots = F.length(F.regexp_extract("source", r"^(\.*)", 1))
    names = F.replace(F.regexp_replace("source", r"^\.*", ""), F.lit("."), F.lit("/"))
    parts = F.split("path", "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), "/")
    stems = F.when(dots > 0, F.array(F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(names, F.lit(""))))).otherwise(F.array(names, F.concat(F.lit("src/"), names)))
    tried = F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")))))
    rows = imports_.where(F.col("path").endswith(".py")).select("path", "source", F.posexplode(tried).alias("prio", "target"))
    found = rows.join(files.select(F.col("path").alias("target")), "target", "left_semi").where("target <> path")
    return found.groupBy("path", "source").agg(F.min_by("target", "prio").alias("target"))


def resolve_go(imports_: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """(path, source, target): Go imports below ``module``: the first file of that folder that is no test."""
    go = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).groupBy(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")).agg(F.min("path").alias("target"))
    rows = imports_.where(F.col("source").startswith(module + "/") | (F.col("source") == module)).withColumn("dir", F.ltrim(F.substr("source", F.lit(len(module) + 1)), F.lit("/")))
    return rows.join(go, "dir").where("target <> path").select("path", "source", "target").distinct()


def file_graph(imports_: DataFrame, files: DataFrame, go_module: str = "") -> DataFrame:
    """(source, target, weight): imports of files by files of all languages that can be resolved."""
    some = resolve_relative(imports_.where(~F.col("path").endswith(".py")), files).select(F.col("path").alias("source"), "target", "weight")
    rest = resolve_dotted(imports_, files)
    if go_module:
        rest = rest.unionByName(resolve_go(imports_, files, go_module))
    return some.unionByName(rest.groupBy(F.col("path").alias("source"), "target").agg(F.count("*").alias("weight")))


def export_listing(files: DataFrame, max_kb: int = 100) -> DataFrame:
    """Text files of an export: no lock files, no binaries, none above the size."""
    name = F.lower(F.substring_index("path", "/", -1))
    locks = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum")
    binary = r"\.(png|jpe?g|gif|ico|svg|webp|pdf|zip|gz|tar|jar|woff2?|ttf|eot|mp[34]|so|dll|exe|pyc|class|db|sqlite)$"
    return files.where(~name.isin(*locks) & ~name.rlike(binary) & (F.col("size") <= max_kb * 1024))


def without_ignored(files: DataFrame, ignore_lines: DataFrame) -> DataFrame:
    """Files that no line of an ignore file names as a folder, a file or a ``*.ext``; blank lines and comments say nothing."""
    line = ignore_lines.select(F.rtrim(F.trim("line"), F.lit("/")).alias("k")).where("k <> '' and k not like '#%'")
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keys = F.array_distinct(F.concat(parts, heads, F.array(F.concat(F.lit("*"), F.regexp_extract("path", r"(\.[^./]+)$", 1)))))
    hit = files.select("path", F.explode(keys).alias("k")).join(line, "k", "left_semi").select("path")
    return files.join(hit.distinct(), "path", "left_anti")
