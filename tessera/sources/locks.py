"""Manifest and lock files as rows (ecosystem, name, version, depth), and dependency health."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, ecosystem string, name string, version string, depth long"
#: Licences that pass their terms on.
COPYLEFT = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")


def parse_package_lock(text: str) -> list[tuple]:
    """Version 2 and 3 locks list paths below ``node_modules``; version 1 nests."""
    data, out = json.loads(text), []
    for path, x in data.get("packages", {}).items():
        if path:
            out.append(("npm", path.rsplit("node_modules/", 1)[-1], x.get("version", ""), path.count("node_modules/")))
    if out:
        return out
    stack = [(data.get("dependencies", {}), 1)]
    while stack:
        deps, depth = stack.pop()
        for name, x in deps.items():
            out.append(("npm", name, x.get("version", ""), depth))
            stack.append((x.get("dependencies", {}), depth + 1))
    return out


def parse_toml_lock(text: str) -> list[tuple]:
    """``[[package]]`` blocks of uv, poetry and cargo locks: the version belongs to the last name above it."""
    out, name = [], None
    for line in text.splitlines():
        m = re.match(r'(name|version) = "([^"]*)"', line)
        if m and m[1] == "name":
            name = m[2]
        elif m and name:
            out.append(("toml", name, m[2], 1))
            name = None
    return out


def parse_requirements(text: str) -> list[tuple]:
    found = (re.match(r"([A-Za-z0-9_.\-]+)\s*==\s*([^\s;#]+)", x.strip()) for x in text.splitlines())
    return [("pypi", m[1], m[2], 1) for m in found if m]


def parse_go_mod(text: str) -> list[tuple]:
    return [("go", m[1], m[2], 1) for m in re.finditer(r"^\s*(?:require\s+)?([\w.\-/]+\.[\w.\-/]+) (v[\w.\-+]+)", text, re.M)]


def parser_of(path: str):
    name = path.rsplit("/", 1)[-1]
    if name == "package-lock.json":
        return parse_package_lock
    if name in ("uv.lock", "poetry.lock", "Cargo.lock"):
        return parse_toml_lock
    if name == "package.json":
        return parse_package_json
    if name in ("pyproject.toml", "Cargo.toml"):
        return parse_toml_manifest
    if name == "go.mod":
        return parse_go_mod
    return parse_requirements if re.fullmatch(r"requirements.*\.txt", name) else None


def parse_package_json(text: str) -> list[tuple]:
    """Direct dependencies of a package manifest, development ones as well."""
    found = json.loads(text)
    return [("npm", name, str(version), 1) for key in ("dependencies", "devDependencies") for name, version in (found.get(key) or {}).items()]


def parse_toml_manifest(text: str) -> list[tuple]:
    """Direct dependencies of a Python project or a crate: requirement strings, or tables of names."""
    found, out = tomllib.loads(text), []
    for spec in found.get("project", {}).get("dependencies", []):
        m = re.match(r"([A-Za-z0-9][\w.\-]*)\s*(?:\[[^\]]*\])?\s*(.*)", spec)
        out.append(("pypi", m[1], m[2].split(";")[0].strip(), 1))
    tables = [("pypi", found.get("tool", {}).get("poetry", {}).get("dependencies", {}))] + [("cargo", found.get(k, {})) for k in ("dependencies", "dev-dependencies")]
    for kind, table in tables:
        out += [(kind, name, v if isinstance(v, str) else str(v.get("version", "")), 1) for name, v in table.items() if name != "python"]
    return out


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    """Packages of all lock files and manifests below ``path``."""
    return parse_locks(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").cast("string").alias("text")))


def parse_locks(files: DataFrame) -> DataFrame:
    """Packages of the lock files and manifests among ``files`` (path, text)."""

    def run(batches):
        for pdf in batches:
            out = [(p, *row) for p, t in zip(pdf["path"], pdf["text"], strict=True) if (parse := parser_of(p)) for row in parse(t)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def duplicates(packages: DataFrame) -> DataFrame:
    """Packages in more than one version."""
    return packages.groupBy("name").agg(F.countDistinct("version").alias("n_versions"), F.max("version").alias("max_version")).where("n_versions > 1")


def health(packages: DataFrame) -> DataFrame:
    """One row: issues (duplicates), depth and rating: good without issues up to depth 5, moderate up to 3 issues and depth 8, else poor."""
    n = duplicates(packages).agg(F.count("*").alias("issues"))
    depth = packages.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    good = (F.col("issues") == 0) & (F.col("max_depth") <= 5)
    return n.crossJoin(depth).withColumn("rating", F.when(good, "good").when((F.col("issues") <= 3) & (F.col("max_depth") <= 8), "moderate").otherwise("poor"))


def license_conflicts(packages: DataFrame) -> DataFrame:
    """(name, version, license) under copyleft; ``outdated`` marks versions below 1."""
    return packages.where(F.upper("license").isin(*COPYLEFT)).withColumn("outdated", F.col("version").rlike(r"^v?0\."))
