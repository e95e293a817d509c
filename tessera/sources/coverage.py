"""Coverage reports as rows: (source_format, path, line_rate, branch_rate, lines_covered, lines_total, branches_covered, branches_total)."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_format string, path string, line_rate double, branch_rate double, lines_covered long, lines_total long, branches_covered long, branches_total long"


def _row(kind, path, lc, lt, bc=None, bt=None):
    return kind, path, lc / lt if lt else None, bc / bt if bt else None, lc, lt, bc, bt


def parse_cobertura(text: str) -> list[tuple]:
    out = []
    for c in ET.fromstring(text).iter("class"):
        lines = c.findall("./lines/line")
        bc = bt = 0
        for x in lines:
            share = x.get("condition-coverage", "")
            if "(" in share:
                a, b = share[share.index("(") + 1 : share.index(")")].split("/")
                bc, bt = bc + int(a), bt + int(b)
        out.append(_row("cobertura", c.get("filename"), sum(int(x.get("hits", 0)) > 0 for x in lines), len(lines), bc, bt))
    return out


def parse_lcov(text: str) -> list[tuple]:
    out, path, n = [], None, {}
    for line in text.splitlines():
        key, _, value = line.strip().partition(":")
        if key == "SF":
            path, n = value, {}
        elif key in ("LH", "LF", "BRH", "BRF"):
            n[key] = int(value)
        elif key == "end_of_record" and path is not None:
            out.append(_row("lcov", path, n.get("LH", 0), n.get("LF", 0), n.get("BRH"), n.get("BRF")))
            path = None
    return out


def parse_coverage_py(text: str) -> list[tuple]:
    out = []
    for path, x in json.loads(text).get("files", {}).items():
        s = x["summary"]
        covered, missing = s["covered_lines"], s["missing_lines"]
        out.append(("coverage_py", path, s["percent_covered"] / 100, None, covered, covered + missing, s.get("covered_branches"), s.get("num_branches")))
    return out


def parse_jacoco(text: str) -> list[tuple]:
    out = []
    for p in ET.fromstring(text).iter("package"):
        for f in p.findall("sourcefile"):
            n = {c.get("type"): (int(c.get("covered")), int(c.get("missed"))) for c in f.findall("counter")}
            (lc, lm), (bc, bm) = n.get("LINE", (0, 0)), n.get("BRANCH", (0, 0))
            out.append(_row("jacoco", f"{p.get('name')}/{f.get('name')}", lc, lc + lm, bc, bc + bm))
    return out


def detect(path: str, head: str) -> str | None:
    """Format by file name, then by the first 500 characters."""
    name = path.rsplit("/", 1)[-1].lower()
    head = head[:500]
    if name.endswith(".info") or head.startswith(("TN:", "SF:")):
        return "lcov"
    if name.endswith(".json") and '"files"' in head:
        return "coverage_py"
    if "<report" in head and "jacoco" in (name + head).lower():
        return "jacoco"
    if "<coverage" in head:
        return "cobertura"
    return None


PARSERS = {"cobertura": parse_cobertura, "lcov": parse_lcov, "coverage_py": parse_coverage_py, "jacoco": parse_jacoco}


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all reports below ``path``."""
    return parse_reports(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").cast("string").alias("text")))


def parse_reports(files: DataFrame) -> DataFrame:
    """Rows of the reports among ``files`` (path, text); files of no known format give none."""

    def run(batches):
        for pdf in batches:
            out = [row for p, t in zip(pdf["path"], pdf["text"], strict=True) if (kind := detect(p, t)) for row in PARSERS[kind](t)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def rollup(rows: DataFrame, key: str) -> DataFrame:
    """Covered and total lines per ``key`` and their share, null without lines."""
    return rows.groupBy(key).agg(F.sum("lines_covered").alias("lines_covered"), F.sum("lines_total").alias("lines_total"), F.round(F.try_divide(F.sum("lines_covered").cast("double"), F.sum("lines_total")), 6).alias("line_rate"))


def worst_files(rows: DataFrame, k: int = 30) -> DataFrame:
    badge = F.when(F.col("line_rate") >= 0.8, "green").when(F.col("line_rate") >= 0.6, "yellow").otherwise("red")
    return rows.where("line_rate is not null").orderBy("line_rate", "path").limit(k).withColumn("badge", badge)
