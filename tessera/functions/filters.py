"""Predicates of paths, texts and rows, and the filters that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes and names of files that hold no code.
NO_CODE_SUFFIXES = (".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".lock", ".png", ".jpg", ".gif", ".svg", ".ico", ".css", ".scss", ".less", ".html", ".xml")
NO_CODE_NAMES = ("package-lock.json", "yarn.lock", "uv.lock", "Cargo.lock", ".gitignore", ".editorconfig", "LICENSE", "README.md")
# The types of facts that belong to a chapter; other chapters take all.
CHAPTER_FACTS = {
    "index.md": (),
    "01-overview.md": ("version", "go_version", "port", "db_engine", "ui_framework"),
    "02-quickstart.md": ("port", "env_var", "cli_command", "go_version", "db_engine"),
    "03-architecture.md": ("endpoint", "port", "env_var", "mcp_tool", "db_engine", "ui_framework", "sync_format"),
    "04-core-mechanisms.md": ("mcp_tool", "struct_field", "env_var", "dedup_mechanism", "sync_format"),
    "05-data-models.md": ("db_table", "struct_field", "fts_ddl", "db_engine", "dedup_mechanism"),
    "06-api-reference.md": ("endpoint", "mcp_tool", "cli_command", "port"),
    "07-dev-guide.md": ("env_var", "cli_command", "go_version", "version"),
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_code_file(path: Column) -> Column:
    """Neither a name nor a suffix without code; a name that only starts with its one dot has no suffix."""
    suffix = F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))
    return ~file_name(path).isin(*NO_CODE_NAMES) & ~suffix.isin(*NO_CODE_SUFFIXES)


def is_test_module(path: Column) -> Column:
    """The wider rule of test selections: names of tests, or a folder of tests below another."""
    return file_name(path).rlike(r"^test_|_test\.(py|go)$|\.test\.[jt]sx?$|\.spec\.[jt]s$") | path.rlike("/(tests|__tests__)/")


def is_skill(text: Column) -> Column:
    """Starts with a head that is opened by a line of three dashes and holds ``name:`` before the next such line."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"^---[ \t]*\r?\n((?s).*?)(?:\r?\n---[ \t]*(?:\r?\n|$)|$)", 1)
    return head.rlike(r"(?m)^name\s*:")


def facts_for(chapter: str, facts: DataFrame, type_col: str = "fact_type") -> DataFrame:
    """The facts that belong to a chapter; all of them for a chapter without a list."""
    return facts.where(F.col(type_col).isin(list(CHAPTER_FACTS[chapter]))) if chapter in CHAPTER_FACTS else facts


def enabled_sections(sections: DataFrame) -> DataFrame:
    """(type, ord) of the sections that are on, in their order; ``sections`` is (type, position, enabled)."""
    # As many rows as a page has sections.
    return sections.where("enabled").select("page", "type", F.row_number().over(Window.partitionBy("page").orderBy("position", "type")).cast("long").alias("ord"))


def stale_first(decisions: DataFrame, stale_only: bool = False) -> DataFrame:
    """(file, line, is_stale, place): decisions with stale ones first, then by file and line within each file's rows."""
    rows = decisions.where("is_stale") if stale_only else decisions
    w = Window.partitionBy("file").orderBy(F.col("is_stale").desc(), "line")
    return rows.select("file", "line", "is_stale", F.row_number().over(w).cast("long").alias("place"))
