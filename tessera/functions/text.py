"""Scalar text and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"


def tokens(text: Column) -> Column:
    """Lower-cased words after ASCII punctuation became spaces."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " ")
    return F.filter(F.split(clean, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def n_tokens(text: Column) -> Column:
    """How many ``tokens`` there are, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B!-/:-@\[-`{-~]+"))


def camel_tokens(text: Column) -> Column:
    return tokens(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))


def token_estimate(text: Column, least: int = 1) -> Column:
    """A quarter of the characters, rounded down; ``least`` 0 for the plain rule."""
    return F.greatest(F.lit(least), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")).cast("long")


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def is_test_file(path: Column) -> Column:
    """Per-language naming rules; a ``.py`` file is decided by its name alone."""
    name = F.substring_index(path, "/", -1)
    return (
        F.when(name.endswith(".py"), name.rlike(r"^(test_.*|.*_test|conftest)\.py$"))
        .when(name.rlike(r"\.(test|spec)\.[jt]sx?$") | path.rlike(r"(^|/)__tests__/"), True)
        .when(name.endswith(".go"), name.endswith("_test.go"))
        .when(name.endswith(".rs"), path.rlike(r"(^|/)tests/") | name.endswith("_test.rs"))
        .when(name.endswith(".java"), name.rlike(r"Tests?\.java$"))
        .otherwise(False)
    )


def layer_of(path: Column) -> Column:
    """The first directory that names a layer."""
    rules = (("frontend", "frontend|client|web|ui"), ("backend", "backend|server|api"), ("shared", "shared|common|lib"), ("infra", "infra|deploy|k8s"))
    out = F.lit("main")
    for name, words in reversed(rules):
        out = F.when(path.rlike(rf"(^|/)({words})/"), name).otherwise(out)
    return out
