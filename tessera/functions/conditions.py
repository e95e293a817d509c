"""The condition language of chapter templates, compiled to a column.

``or`` splits first, then ``and``; there are no brackets. Atoms: ``has_tech('x')``,
``has_config('x')``, ``has_layer('x')``, ``has_path_match('glob')``, and comparisons
of ``layer_count`` or ``total_files`` with a number; ``not`` before an atom negates it.
"""

from __future__ import annotations

import fnmatch
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CALL = re.compile(r"has_(tech|config|path_match|layer)\(\s*['\"]([^'\"]*)['\"]\s*\)")
_COMPARE = re.compile(r"(layer_count|total_files)\s*(>=|<=|==|!=|>|<)\s*(\d+)")
_OPS = {">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt}


def _atom(text: str, facts: dict[str, Column]) -> Column:
    text = text.strip()
    if text.startswith("not "):
        return ~_atom(text[4:], facts)
    if m := _CALL.fullmatch(text):
        if m[1] == "path_match":
            rule = fnmatch.translate(m[2]).replace(r"\Z", r"\z")
            return F.exists(facts["path"], lambda p: p.rlike("^" + rule))
        return F.array_contains(facts[m[1]], m[2])
    if m := _COMPARE.fullmatch(text):
        return _OPS[m[2]](facts[m[1]], int(m[3]))
    raise ValueError(f"not a condition: {text!r}")


def compile_condition(text: str, facts: dict[str, Column]) -> Column:
    """An empty condition always holds."""
    if not text.strip():
        return F.lit(True)
    out = F.lit(False)
    for any_of in re.split(r"\s+or\s+", text):
        every = F.lit(True)
        for one in re.split(r"\s+and\s+", any_of):
            every = every & _atom(one, facts)
        out = out | every
    return out
