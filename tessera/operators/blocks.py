"""Tables that meet block by block in Python: no side is collected or broadcast as a whole, no pair of rows is ever a row of Spark."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(df: DataFrame, n: int, most: int) -> DataFrame:
    """Rows dealt out evenly, at most ``most`` of ``n`` rows to a partition, fewer while cores are left."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-n // most), min(-(-n // 256), 2 * cores), 1))


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """``x`` times 10 ^ ``digits`` as Spark's round() has it: half up on the decimal digits, away from zero."""
    scale = 10.0**digits
    a = np.abs(x) * scale
    out = np.floor(a + 0.5)
    for i in np.flatnonzero(np.abs(a - np.floor(a) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(x < 0, -out, out) + 0.0


def first_k(group: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` rows of highest score in each group, the smallest ``order`` first among equals; NaN is the highest."""
    at = np.lexsort((order, -np.where(np.isnan(score), np.inf, score), group))
    g = group[at]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return at[rank < k]


def values(column: pa.Array, i: int) -> pa.Array:
    """The elements of the list in row ``i``."""
    return column[i].values


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
