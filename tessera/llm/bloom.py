"""Filter of fixed size: keeps rows from being dealt out whose key no partner has.

One bit per hash cell. It only saves shuffle: the more keys, the more rows pass without a
partner; joins stay exact at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.lexer import mix

#: The filter holds 2^BITS bits (8 MB), whatever the number of keys.
BITS = 26
#: Parts in which it is put together.
_PART = 20
_FLUSH = 1 << 20


def _cells(key: np.ndarray, bits: int) -> np.ndarray:
    return mix(key.view(np.uint64)) >> np.uint64(64 - bits)


def _dealt(bits: int):
    """Different cells by part, as packed differences."""

    def flushed(held):
        at = np.unique(np.concatenate(held))
        part = (at >> np.uint64(_PART)).astype(np.int32)
        cut = np.searchsorted(part, np.arange((1 << bits - _PART) + 1))
        some = np.flatnonzero(np.diff(cut))
        raw = [np.diff(at[cut[i] : cut[i + 1]] & np.uint64((1 << _PART) - 1), prepend=np.uint64(0)).astype(np.uint32) for i in some]
        blobs = [len(x).to_bytes(4, "little") + pa.Codec("zstd").compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True) for x in raw]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "cells"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_cells(batch.column(0).to_numpy(), bits))
                size += len(held[-1])
            if size >= _FLUSH:
                yield flushed(held)
                held, size = [], 0
        if held:
            yield flushed(held)

    return run


def _united(batches):
    """Rows sorted by part: one row of bits per part."""

    def packed(part, x):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    last, x = None, np.zeros(1 << _PART, bool)
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = blob.as_py()
            n = int.from_bytes(data[:4], "little")
            raw = np.frombuffer(pa.Codec("zstd").decompress(data[4:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
            at = np.cumsum(np.ascontiguousarray(raw.T).view(np.uint32).ravel())
            if part != last and last is not None:
                yield packed(last, x)
                x[:] = False
            last = part
            x[at] = True
    if last is not None:
        yield packed(last, x)


def build(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The filter's 2^bits bits as bytes; ``keys`` has one column of longs."""
    dealt = keys.mapInArrow(_dealt(bits), "part int, cells binary").repartition("part").sortWithinPartitions("part")
    parts = dealt.mapInArrow(_united, "part int, bits binary").toArrow()
    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << _PART - 3
    for part, x in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[part * size : (part + 1) * size] = np.frombuffer(x, np.uint8)
    return out


def among(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = _cells(key, len(bits).bit_length() + 2)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def may_match(keys: DataFrame, key: Column) -> Column:
    """False only where no row of ``keys`` (one column of longs) equals ``key``."""
    sent = keys.sparkSession.sparkContext.broadcast(build(keys))

    @F.arrow_udf("boolean")
    def maybe(k: pa.Array) -> pa.Array:
        return pa.array(among(sent.value, k.to_numpy(zero_copy_only=False)))

    return maybe(key)
