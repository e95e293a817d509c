"""Benchmark decontamination by winnowing.

Every run of ``WINDOW`` words has ``WINDOW - GRAM + 1`` k-grams; the smallest of their
hashes is the run's fingerprint. Equal runs have equal fingerprints, so joining the
fingerprints of the documents with those of the benchmark finds every shared run. Each
hit is then extended to the whole runs around it, whose words are compared exactly.
Items of fewer words are runs of their own length, with one fingerprint each.

Both sides are tables. Only what the documents may share is dealt out: two filters of
fixed size, of the benchmark's fingerprints and of its runs, are broadcast, and a run
passes if both may hold it. Neighbouring runs mostly share the fingerprint, so only its changes
are looked up. The benchmark itself is never collected; a run that many items share
and many documents hold meets each document once for the words and once per item.

Null and word-less texts have no words and no hits; word-less items occur nowhere.
Repeated items count once per ``item_id``, a null ``item_id`` never. Rows equal in
``doc_id`` and text have equal results and each a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm import bloom
from tessera.llm.common import settle
from tessera.llm.lexer import alnum_lexer, grams, inside, mix, text_parts

WINDOW = 10
GRAM = 5
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
#: Runs that a task turns into text at once.
_CHUNK = 20_000


def _row_minima(g: np.ndarray, w: int) -> np.ndarray:
    out = g[: len(g) - w + 1].copy()
    for j in range(1, w):
        np.minimum(out, g[j : j + len(out)], out=out)
    return out


def _prints(h: np.ndarray, n: int, window: int, gram: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` words, told apart by length."""
    found = _row_minima(grams(h, gram), n - gram + 1) if n == window > gram else grams(h, n)
    return mix(found + np.uint64(n))


def _words(data, starts, ends, p: int, n: int) -> bytes:
    return b" ".join(data[s:e].tobytes().lower() for s, e in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist(), strict=True))


def _item_runs(window: int, gram: int):
    """Of (item, text): every run with its length, fingerprint and hash."""

    def run(batches):
        lexer = alnum_lexer()
        for batch in batches:
            items = batch.column(0).to_pylist()
            for lo, _, data, offs in text_parts(batch.column(1)):
                starts, ends, h, woff = lexer.words(data, offs)
                for i in range(len(woff) - 1):
                    a, b = int(woff[i]), int(woff[i + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    fp, own = _prints(h[a:b], n, window, gram), grams(h[a:b], n)
                    for x in range(0, len(fp), _CHUNK):
                        y = min(x + _CHUNK, len(fp))
                        words = [_words(data, starts, ends, a + j, n) for j in range(x, y)]
                        cols = [pa.array([items[lo + i]] * (y - x), pa.string()), pa.array(np.full(y - x, n)), pa.array(fp[x:y].view(np.int64)), pa.array(own[x:y].view(np.int64)), pa.array(words, pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["item", "n", "fp", "h", "words"])

    return run


def _shared_runs(filters, lengths: list[int], window: int, gram: int):
    """Of (id, th, text): the runs whose fingerprint and hash the benchmark may hold."""

    def places(h, n, fp_bits, run_bits, woff) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp = _prints(h, n, window, gram)
        change = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
        maybe = np.flatnonzero(bloom.among(fp_bits, fp[change].view(np.int64)))
        if not len(maybe):
            return
        first, until = change[maybe], np.r_[change[1:], len(fp)][maybe]
        size = until - first
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        at = at[inside(woff, n, len(h))[at]]
        own = h[at].copy()
        for j in range(1, n):
            own *= _MULTIPLIER
            own += h[at + j]
        at = at[bloom.among(run_bits, mix(own).view(np.int64))]
        for x in range(0, len(at), _CHUNK):
            yield at[x : x + _CHUNK], fp[at[x : x + _CHUNK]]

    def run(batches):
        lexer, (fp_bits, run_bits) = alnum_lexer(), filters.value
        for batch in batches:
            ids, th = batch.column(0), batch.column(1)
            for lo, _, data, offs in text_parts(batch.column(2)):
                starts, ends, h, woff = lexer.words(data, offs)
                for n in lengths:
                    if len(h) < n:
                        continue
                    for at, fp in places(h, n, fp_bits, run_bits, woff):
                        doc = np.searchsorted(woff, at, "right") - 1
                        own = pa.array(lo + doc)
                        words = [_words(data, starts, ends, p, n) for p in at.tolist()]
                        cols = [ids.take(own), th.take(own), pa.array((at - woff[doc]).astype(np.int64)), pa.array(np.full(len(at), n)), pa.array(fp.view(np.int64)), pa.array(words, pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["id", "th", "p", "n", "fp", "words"])

    return run


@F.arrow_udf(LongType())
def _counted(texts: pa.Array) -> pa.Array:
    """The number of words of each text."""
    lexer, found = alnum_lexer(), [np.zeros(0, np.int64)]
    for _, _, data, offs in text_parts(texts):
        found.append(np.diff(lexer.words(data, offs)[3]))
    return pa.array(np.concatenate(found))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the columns named in ``payload`` as ``p_0`` on."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    runs = settle(items.mapInArrow(_item_runs(window, gram), "item string, n long, fp long, h long, words binary").distinct(), "runs")
    # At most one length per window size.
    lengths = sorted(r[0] for r in runs.select("n").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast((bloom.build(runs.select("fp")), bloom.build(runs.select("h"))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), _counted(text).alias("n_words"), *(F.col(c).alias(f"p_{i}") for i, c in enumerate(payload)))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    may = settle(keyed.mapInArrow(_shared_runs(sent, lengths, window, gram), "id long, th long, p long, n long, fp long, words binary"), "candidates")

    key = ["id", "th"]
    hits = settle(may.join(settle(runs.select("fp", "words").distinct(), "words"), ["fp", "words"], "left_semi"), "hits")
    # Spans in order: a span adds what lies beyond those before it.
    spans = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("p", (F.col("p") + F.col("n")).alias("e")))).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    add = lambda x, s: F.struct((x.n + F.greatest(F.lit(0).cast("long"), s.e - F.greatest(s.p, x.upto))).alias("n"), F.greatest(x.upto, s.e).alias("upto"))
    covered = spans.select(*key, F.aggregate("s", zero, add, lambda x: x.n).alias("n_hit"))
    found = hits.select(*key, "fp", "words").distinct().join(runs.where("item is not null").select("fp", "words", "item"), ["fp", "words"]).select(*key, "item").distinct()
    of = found.groupBy(*key).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    each = settle(covered.join(of, covered["id"].eqNullSafe(of["id"]) & (covered["th"] == of["th"]), "left").select(covered["id"], covered["th"], "n_hit", "n_items", "items_sha256"), "contaminated")
    out = rows.join(each, rows["doc_id"].eqNullSafe(each["id"]) & (rows["th"] == each["th"]), "left")
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    result = {"n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero), "items_sha256": F.coalesce("items_sha256", none), "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False))}
    return out.select("doc_id", "n_words", *(v.alias(k) for k, v in result.items()), *(f"p_{i}" for i in range(len(payload))))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
