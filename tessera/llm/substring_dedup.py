"""Substring dedup by level-wise doubling.

A window is ``window`` consecutive words. Windows are compared level by level: first
runs of ``base`` words, then, of those whose run is repeated alone, runs twice as long
around it, and so on until the whole window is compared or no candidate is left.

Only one run per window is looked at on each level. On the first it is the window's
anchor, the leftmost of its ``base``-word runs with the smallest hash. Equal windows
have their anchors at the same place, so nothing is lost, and neighbouring windows
share anchors: there is one row for about every ``window / 2`` words. Runs of longer
levels lie at a place that depends on the anchor's place alone, and contain the run
of the level before.

All windows of an anchor together form its context. Contexts that are repeated as a
whole (copies of long passages) settle all their windows at once. Of the others, each
different context is extended once, with the number of its copies as weight, so a
passage that a third of all documents share is extended once and not per document.

Counting combines on the map side, and counts are written before they meet their rows, so
that the join has two plain shuffles, which AQE can split. Texts are dealt out twice, by
document: those with contexts that need longer levels to hash these, and all to remove the
covered words. Runs are equal if two hashes of 64 bits are, that of the anchor's words and
that of the longer run or context around it. A document's spans are one row, at most one
span for each of its anchors, so far smaller than its text.

A null text has no words; windows are judged on the input; rows of equal ``doc_id`` and
text repeat each other. Texts shorter than a window lose nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bloom import may_match
from tessera.llm.common import settle
from tessera.llm.lexer import grams, mix, space_lexer, text_parts

WINDOW = 35
BASE = 8
KEY = ["id", "th"]

_P = np.uint64(0xA0761D6478BD642F)
_Q = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))


class _Runs:
    """Hashes of word runs of any length, from prefix sums over the word hashes."""

    def __init__(self, h: np.ndarray):
        up, self.down = np.full(len(h) + 1, _P), np.full(len(h) + 1, _Q)
        up[:1], self.down[:1] = 1, 1
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * np.multiply.accumulate(up)[:-1], out=self.sums[1:])
        self.down = np.multiply.accumulate(self.down)

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(np.uint64))


def _first_minima(g: np.ndarray, w: int) -> np.ndarray:
    """The leftmost place of the smallest of the ``w`` values from each place on."""
    at, s = np.arange(len(g)), 1
    while s < w:
        step = min(s, w - s)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        s += step
    return at


def _anchors(window: int, base: int):
    def run(batches):
        lexer = space_lexer()
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in text_parts(batch.column(2)):
                _, _, h, woff = lexer.words(data, offs)
                if len(h) < window:
                    continue
                at = _first_minima(grams(h, base), window - base + 1)
                doc = np.repeat(np.arange(hi - lo), np.diff(woff))[: len(at)]
                start = np.arange(len(at))
                ok = start + window <= woff[doc + 1]
                start, at, doc = start[ok], at[ok], doc[ok]
                if not len(start):
                    continue
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
                first, last = start[new], start[np.r_[new[1:], len(start)] - 1]
                doc, at = doc[new], at[new]
                runs, more, off = _Runs(h), last - first, at - first
                whole = runs(first, more + window) ^ mix(off.astype(np.uint64) + np.uint64(1))
                cols = [ids[lo + doc], th[lo + doc], (first - woff[doc]).astype(np.int32), more.astype(np.int32), off.astype(np.int32), runs(at, base).view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "th", "lo", "more", "off", "h", "ctx"])

    return run


def levels(window: int, base: int) -> list[int]:
    out, n = [], base
    while n < window:
        n = min(2 * n, window)
        out.append(n)
    return out


def _extended(window: int, base: int, lengths: list[int]):
    """Of documents with contexts, a row per window with its runs of each length."""

    def run(batches):
        lexer = space_lexer()
        for batch in batches:
            ids, th, ctx = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            flat, at = ctx.flatten(), np.cumsum(np.r_[0, ctx.value_lengths().to_numpy()])
            c_lo, c_more, c_off, c_m, c_h = (flat.field(k).to_numpy().astype(np.int64) for k in range(5))
            for lo, hi, data, offs in text_parts(batch.column(2)):
                _, _, h, woff = lexer.words(data, offs)
                runs = _Runs(h)
                mine = slice(at[lo], at[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                n = c_more[mine] + 1
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc, m, h8, off = np.repeat(doc, n), np.repeat(c_m[mine], n), np.repeat(c_h[mine], n), np.repeat(c_off[mine], n) - i
                pos = np.repeat(c_lo[mine], n) + i
                start, tag = woff[doc] + pos, mix(off.astype(np.uint64) + np.uint64(1))
                cols = [ids[lo + doc], th[lo + doc], pos.astype(np.int32), m, h8]
                cols += [(runs(start + off * (window - x) // (window - base), x) ^ tag).view(np.int64) for x in lengths]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "th", "lo", "m", "h", *(f"h{x}" for x in lengths)])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """``docs``: (id, th, text). Spans (id, th, lo, n) that cover all words of repeated windows."""
    anchors = docs.mapInArrow(_anchors(window, base), "id long, th long, lo int, more int, off int, h long, ctx long")
    again = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("n > 1").selectExpr("h", "c0 <> c1 as mixed")
    again = settle(again, "repeated")
    found = settle(anchors.join(again, "h"), "anchors")
    spans = [found.where("not mixed").selectExpr(*KEY, "lo", f"more + {window} as n")]

    mixed = found.where("mixed")
    ctx = settle(mixed.groupBy("h", "ctx").agg(F.count("*").alias("m"), F.min(F.struct(*KEY, "lo", "more", "off")).alias("x")), "contexts")
    spans.append(mixed.join(ctx.where("m > 1").select("h", "ctx"), ["h", "ctx"]).selectExpr(*KEY, "lo", f"more + {window} as n"))

    lengths = levels(window, base)
    each = settle(ctx.select("x.*", "m", "h").groupBy(*KEY).agg(F.collect_list(F.struct("lo", "more", "off", "m", "h")).alias("ctx")), "extended")
    # The hint keeps the filter's Python workers and those of the next step in stages of their own.
    rows = docs.where(may_match(each.select("th"), F.col("th"))).join(each.hint("merge"), KEY).select("id", "th", "text", "ctx")
    kind = "id long, th long, lo int, m long, h long, " + ", ".join(f"h{x} long" for x in lengths)
    cand = settle(rows.mapInArrow(_extended(window, base, lengths), kind), "windows")
    for x in lengths:
        if cand.isEmpty():
            break
        twice = settle(cand.groupBy("h", f"h{x}").agg(F.sum("m").alias("k")).where("k > 1").select("h", f"h{x}"), f"twice{x}")
        cand = settle(cand.join(twice, ["h", f"h{x}"], "left_semi").select("id", "th", "lo", "m", "h", *(f"h{y}" for y in lengths if y > x)), f"level{x}")
    spans.append(cand.where("m = 1").selectExpr(*KEY, "lo", f"{window} as n"))
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def _removed(batches):
    lexer = space_lexer()
    for batch in batches:
        n_words, n_removed, sha, kept_texts = [], [], [], []
        spans = batch.column(2)
        flat, at = spans.flatten(), np.cumsum(np.r_[0, spans.value_lengths().fill_null(0).to_numpy()])
        s_lo, s_n = (flat.field(k).to_numpy() for k in range(2))
        for lo, hi, data, offs in text_parts(batch.column(1)):
            starts, ends, h, woff = lexer.words(data, offs)
            doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            a = woff[doc] + s_lo[at[lo] : at[hi]]
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, a, 1)
            np.add.at(cover, a + s_n[at[lo] : at[hi]], -1)
            keep = np.cumsum(cover)[: len(h)] == 0
            count = np.r_[0, np.cumsum(keep)][woff]
            base, end = offs[0], offs[-1]
            part = data[base:end].copy()
            places = np.flatnonzero(keep)
            s, e = starts[places] - base, ends[places] - base
            last = np.zeros(len(places), bool)
            last[count[1:][np.diff(count) > 0] - 1] = True
            part[e[~last]] = 32
            mark = np.zeros(len(part) + 2, np.int8)
            mark[s] = 1
            stop = e + ~last
            # A word may start where the separator of the one before has just ended.
            np.subtract.at(mark, stop, 1)
            use = np.cumsum(mark)[: len(part)] > 0
            out, cut = part[use].tobytes(), np.r_[0, np.cumsum(use)][offs - base]
            sha += [hashlib.sha256(out[x:y]).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            kept_texts += [out[x:y].decode() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            n_words += np.diff(woff).tolist()
            n_removed += (np.diff(woff) - np.diff(count)).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept_text``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text, F.col(id_col).isNull()).alias("th"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    spans = repeated_spans(docs.select(*KEY, "text"), window, base)
    each = settle(spans.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "n")).alias("spans")), "spans")
    rows = docs.join(each, KEY, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM k) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM rep) GROUP BY doc_id),
x AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda t, i : NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM x
"""
