"""Near-dedup by DartMinHash.

A document is the bag of its runs of five words (lower-cased letters and digits);
the weight of a run is how often it occurs. Each unit of weight is a strip of its own
in the plane of weight and rank. Strips are cut into cells; a hash of the strip and
the cell says how many darts fall into it (a Poisson count), where they fall in rank,
and which of ``bands * rows`` coordinates each belongs to. The earliest dart of each
coordinate is the signature: two documents agree in a coordinate with a probability
of their weighted Jaccard similarity. A document of weight W only looks at ranks up
to about k ln k / W, so the work grows with W + k ln k and not with W * k.

Documents equal as bags collapse to one node first. Nodes that agree in a band meet
through that band's leader: the node whose buckets hold the most nodes, so the one in
the middle of its copies. A bucket of n nodes gives n - 1 pairs, and most buckets of a
node name the same leader. Pairs are checked exactly; components of links are classes.

Buckets that still hold several classes may hide links between nodes that no leader
resembles. Their nodes are joined by rare elements: in one order of all elements, by how
many of these nodes hold them, two bags can only be similar if they meet in one of
their first elements, and at places that leave enough elements for the overlap. Only
rows of different classes whose sizes and places allow a similarity above the threshold
make a pair; rows of the largest class of an element do not meet each other. This
filter loses no link, whatever the order is. The pairs are checked exactly, and their
links merge classes. So each two nodes of a common band are checked, known to be in one
class, or known to be unlike.

Texts of fewer than five words are one run; texts without words are never similar to
anything and form a class each. Rows of one ``doc_id`` count as documents of their
own. ``kept`` is the class's row with the smallest ``doc_id`` (nulls last).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bloom import may_match
from tessera.llm.common import settle
from tessera.llm.components import components
from tessera.llm.lexer import alnum_lexer, grams, inside, mix, text_parts

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
#: The first cells end at these ranks; later ones have the longest length.
FIRST_CELL = 2.0**-12
LAST_CELL = 8.0

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_C_INTS = (0xD1B54A32D192ED03, 0xAEF17502108EF2D9)


def _cell(s: int) -> tuple[float, float]:
    """Start and length of cell ``s`` in rank."""
    dyadic = int(math.log2(LAST_CELL / FIRST_CELL)) + 1
    if s == 0:
        return 0.0, FIRST_CELL
    if s <= dyadic:
        return FIRST_CELL * 2 ** (s - 1), FIRST_CELL * 2 ** (s - 1)
    return 2 * LAST_CELL + LAST_CELL * (s - dyadic - 1), LAST_CELL


def _counts(length: float) -> np.ndarray:
    """Cumulative Poisson probabilities."""
    p, out, n = math.exp(-length), [], 0
    total = p
    while total < 1 - 1e-15 and n < 200:
        out.append(total)
        n += 1
        p *= length / n
        total += p
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, doc: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ranks of the earliest dart per document and coordinate; ``doc`` is sorted, ``weights`` counts it."""
    n = len(weights)
    sig = np.full(n * k, np.inf)
    reach = (k * math.log(k) + 2 * k) / np.maximum(weights, 1)
    todo, s = np.flatnonzero(weights > 0), 0
    active = np.zeros(n, bool)
    active[todo] = True
    el, d = elements, doc
    while active.any():
        start, length = _cell(s)
        cdf = _counts(length)
        seed, cell = (np.uint64((s + 1) * c % (1 << 64)) for c in _C_INTS)
        u = _unit(mix(el + seed))
        some = np.flatnonzero(u >= cdf[0])
        darts = np.searchsorted(cdf, u[some], "right")
        owner = np.repeat(some, darts)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(darts) - darts, darts)
        at = mix((el[owner] ^ cell) + (j.astype(np.uint64) + np.uint64(1)) * _C[2])
        np.minimum.at(sig, d[owner] * k + (mix(at ^ _C[3]) % np.uint64(k)).astype(np.int64), start + length * _unit(at))
        s += 1
        done = active & (start + length >= reach)
        check = np.flatnonzero(done)
        if len(check):
            full = np.isfinite(sig.reshape(n, k)[check]).all(axis=1)
            active[check[full]] = False
            stay = active[d]
            el, d = el[stay], d[stay]
    return sig.reshape(n, k)


def elements_of(h: np.ndarray, woff: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the units of weight of each text, their texts, and the weights."""
    n_words = np.diff(woff)
    g = grams(h, shingle)
    ok = inside(woff, shingle, len(h))
    doc = np.repeat(np.arange(len(n_words)), n_words)
    el, of = g[ok], doc[: len(g)][ok]
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    if len(short):
        extra = np.array([grams(h[woff[i] : woff[i + 1]], int(n_words[i]))[0] + np.uint64(n_words[i]) for i in short], np.uint64)
        el, of = np.r_[el, extra], np.r_[of, short]
        order = np.argsort(of, kind="stable")
        el, of = el[order], of[order]
    key = mix(el + of.astype(np.uint64) * _C[0])
    sorted_ = np.sort(key)
    twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    if len(twice):
        again = np.flatnonzero(np.isin(key, twice))
        order = again[np.argsort(key[again], kind="stable")]
        ks = key[order]
        first = np.r_[True, ks[1:] != ks[:-1]]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        el = el.copy()
        el[order] += nth.astype(np.uint64) * _C[2]
    return mix(el), of, np.bincount(of, minlength=len(n_words))


def _sum_by(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    at = np.searchsorted(of, np.arange(n + 1))
    return sums[at[1:]] - sums[at[:-1]]


def _signed(shingle: int, bands: int, rows: int):
    def run(batches):
        lexer = alnum_lexer()
        for batch in batches:
            for lo, hi, data, offs in text_parts(batch.column(3)):
                _, _, h, woff = lexer.words(data, offs)
                n = hi - lo
                el, of, weight = elements_of(h, woff, shingle)
                sig = dart_signatures(el, of, weight, bands * rows).view(np.uint64).reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
                for r in range(rows):
                    key = mix(key * _C[1] + sig[:, :, r])
                cols = [batch.column(i).slice(lo, n) for i in range(3)]
                cols += [pa.array(weight), pa.array(_sum_by(el, of, n).view(np.int64)), pa.array(_sum_by(mix(el ^ _C[3]), of, n).view(np.int64))]
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel())))
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "th", "w", "d1", "d2", "bands"])

    return run


def _shingled(shingle: int):
    def run(batches):
        lexer, seen = alnum_lexer(), set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            new = []
            for i, node in enumerate(nodes):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            for lo, hi, data, offs in text_parts(batch.column(1)):
                _, _, h, woff = lexer.words(data, offs)
                el, _, weight = elements_of(h, woff, shingle)
                at = np.r_[0, np.cumsum(weight)]
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(el.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], ["node", "s"])

    return run


def _sets(docs: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the elements of each node of ``named`` (node, id, th); one row per node."""
    # The hint keeps the filter's Python workers and those of the next step in stages of their own.
    docs, named = docs.where(may_match(named.select("th"), F.col("th"))), named.hint("merge")
    texts = docs.join(named, docs["id"].eqNullSafe(named["id"]) & (docs["th"] == named["th"])).select("node", "text")
    sets = settle(texts.mapInArrow(_shingled(shingle), "node long, s array<long>"), "sets")
    # A row that repeats another in id and text gives its node again in another task.
    again = sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    return sets if again.isEmpty() else settle(sets.dropDuplicates(["node"]), "sets")


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags are similar, checked exactly on 64-bit names of the units of weight."""
    both = pairs.join(sets.selectExpr("node as a", "s as sa"), "a").join(sets.selectExpr("node as b", "s as sb"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.where(F.col("i") >= threshold * (F.col("n") - F.col("i"))).select("a", "b")


def _central(shared: DataFrame) -> DataFrame:
    """(bh, l, wl): the leader of each bucket is the node whose buckets hold the most nodes."""
    score = settle(shared.groupBy("row").agg(F.sum("n").alias("score")), "scores")
    place = F.struct("score", F.xxhash64("row"), "row", "w")
    best = shared.join(score, "row").groupBy("bh").agg(F.max(place).alias("x"))
    return settle(best.select("bh", F.col("x.row").alias("l"), F.col("x.w").alias("wl")), "leaders")


def _open(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, c): the nodes of buckets that hold several classes, and their classes."""
    named = shared.select("row", "bh").join(comp.selectExpr("node as row", "comp as c"), "row", "left").withColumn("c", F.coalesce("c", "row"))
    named = settle(named, "named")
    mixed = settle(named.groupBy("bh").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("bh"), "mixed")
    return settle(named.join(mixed, "bh", "left_semi").selectExpr("row as node", "c").distinct(), "open")


def _candidates(sets: DataFrame, among: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every pair of nodes of ``among`` (node, c) in different classes that may be similar.

    ``upto`` is the most elements the other bag may have if this element is the first that
    both hold: the overlap can't exceed what is left here, w - place.
    """
    units = sets.join(among.select("node"), "node", "left_semi").select("node", F.explode("s").alias("e"))
    # Elements of one node have the first places of its order; their number is all that counts.
    often = settle(units.groupBy("e").agg(F.count("*").cast("int").alias("n")).where("n > 1"), "often")
    order = units.join(often, "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es"))
    size = sets.select("node", F.size("s").alias("w"))
    first = order.join(size, "node").withColumn("left", F.col("w") - F.ceil(threshold * F.col("w") - 1e-9) + 1 - (F.col("w") - F.size("es")))
    first = first.where("left > 0").select("node", "w", F.size("es").alias("m"), F.posexplode(F.slice("es", 1, F.col("left").cast("int"))).alias("k", "x"))
    upto = F.least((F.col("m") - F.col("k")) * ((1 + threshold) / threshold) - F.col("w"), F.col("w") / threshold) + 1e-9
    first = settle(first.select("node", "w", F.col("x.e").alias("e"), upto.alias("upto")).join(among, "node"), "first")

    each = first.groupBy("e", "c").agg(F.count("*").alias("n"))
    largest = each.groupBy("e").agg(F.max(F.struct("n", "c")).alias("x"), F.count("*").alias("classes")).where("classes > 1")
    largest = settle(largest.select("e", F.col("x.c").alias("most")), "largest")
    first = settle(first.join(largest, "e").select("e", "node", "w", "upto", "c", (F.col("c") != F.col("most")).alias("minor")), "mixed")
    small = first.where("upto >= w").selectExpr("e", "node as a", "w as wa", "upto as ua", "c as ca", "minor as ma")
    large = first.selectExpr("e", "node as b", "w as wb", "upto as ub", "c as cb", "minor as mb")
    fits = F.expr("ca <> cb and (wa < wb or wa = wb and a < b) and wb <= ua and wa <= ub")
    met = small.where("ma").join(large, "e").where(fits).select("a", "b")
    met = met.unionByName(small.where("not ma").join(large.where("mb"), "e").where(fits).select("a", "b"))
    return settle(met.distinct(), "candidates")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``; ``class_id`` is the smallest ``doc_id`` of the class."""
    out = near_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), threshold, shingle, bands, rows)
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def near_rows(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs``: (id, text). One row each: ``id, th, class_id, class_size, kept``; ``th`` is the text's ``xxhash64``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("id", F.xxhash64(text).alias("th"), text.alias("text"))
    signed = docs.select(F.monotonically_increasing_id().alias("row"), "id", "th", "text").mapInArrow(_signed(shingle, bands, rows), "row long, id long, th long, w long, d1 long, d2 long, bands array<long>")
    # Texts without words are told apart by their row.
    signed = settle(signed.withColumn("d2", F.expr("if(w = 0, row, d2)")), "signatures")
    dig = ["d1", "d2", "w"]
    # Counts are written before they meet their rows: a join of two plain shuffles is one that AQE can split.
    nodes = settle(signed.groupBy(*dig).agg(F.min("row").alias("node")), "nodes")
    reps = signed.where("w > 0").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi")

    each = reps.select("row", "w", F.explode("bands").alias("bh"))
    crowds = settle(each.groupBy("bh").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    shared = settle(each.join(crowds, "bh"), "shared")
    leader = _central(shared)
    alike = F.least("w", "wl") >= threshold * F.greatest("w", "wl")
    pairs = settle(shared.join(leader, "bh").where((F.col("row") != F.col("l")) & alike).selectExpr("row as a", "l as b").distinct(), "pairs")

    met = shared.select("row").distinct().join(signed.select("row", "id", "th"), "row").withColumnRenamed("row", "node")
    sets = _sets(docs, settle(met, "met"), shingle)
    comp = settle(components(settle(_links(pairs, sets, threshold), "links")), "classes")
    more = settle(_links(_candidates(sets, _open(shared, comp), threshold), sets, threshold), "links")
    if not more.isEmpty():
        comp = settle(components(comp.selectExpr("node as a", "comp as b").unionByName(more)), "classes")

    of_row = signed.select("row", "id", "th", *dig).join(nodes, dig).select("row", "id", "th", "node")
    of_row = of_row.join(comp, "node", "left").select("row", "id", "th", F.coalesce("comp", "node").alias("comp"))
    of_row = settle(of_row, "classes")
    best = of_row.groupBy("comp").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    best = settle(best, "best")
    return of_row.join(best, "comp").select("id", "th", "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"))
