"""Language identification by nearest centroids.

A text is a vector of hashed byte 2- and 3-grams of its letters (A-Z as a-z, runs of
other characters as one space), TF-IDF weighted and of unit length. Per language a few
centroids are fitted by spherical k-means on a bounded sample of the labelled texts;
a text gets the language of the centroid with the largest cosine, whole text, no
prefix. A text of ``min_grams`` grams or more is rejected if its best cosine lies below
``reject_share`` of what the lowest ``reject_quantile`` of the language's sample reaches
at its length: cosines are compared as shares of the usual cosine of texts with as many
grams. Few labelled texts say little of a low quantile, so it leans on that of all
languages with the weight of ``PRIOR`` texts.

Every labelled language is learned. The texts per language are bounded: about ``SAMPLE``
texts in all but ``LEAST`` per language where there are more languages than that allows,
picked by a hash of the text, equal texts of a language once; never more than twice as
many. The sample is counted on the executors, only packed
vectors of at most ``DIMS`` entries come to the driver, and it holds the dense matrix of
one language at a time. The model is ``CENTROIDS * DIMS`` floats per language.

Null texts and texts without a letter are ``und`` with score 0 and rejected. With
nothing to learn from every text is ``und``. Only the text decides a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lexer import text_parts

DIMS = 1 << 14
SAMPLE = 4096
LEAST = 32
CENTROIDS = 4
PRIOR = 100
#: Centroids and texts scored at once.
BLOCK = 512
TEXTS = 32
#: Documents whose crc32 leaves this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_cells(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all grams of the texts, and their offsets per text."""
    part, at = data[offs[0] : offs[-1]], offs - offs[0]
    n = len(at) - 1
    # A space before each text and one at the end keep grams inside a text.
    x = np.full(len(part) + n + 1, 32, np.uint8)
    own = np.repeat(np.arange(1, n + 1), np.diff(at))
    x[np.arange(len(part)) + own] = _FOLD[part]
    keep = np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]
    starts = np.cumsum(np.r_[0, keep])[at[:-1] + np.arange(n)]
    x = x[keep].astype(np.uint32)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    cells = np.empty((len(three), 2), np.uint32)
    cells[:, 0] = two[:-1] * np.uint32(0x9E3779B1) >> np.uint32(18)
    cells[:, 1] = (three ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) >> np.uint32(18)
    # Grams that reach over a space belong to no word; their cell is given to the gram of the space alone.
    over = (x[1:-1] == 32) & (x[:-2] != 32)
    cells[over, 1] = cells[over, 0]
    ends = np.r_[starts[1:], len(three)]
    return cells.ravel(), np.r_[np.minimum(starts, ends), len(three)] * 2


def _weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def _sampled(batches):
    for batch in batches:
        langs, idx, val = [], [], []
        for lo, hi, data, offs in text_parts(batch.column(1)):
            cells, at = gram_cells(data, offs)
            for i in range(hi - lo):
                tf = np.bincount(cells[at[i] : at[i + 1]], minlength=DIMS)
                where = np.flatnonzero(tf)
                idx.append(where.astype(np.int32).tobytes())
                val.append(tf[where].astype(np.float32).tobytes())
        langs = batch.column(0)
        yield pa.RecordBatch.from_arrays([langs, pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["lang", "idx", "val"])


def _centroids(v: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        c = np.stack([v[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _usual(grams: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of numbers of grams and the usual cosine there: medians of groups of 16 texts or more of like length, never falling."""
    if not len(grams):
        return np.zeros(1), np.ones(1)
    order = np.argsort(grams, kind="stable")
    parts = np.array_split(order, min(max(len(order) // 16, 1), 24))
    at = np.array([np.median(np.log(grams[p])) for p in parts])
    return at, np.maximum.accumulate([max(float(np.median(cos[p])), 1e-6) for p in parts])


def _expected(grams: np.ndarray, usual: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The usual cosine of texts with so many grams; it falls with the root of the length below the shortest known ones."""
    at, cos = usual
    x = np.log(np.maximum(grams, 1))
    return np.interp(x, at, cos) * np.exp(np.minimum(x - at[0], 0) / 2)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS, reject_share: float = 0.67, reject_quantile: float = 0.005, min_grams: int = 40, seed: int = 5) -> dict:
    """The model as plain arrays: ``langs``, ``idf``, ``centroids``, ``owner``, and ``floor`` as shares of ``usual``."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(fold, F.lit(0)) != HELD_OUT)).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    # Of different texts; one row per language.
    counts = known.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t"))).collect()
    empty = {"langs": [], "idf": np.ones(DIMS, np.float32), "centroids": np.zeros((0, DIMS), np.float32), "owner": np.zeros(0, int), "floor": np.zeros(0, np.float32), "usual": _usual(np.zeros(0), np.zeros(0))}
    if not counts:
        return empty
    each = max(sample // len(counts), LEAST)
    share = docs.sparkSession.createDataFrame([(l, min(1.0, each / n)) for l, n in counts], "sl string, share double")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("t")), F.lit(1_000_003)) / 1_000_003
    picked = known.join(F.broadcast(share), F.col("l") == F.col("sl")).where(u < F.col("share")).select("l", "t")
    picked = picked.dropDuplicates(["l", "t"]).limit(2 * each * len(counts))
    rows = picked.mapInArrow(_sampled, "lang string, idx binary, val binary").collect()
    rows = sorted((r for r in rows if r["idx"]), key=lambda r: (r["lang"], r["idx"], r["val"]))
    if not rows:
        return empty
    cells = [np.frombuffer(r["idx"], np.int32) for r in rows]
    counts = [np.frombuffer(r["val"], np.float32) for r in rows]
    df = np.bincount(np.concatenate(cells), minlength=DIMS)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    of, grams = np.array([r["lang"] for r in rows]), np.array([n.sum() for n in counts])
    langs = sorted({r["lang"] for r in rows})
    long, cos, made = grams >= min_grams, np.zeros(len(rows)), []
    members = {l: [] for l in langs}
    for i, r in enumerate(rows):
        members[r["lang"]].append(i)
    for l in langs:
        v = np.zeros((len(members[l]), DIMS), np.float32)
        for j, i in enumerate(members[l]):
            x = np.log1p(counts[i]) * idf[cells[i]]
            v[j, cells[i]] = x / np.linalg.norm(x)
        made.append(_centroids(v, centroids, seed).astype(np.float32))
        cos[members[l]] = (v @ made[-1].T).max(1)
    usual = _usual(grams[long], cos[long])
    share = cos / _expected(grams, usual)
    all_low = float(np.quantile(share[long], reject_quantile)) if long.any() else 0.0
    floor = []
    for l in langs:
        own = share[long & (of == l)]
        low = float(np.quantile(own, reject_quantile)) if len(own) else all_low
        floor.append(reject_share * (len(own) * low + PRIOR * all_low) / (len(own) + PRIOR))
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(made), "owner": np.repeat(np.arange(len(langs)), [len(c) for c in made]), "floor": np.array(floor, np.float32), "usual": usual, "min_grams": min_grams}


def _predicted(model, text_at: int, rest: int):
    """Columns: id, letter, then others, the text at ``text_at``; those from ``rest`` on are handed on."""

    def run(batches):
        m = model.value
        langs, n_langs = m["langs"], len(m["langs"])
        centroids = m["centroids"]
        for batch in batches:
            pred, score, rejected = [], [], []
            letters = batch.column(1).to_pylist()
            for lo, hi, data, offs in text_parts(batch.column(text_at)):
                cells, at = gram_cells(data, offs)
                for a in range(0, hi - lo, TEXTS):
                    b = min(a + TEXTS, hi - lo)
                    row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1])) * DIMS
                    tf = np.bincount(row + cells[at[a] : at[b]], minlength=(b - a) * DIMS).reshape(b - a, DIMS).astype(np.float32)
                    if n_langs:
                        vec, best, top = _weigh(tf, m["idf"]).astype(np.float32), np.zeros(b - a, int), np.full(b - a, -1, np.float32)
                        for k in range(0, len(centroids), BLOCK):
                            cos = np.clip(vec @ centroids[k : k + BLOCK].T, 0, 1)
                            here = cos.argmax(1)
                            value = cos[np.arange(b - a), here]
                            best, top = np.where(value > top, here + k, best), np.maximum(top, value)
                        owner, grams = m["owner"][best], tf.sum(1)
                        far = (grams >= m["min_grams"]) & (top < m["floor"][owner] * _expected(grams, m["usual"]))
                    for j in range(b - a):
                        if not letters[lo + a + j] or not n_langs:
                            pred.append("und"), score.append(0.0), rejected.append(True)
                        else:
                            pred.append(langs[owner[j]]), score.append(float(top[j])), rejected.append(bool(far[j]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), *(batch.column(i) for i in range(rest, batch.num_columns))], ["doc_id", "lang_pred", "score", "rejected", *batch.schema.names[rest:]])

    return run


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, rejected`` and the columns named in ``payload`` as ``p_0`` on."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    more = [F.col(c).alias(f"p_{i}") for i, c in enumerate(payload)]
    # A text that is handed on anyway is sent once.
    own = [] if text_col in payload else [F.col(text_col).alias("text")]
    rows = docs.select(F.col(id_col).alias("doc_id"), letter.alias("letter"), *own, *more)
    text_at = 2 if own else 2 + payload.index(text_col)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind = ", ".join([f"doc_id {kinds['doc_id']}, lang_pred string, score double, rejected boolean", *(f"p_{i} {kinds[f'p_{i}']}" for i in range(len(payload)))])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    out = rows.mapInArrow(_predicted(sent, text_at, 2 + len(own)), kind)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", *(f"p_{i}" for i in range(len(payload))))
