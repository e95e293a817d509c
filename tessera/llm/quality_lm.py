"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on all trusted text but a held-out part; nothing is pruned, and
every trusted word is a word of its own: the ``FREQUENT`` most frequent ones have small
numbers, which only make tables compact, the others their 63-bit hash. Bigrams have their
counts, words the number of different words before them; both levels have the discounts
D1, D2 and D3+ of their own counts of counts. The mass left below is spread over the
seen words and the number of unseen ones that Chao's estimator gives, so each unknown word
costs as much as one unseen word.

The log probability of a text is a sum over its n-grams: the log of an unseen word for
each word and the text's end, ``u(w)`` for each known word (what its own probability adds,
and the log of the mass it leaves as a context), and ``v(bc)`` for each known bigram (what
it adds to that). So scoring is one count join of n-grams and a sum per document.

N-grams travel packed: the tokens of a batch of texts are sorted by shard, a hash range of
n-grams of about ``SHARD`` trusted tokens, and each batch sends a shard one row of sorted,
compressed columns. A shard meets its counts, the values of its rare words, and all requests in
one sorted stream, whose only state is the shard's counts: a hot n-gram makes the stream
longer, never the state larger. It answers a batch with one packed row of sums, and the answers to
a batch meet its texts in a second stream. Within a shard n-grams are named by 44 bits, so of 2^24
unknown ones about one is taken for a known one. The ``HOT`` bigrams most frequent in training
and the frequent words are broadcast (of fixed size) and summed in place; requests for
what a Bloom filter of fixed size excludes are not sent.

Thresholds are quantiles of the perplexity of held-out trusted texts per language, at
every size: a language's own mean log perplexity, and above it a quantile of what its
held-out texts differ from the mean. Few texts say little of a high quantile, so that
leans on the one of all languages (each text against its own language's mean) with the
weight of ``PRIOR`` texts. Only a language without held-out trusted text has nothing
of its own and uses the quantile of all. Texts without
words have no perplexity and are not kept; a null language is a language of its own.
Without trusted text nothing is judged and all texts with words are kept. Rows of one
``doc_id`` are documents of their own, all trusted if the id is; a null id is never trusted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.common import ALNUM_WORD, discard, settle
from tessera.llm.lexer import alnum_lexer, mix, text_parts

#: So many words have small numbers; fixed, whatever the vocabulary's size.
FREQUENT = 1 << 18
HOT = 1 << 20
#: The filter of n-grams has 2^FILTER_BITS bits (16 MB); fixed, whatever the model's size.
FILTER_BITS = 27
#: Trusted tokens per shard.
SHARD = 1 << 20
#: Tokens that a task sorts at once.
FLUSH = 1 << 20
QUANTILE = 0.995
PRIOR = 20
#: Up to so many trusted ids are broadcast; more meet their texts in one shuffle.
FEW_LABELS = 1 << 20
#: One of so many trusted texts is held out for thresholds.
HOLD_OUT = 10

START, END, NONE = 0, 1, 2
#: Training counts above this are told apart no further.
_MOST = 10_000
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# Words and bigrams as columns


def _ids(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Numbers from 3 on of frequent words, in the order of their sorted hashes; others are their hash, below 0."""
    rest = h.view(np.int64) | np.int64(-(1 << 63))
    if not len(frequent):
        return rest
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, at + 3, rest)


def _bigrams(x: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b, c) of each word and the end of each text with words, and the text of each."""
    n = np.diff(woff)
    use = np.flatnonzero(n)
    size = np.where(n > 0, n + 2, 0)
    at = np.cumsum(size) - size
    seq = np.full(size.sum(), START, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    seq[np.arange(len(x)) + (at[doc] - woff[doc]) + 1] = x
    seq[at[use] + size[use] - 1] = END
    of = np.repeat(np.arange(len(n)), size)
    c = np.flatnonzero(np.arange(len(seq)) > at[of])
    return seq[c - 1], seq[c], of[c]


def _key(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(mix(b.view(np.uint64) * _K[0]) + c.view(np.uint64) * _K[1])


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the upper 32 bits."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _name(key: np.ndarray) -> np.ndarray:
    """44 bits that tell n-grams of a shard apart."""
    return mix(key) >> np.uint64(20)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns by byte planes: those of small numbers and differences compress to little."""
    n = len(columns[0])
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T.tobytes() for c in columns)
    return n.to_bytes(8, "little") + (pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if n else b"")


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n, widths = int.from_bytes(data[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    if not n:
        return [np.zeros(0, k) for k in kinds]
    raw, out, at = pa.Codec("zstd").decompress(data[8:], n * sum(widths), asbytes=True), [], 0
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


def _counted(b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different bigrams with the sums of their counts, in the order of their keys, and the keys."""
    key = _key(b, c)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return b[order[first]], c[order[first]], np.add.reduceat(n[order], first) if len(first) else n, key[first]


def _packed_counts(b: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    order = np.lexsort((c, b))
    return _pack(_steps(b[order]), c[order], n[order].astype(np.int32))


def _unpacked_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, c, n = _unpack(blob, np.int64, np.int64, np.int32)
    return np.cumsum(b), c, n.astype(np.int64)


# Training


def _word_counts(batches):
    lexer = alnum_lexer()
    for batch in batches:
        held = [np.zeros(0, np.uint64)]
        for _, _, data, offs in text_parts(batch.column(0)):
            held.append(lexer.words(data, offs)[2])
        w, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["k", "n"])


BLOBS = "shard int, blob binary"


def _blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["shard", "blob"])


def _text_counts(vocabulary, shards: int):
    """A row per shard for every ``FLUSH`` tokens of the texts."""

    def flushed(held):
        b, c = (np.concatenate(x) for x in zip(*held, strict=True))
        b, c, n, key = _counted(b, c, np.ones(len(b), np.int64))
        cut = np.searchsorted(_shard(key, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            x = slice(cut[s], cut[s + 1])
            yield _blob_rows([(s, _packed_counts(b[x], c[x], n[x]))])

    def run(batches):
        lexer, frequent = alnum_lexer(), vocabulary.value
        held, size = [], 0
        for batch in batches:
            for _, _, data, offs in text_parts(batch.column(0)):
                _, _, h, woff = lexer.words(data, offs)
                held.append(_bigrams(_ids(h, frequent), woff)[:2])
                size += len(h)
                if size >= FLUSH:
                    yield from flushed(held)
                    held, size = [], 0
        if held:
            yield from flushed(held)

    return run


def _merged(batches):
    """Rows sorted by shard: one row per shard."""
    shard, held, size = None, [], 0
    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if s != shard and held:
                yield _blob_rows([(shard, _packed_counts(*_counted(*map(np.concatenate, zip(*held, strict=True)))[:3]))])
                held, size = [], 0
            shard = s
            held.append(_unpacked_counts(blob.as_py()))
            size += len(held[-1][0])
            if size > 2 * SHARD:
                held = [_counted(*map(np.concatenate, zip(*held, strict=True)))[:3]]
                size = len(held[0][0]) // 2
    if held:
        yield _blob_rows([(shard, _packed_counts(*_counted(*map(np.concatenate, zip(*held, strict=True)))[:3]))])


def _statistics(batches):
    """Per word: before (different words before it), and as a context: followers seen once, twice, more often, and all tokens."""
    for batch in batches:
        for blob in batch.column(1):
            b, c, n = _unpacked_counts(blob.as_py())
            words, at = np.unique(np.r_[b, c], return_inverse=True)
            at_b, at_c, k = at[: len(b)], at[len(b) :], len(words)
            cols = [words, np.bincount(at_c, minlength=k), *(np.bincount(at_b[m], minlength=k) for m in (n == 1, n == 2, n >= 3)), np.bincount(at_b, n, k)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["w", "before", "k1", "k2", "k3", "total"])


def _counts_of_counts(batches):
    for batch in batches:
        for blob in batch.column(1):
            n, times = np.unique(np.minimum(_unpacked_counts(blob.as_py())[2], _MOST), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(times)], ["n", "times"])


def _rare_words(batches):
    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            b, c, _ = _unpacked_counts(blob.as_py())
            w = np.unique(np.r_[b[b < 0], c[c < 0]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), s, np.int32)), pa.array(w)], ["shard", "w"])


def _frequent_bigrams(least: int):
    def run(batches):
        for batch in batches:
            for blob in batch.column(1):
                b, c, n = _unpacked_counts(blob.as_py())
                x = (n >= least) & (b >= 0) & (c >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(y[x]) for y in (b, c, n)], ["b", "c", "n"])

    return run


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of counts of counts."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def _values(n, total, mass, p1, ds) -> np.ndarray:
    """What bigrams add to the log of their lower order."""
    low = mass * p1
    return np.log((n - np.array(ds)[np.minimum(n, 3) - 1]) / total + low) - np.log(low)


def train(trusted: DataFrame, text_col: str = "text") -> dict | None:
    """The model: ``blobs`` (shard, blob) of all bigram counts, ``rare`` words (w, p1, mass, total), the frequent words' values as arrays, and constants; None without words."""
    spark = trusted.sparkSession
    texts = trusted.select(F.col(text_col).alias("t")).where("t is not null")
    words = settle(texts.mapInArrow(_word_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "words")
    top = words.orderBy(F.desc("n"), "k").limit(FREQUENT).select("k").toArrow()["k"].to_numpy()
    if not len(top):
        return None
    frequent = np.sort(top.view(np.uint64))
    types, tokens, f1, f2 = words.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    discard(words)
    shards = min(max(8, -(-tokens // SHARD)), 1 << 31)
    sent = spark.sparkContext.broadcast(frequent)
    counts = texts.mapInArrow(_text_counts(sent, shards), BLOBS).repartition("shard").sortWithinPartitions("shard")
    blobs = settle(counts.mapInArrow(_merged, BLOBS), "bigrams")

    often = {n: times for n, times in blobs.mapInArrow(_counts_of_counts, "n long, times long").groupBy("n").agg(F.sum("times")).collect()}
    sums = [F.sum(c).alias(c) for c in ("before", "k1", "k2", "k3", "total")]
    stats = settle(blobs.mapInArrow(_statistics, "w long, before long, k1 long, k2 long, k3 long, total long").groupBy("w").agg(*sums), "contexts")
    d2 = _discounts(often)
    seen = stats.where("before > 0")
    kinds = dict(seen.groupBy(F.least("before", F.lit(5))).count().collect())
    total, different = seen.agg(F.sum("before"), F.count("*")).first()
    d1 = _discounts(kinds)
    # At least one word is unseen.
    size = different + max(f1 * f1 / (2 * f2) if f2 else f1 * (f1 - 1) / 2, 1)
    n1, n2 = kinds.get(1, 0), kinds.get(2, 0)
    base = (d1[0] * n1 + d1[1] * n2 + d1[2] * (different - n1 - n2)) / total / size
    own = F.when(F.col("before") == 1, d1[0]).when(F.col("before") == 2, d1[1]).otherwise(d1[2])
    p1 = F.when(F.col("before") > 0, (F.col("before") - own) / total + base)
    mass = F.when(F.col("total") > 0, (F.col("k1") * d2[0] + F.col("k2") * d2[1] + F.col("k3") * d2[2]) / F.col("total"))
    values = stats.select("w", p1.alias("p1"), mass.alias("mass"), F.col("total").cast("double").alias("total"))
    # As many rows as there are small numbers.
    known = values.where("w >= 0").toArrow()
    arrays = {}
    for name in ("p1", "mass", "total"):
        arrays[name] = np.ones(len(frequent) + 3)
        arrays[name][known["w"].to_numpy()] = known[name].fill_null(1.0).to_numpy()
    rare = settle(values.where("w < 0"), "rare")
    discard(stats)
    return {"frequent": frequent, "shards": int(shards), "blobs": blobs, "rare": rare, "often": often, "d2": d2, "base": base, **arrays}


# Scoring

STREAM = "shard int, kind int, a long, x double, y double, z double, blob binary, row long, doc_id {id}, lang string, held boolean, n_words long"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), None, pa.string(), pa.bool_(), pa.int64()]
#: What a row of the stream is, in the order a shard reads them: values of rare words, counts, requests, documents.
WORD, RARE, COUNTS, REQUEST, ANSWER, DOCUMENT = range(6)


def _stream(n: int, id_kind: pa.DataType, columns: dict[int, pa.Array]) -> pa.RecordBatch:
    """Rows of the stream with the given columns, by place; the others are null."""
    names = [x.split()[0] for x in STREAM.split(", ")]
    return pa.RecordBatch.from_arrays([columns[i] if i in columns else pa.nulls(n, k or id_kind) for i, k in enumerate(_KINDS)], names)


def _requests(model, id_kind: pa.DataType):
    def run(batches):
        lexer, m = alnum_lexer(), model.value
        keys, values, shards = m["keys"], m["values"], m["shards"]
        for batch in batches:
            rows, held, size, log_p, n_words = batch.column(0).to_numpy(), [], 0, [], []
            if not len(rows):
                continue
            # The batch goes by its first row's number, documents in it by their place (``y``).
            low = int(rows[0])

            def flushed(held):
                key, of = (np.concatenate(x) for x in zip(*held, strict=True))
                shard, name = _shard(key, shards), _name(key)
                order = np.argsort(shard.astype(np.uint64) << np.uint64(48) | name) if shards < 1 << 16 else np.lexsort((name, shard))
                shard, name, of = shard[order], name[order], of[order]
                cut = np.searchsorted(shard, np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cut)):
                    x = slice(cut[s], cut[s + 1])
                    blob = _pack(_steps(name[x]), of[x])
                    yield _stream(1, id_kind, {0: pa.array([s], pa.int32()), 1: pa.array([REQUEST], pa.int32()), 2: pa.array([low]), 6: pa.array([blob], pa.binary())})

            for lo, hi, data, offs in text_parts(batch.column(2)):
                _, _, h, woff = lexer.words(data, offs)
                w = _ids(h, m["frequent"])
                b, c, of = _bigrams(w, woff)
                n, words = hi - lo, np.diff(woff)
                doc = np.repeat(np.arange(n), words)
                own = w >= 0
                here = np.where(words > 0, m["start"] + m["end"] + words * m["base"], 0.0) + np.bincount(doc[own], m["u"][w[own]], n)
                key = _key(b, c)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hot = keys[at] == key
                here += np.bincount(of[hot], values[at[hot]], n)
                key, of = np.r_[key[~hot], _key(w[~own], np.full((~own).sum(), NONE))], np.r_[of[~hot], doc[~own]]
                may = bloom.among(m["bits"], key.view(np.int64))
                held.append((key[may], of[may] + lo))
                size += len(held[-1][0])
                log_p.append(here)
                n_words.append(words)
                if size >= FLUSH:
                    yield from flushed(held)
                    held, size = [], 0
            if size:
                yield from flushed(held)
            n = len(rows)
            # Documents only pass through a shard, any one.
            spread, base = pa.array((mix(rows.view(np.uint64)) % np.uint64(shards)).astype(np.int32)), pa.array(np.full(n, low))
            yield _stream(n, id_kind, {0: spread, 1: pa.array(np.full(n, DOCUMENT, np.int32)), 2: base, 4: pa.array(np.arange(n, dtype=np.float64)), 3: pa.array(np.concatenate(log_p)), 7: batch.column(0), 8: batch.column(1), 9: batch.column(3), 10: batch.column(4), 11: pa.array(np.concatenate(n_words))})

    return run


def _answers(model, id_kind: pa.DataType):
    """Of the stream sorted by shard and kind, an answer per request with sums by the places of documents in their batch, and the documents as they are."""

    def values_of(blob, m, words, word_values):
        b, c, n = _unpacked_counts(blob)
        rare_b, rare_c = b < 0, c < 0

        def of(name, i, w, rare):
            out = m[name][np.where(rare, 0, w)]
            out[rare] = word_values[i][np.searchsorted(words, w[rare])]
            return out

        v = _values(n, of("total", 2, b, rare_b), of("mass", 1, b, rare_b), of("p1", 0, c, rare_c), m["d2"])
        return _name(_key(b, c)), v

    def run(batches):
        m, shard = model.value, None
        words, names, values = [], [], []
        table = None
        for batch in batches:
            of_shard, of_kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, (of_shard[1:] != of_shard[:-1]) | (of_kind[1:] != of_kind[:-1])][: batch.num_rows])
            for at, until in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
                part, s, kind = batch.slice(at, until - at), int(of_shard[at]), int(of_kind[at])
                if s != shard:
                    shard, words, names, values, table = s, [], [], [], None
                if kind == WORD:
                    # Copies, so that the batch is not kept.
                    words.append([np.array(part.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3, 4, 5)])
                elif kind == RARE:
                    names.append(_name(part.column(2).to_numpy().view(np.uint64)))
                    values.append(np.array(part.column(3).to_numpy()))
                elif kind == COUNTS:
                    known = [np.concatenate(x) for x in zip(*words, strict=True)] if words else [np.zeros(0, np.int64)] * 4
                    order = np.argsort(known[0])
                    for blob in part.column(6):
                        k, v = values_of(blob.as_py(), m, known[0][order], [x[order] for x in known[1:]])
                        names.append(k)
                        values.append(v)
                elif kind == REQUEST:
                    if table is None:
                        k, v = (np.concatenate(x) if x else np.zeros(0) for x in (names, values))
                        order = np.argsort(k)
                        table, names, values, words = (k[order].astype(np.uint64), v[order]), [], [], []
                    if not len(table[0]):
                        continue
                    for low, blob in zip(part.column(2).to_pylist(), part.column(6), strict=True):
                        step, of = _unpack(blob.as_py(), np.uint64, np.int64)
                        name = np.cumsum(step)
                        place = np.minimum(np.searchsorted(table[0], name), len(table[0]) - 1)
                        hit = table[0][place] == name
                        if not hit.any():
                            continue
                        docs, where = np.unique(of[hit], return_inverse=True)
                        # In single precision, which packs better.
                        sums = np.bincount(where, table[1][place[hit]], len(docs)).astype(np.float32)
                        blob = _pack(_steps(docs.astype(np.int32)), sums)
                        yield _stream(1, id_kind, {0: pa.array([s], pa.int32()), 1: pa.array([ANSWER], pa.int32()), 2: pa.array([low]), 6: pa.array([blob], pa.binary())})
                else:
                    yield _stream(part.num_rows, id_kind, dict(enumerate(part.columns)))

    return run


def _summed(id_kind: pa.DataType):
    """Of answers and documents sorted by batch and kind, the documents with all sums added to ``x``."""

    def run(batches):
        low, sums, size = None, np.zeros(0), 0
        for batch in batches:
            of_batch, of_kind = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, (of_batch[1:] != of_batch[:-1]) | (of_kind[1:] != of_kind[:-1])][: batch.num_rows])
            for at, until in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(at, until - at)
                if int(of_batch[at]) != low:
                    low, sums = int(of_batch[at]), np.zeros(0)
                if of_kind[at] == ANSWER:
                    for blob in part.column(6):
                        step, x = _unpack(blob.as_py(), np.int32, np.float32)
                        docs = np.cumsum(step)
                        if docs[-1] >= len(sums):
                            sums = np.r_[sums, np.zeros(docs[-1] + 1 - len(sums))]
                        sums[docs] += x
                    continue
                place = part.column(4).to_numpy().astype(np.int64)
                x = np.array(part.column(3).to_numpy())
                known = place < len(sums)
                x[known] += sums[place[known]]
                yield _stream(len(x), id_kind, dict(enumerate(part.columns)) | {3: pa.array(x)})

    return run


def perplexities(docs: DataFrame, model: dict, hot: int = HOT) -> DataFrame:
    """``docs``: (row, doc_id, t, lang, held). One row each: row, doc_id, lang, held, n_words, perplexity."""
    spark = docs.sparkSession
    blobs, rare, base = model["blobs"], model["rare"], model["base"]
    # The count from which on there are no more than ``hot`` bigrams.
    least, taken = _MOST + 1, 0
    for n, times in sorted(model["often"].items(), reverse=True):
        if taken + times > hot:
            break
        least, taken = n, taken + times
    top = blobs.mapInArrow(_frequent_bigrams(least), "b long, c long, n long").toArrow()
    b, c, n = (top[x].to_numpy() for x in ("b", "c", "n"))
    keys, v = _key(b, c), _values(n, model["total"][b], model["mass"][b], model["p1"][c], model["d2"])
    order = np.argsort(keys)
    keys, v = (keys[order], v[order]) if len(keys) else (np.zeros(1, np.uint64), np.zeros(1))

    gain = F.log("p1") - math.log(base) + F.coalesce(F.log("mass"), F.lit(0.0))
    rare_values = rare.select("w", F.coalesce(gain, F.lit(0.0)).alias("x"))

    def rare_keys(batches):
        for batch in batches:
            w = batch.column(0).to_numpy()
            key = _key(w, np.full(len(w), NONE))
            yield pa.RecordBatch.from_arrays([pa.array(_shard(key, model_shards).astype(np.int32)), pa.array(key.view(np.int64)), batch.column(1)], ["shard", "a", "x"])

    def all_keys(batches):
        for batch in batches:
            for blob in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(_key(*_unpacked_counts(blob.as_py())[:2]).view(np.int64))], ["key"])

    model_shards = model["shards"]
    rare_rows = rare_values.mapInArrow(rare_keys, "shard int, a long, x double")
    bits = bloom.build(blobs.mapInArrow(all_keys, "key long").unionByName(rare_rows.selectExpr("a as key")), FILTER_BITS)
    u = np.log(model["p1"]) - math.log(base) + np.log(model["mass"])
    end, start = math.log(model["p1"][END]), math.log(model["mass"][START])
    parts = {"keys": keys, "values": v, "bits": bits, "u": u, "base": math.log(base), "start": start, "end": end, **{k: model[k] for k in ("frequent", "shards", "p1", "mass", "total", "d2")}}
    sent = spark.sparkContext.broadcast(parts)

    kind = docs.schema["doc_id"].dataType
    stream, id_kind = STREAM.format(id=kind.simpleString()), pa.schema(docs.select("doc_id").limit(0).toArrow().schema).field(0).type
    names = [x.split()[0] for x in STREAM.split(", ")]
    nulls = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in stream.split(", ")}
    rows = lambda df, **has: df.select(*(has.get(k, nulls[k]).alias(k) for k in names))
    kinds = lambda k: F.lit(k).cast("int")
    asked = blobs.mapInArrow(_rare_words, "shard int, w long").join(rare, "w")
    every = rows(asked, shard=F.col("shard"), kind=kinds(WORD), a=F.col("w"), x=F.col("p1"), y=F.col("mass"), z=F.col("total"))
    every = every.unionByName(rows(rare_rows, shard=F.col("shard"), kind=kinds(RARE), a=F.col("a"), x=F.col("x")))
    every = every.unionByName(rows(blobs, shard=F.col("shard"), kind=kinds(COUNTS), blob=F.col("blob")))
    every = every.unionByName(docs.select("row", "doc_id", "t", "lang", "held").mapInArrow(_requests(sent, id_kind), stream))
    found = every.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_answers(sent, id_kind), stream)
    found = found.repartition("a").sortWithinPartitions("a", "kind").mapInArrow(_summed(id_kind), stream)
    return found.select("row", "doc_id", "lang", "held", "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("x") / (F.col("n_words") + 1))).alias("perplexity"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", quantile: float = QUANTILE, few_labels: int = FEW_LABELS) -> DataFrame:
    """One row per document: ``doc_id, n_words, perplexity, threshold, kept``."""
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("g")).distinct()
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    if good.limit(few_labels + 1).count() <= few_labels:
        # The ids fit a broadcast of known size, so texts stay where they are.
        docs = docs.join(F.broadcast(good), F.col("doc_id") == F.col("g"), "left")
    else:
        docs = settle(docs.join(good, F.col("doc_id") == F.col("g"), "left"), "labelled")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HOLD_OUT == 0
    docs = docs.select("doc_id", "t", "lang", F.col("g").isNotNull().alias("good"), (F.col("g").isNotNull() & held).alias("held"), "row")
    model = train(docs.where("good and not held"), "t")
    if model is None:
        n = F.regexp_count(F.lower(F.coalesce("t", F.lit(""))), F.lit(ALNUM_WORD)).cast("long")
        return docs.select("doc_id", n.alias("n_words"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (n > 0).alias("kept"))
    scored = settle(perplexities(docs.select("row", "doc_id", "t", "lang", "held"), model), "perplexities")
    discard(model["blobs"])
    discard(model["rare"])
    known = scored.where("held and perplexity is not null")
    overall = known.agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))).first()[0]
    log_p = known.select(F.col("lang").alias("l"), F.log("perplexity").alias("x"))
    means = log_p.groupBy("l").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    # One row per language.
    off = log_p.join(F.broadcast(means.withColumnRenamed("l", "of")), F.col("l").eqNullSafe(F.col("of"))).select("l", "mean", "n", (F.col("x") - F.col("mean")).alias("off"))
    q = F.percentile_approx("off", F.lit(quantile), F.lit(10_000))
    shared = off.agg(q).first()[0]
    each = off.groupBy("l").agg(((F.first("n") * q + PRIOR * F.lit(shared).cast("double")) / (F.first("n") + PRIOR) + F.first("mean")).alias("q"))
    each = each.select("l", F.exp("q").alias("q"))
    found = scored.join(F.broadcast(each), F.col("lang").eqNullSafe(F.col("l")), "left")
    limit = F.coalesce("q", F.lit(overall).cast("double"))
    kept = F.coalesce((F.col("perplexity") <= limit) | (limit.isNull() & F.col("perplexity").isNotNull()), F.lit(False))
    return found.select("doc_id", "n_words", "perplexity", limit.alias("threshold"), kept.alias("kept"))
