"""Each training-data operator against SQL, a brute-force version or planted cases, with nulls, empties, ties and clashing names."""

import base64
import collections
import gzip
import hashlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from tessera.llm import decontaminate, exact_dedup, html_extract, language_id, lexer, licenses, mixing, near_dedup, quality_lm, queries, substring_dedup, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    assert not compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], duck)[:3]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_gives_a_row_per_row(spark, name):
    table = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def odd_docs(spark):
    """Nulls, empties, ties, repeated rows and columns that clash with the operators' own."""
    data = [(1, "a b c", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "a b c", "de", None), (4, "a b c", "de", None), (None, "A b c", "en", "t"), (5, "!?", "en", "s"), (6, "é" * 40_000 + " x", "fr", "s"), (7, "w" * 3 + " ", "en", "t")]
    docs = spark.createDataFrame(data, DOC)
    return docs.select("*", *(F.lit(1).alias(c) for c in ("row", "id", "th", "h", "size", "target", "b", "r", "names", "kept", "n_words", "w", "t", "p_0", "letter", "held")))


OPERATORS = {
    "exact": exact_dedup.exact_groups,
    "near": near_dedup.near_groups,
    "substring": substring_dedup.remove_repeats,
    "mix": mixing.mix_sources,
    "licences": licenses.scan,
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "leaks": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "b C"), (2, None), (3, "?")], "item_id long, text string")),
    "quality": lambda d: quality_lm.judge(d, d.sparkSession.createDataFrame([(1, 1), (3, 1), (2, 0), (None, 1)], "doc_id long, quality int")),
    "html": lambda d: html_extract.extract_pages(d, "doc_id", "lang", "text"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(spark, name):
    docs = odd_docs(spark)
    assert OPERATORS[name](docs).count() == 9
    assert OPERATORS[name](docs.limit(0)).count() == 0


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=repr)


def test_values_of_the_odd_table(spark):
    """What the docstrings say of nulls, empties, ties and repeated rows, operator by operator."""
    docs = odd_docs(spark)
    rows = lambda f: sorted([(1, *f(3)), (2, *f(0)), (3, *f(0)), (4, *f(3)), (4, *f(3)), (None, *f(3)), (5, *f(None)), (6, *f(2)), (7, *f(1))], key=repr)
    near = by_id(OPERATORS["near"](docs), "class_id", "class_size", "kept")
    assert near == sorted([(1, 1, 4, True), (2, 2, 1, True), (3, 3, 1, True), (4, 1, 4, False), (4, 1, 4, False), (None, 1, 4, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)], key=repr)
    # "!?" is one word where white space tells words apart and none where letters do.
    assert by_id(OPERATORS["substring"](docs), "n_words", "n_removed") == rows(lambda n: (1 if n is None else n, 0))
    assert by_id(OPERATORS["mix"](docs), "size") == rows(lambda n: (1 if n is None else n,))
    mixed = OPERATORS["mix"](docs).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in mixed) and sum(r.taken for r in mixed) == round(1.5 * 16)
    assert by_id(OPERATORS["licences"](docs), "licence", "line_licences") == rows(lambda n: (None, ""))
    one = hashlib.sha256(b"1").hexdigest(), True
    none = hashlib.sha256(b"").hexdigest(), False
    assert by_id(OPERATORS["leaks"](docs), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == rows(lambda n: (3, 2, 1, *one) if n == 3 else (n or 0, 0, 0, *none))
    judged = OPERATORS["quality"](docs)
    assert by_id(judged, "n_words") == rows(lambda n: (n or 0,))
    # Nothing is held out of so few texts, so whatever has words is kept.
    assert by_id(judged, "kept") == rows(lambda n: (bool(n),))
    assert all((r.perplexity is None) == (not r.n_words) for r in judged.collect())
    pages = sorted((tuple(r) for r in OPERATORS["html"](docs).select("page_id", "text", "n_chars").collect()), key=repr)
    assert [x[2] for x in pages] == [len(x[1]) for x in pages] and {x[1] for x in pages if x[0] in (2, 3)} == {""}


# Lexer


def test_lexer_finds_the_words_of_the_pattern():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB1 é\t\n.|Z—") for _ in range(rnd.randint(0, 40))) for _ in range(500)] + [None]
    for lex, pattern, norm in ((lexer.space_lexer(), SPACE, lambda s: s or ""), (lexer.alnum_lexer(), ALNUM, fold)):
        seen = {}
        for lo, hi, data, offs in lexer.text_parts(pa.array(texts)):
            starts, ends, h, at = lex.words(data, offs)
            for i in range(lo, hi):
                mine = range(at[i - lo], at[i - lo + 1])
                words = [norm(data[starts[j] : ends[j]].tobytes().decode()) for j in mine]
                assert words == pattern.findall(norm(texts[i]))
                for j, w in zip(mine, words, strict=True):
                    assert seen.setdefault(w, h[j]) == h[j]
        assert len(set(seen.values())) == len(seen)


# Exact dedup


def test_block_names_do_not_depend_on_hashes(spark):
    """With 2-bit buckets nearly all blocks collide; the groups stay exact."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    texts += [t.upper() for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, block_bytes=4, bucket_bits=2).collect()}
    same = collections.defaultdict(list)
    for i, t in enumerate(texts):
        same[t.lower()].append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in same.values() for i in g}


def test_exact_dedup_plans_do_not_grow_with_the_levels(spark, monkeypatch):
    """A text of 32 blocks has five levels; each level's plan is about as long as the first one's."""
    plans, ranks = [], exact_dedup._ranks

    def measured(contents, level):
        plans.append(len(contents._jdf.queryExecution().optimizedPlan().toString()))
        return ranks(contents, level)

    monkeypatch.setattr(exact_dedup, "_ranks", measured)
    texts = ["ab" * 64, "AB" * 64, "ab" * 63 + "ac", "ab" * 64 + "a", "ab" * 9, "ab", "ab" * 9, "AB", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, block_bytes=4).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (6, 2), 5: (7, 2), 6: (6, 2), 7: (7, 2), 8: (9, 2), 9: (9, 2)}
    assert len(plans) == 7 and max(plans[1:]) < 1.5 * plans[1], plans


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    kept = exact_dedup.exact_groups(odd_docs(spark)).where("kept").select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [3, 4, 5, 6, 7]


# Near-dedup


def bag(text, k=5):
    w = ALNUM.findall(fold(text))
    k = min(k, len(w))
    return collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter()


def brute_near(texts):
    bags, up = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        low = sum((bags[i] & bags[j]).values())
        if low and low >= 0.8 * sum((bags[i] | bags[j]).values()):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def near(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near_dedup.near_groups(docs, **kw).collect()}


def test_near_groups_are_the_components_of_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice((6, 60, 300)))]
        for _ in range(rnd.randint(1, 6)):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 60))):
                t[rnd.randrange(len(t))] = word()
            texts.append(" ".join(t) if rnd.random() < 0.7 else ", ".join(t).upper())
    texts += ["", None, "x", "X!"]
    assert near(spark, texts) == brute_near(texts)


def test_near_links_among_nodes_that_no_leader_resembles(spark):
    """Families share half of their runs, so every bucket of one row mixes them."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    core, texts = [word() for _ in range(200)], []
    for _ in range(40):
        own = core + [word() for _ in range(80)]
        for _ in range(rnd.randint(1, 4)):
            t = list(own)
            t[rnd.randrange(len(t))] = word()
            texts.append(" ".join(t))
    rnd.shuffle(texts)
    want = brute_near(texts)
    assert 10 < len(set(want.values())) < len(texts)
    assert near(spark, texts, bands=3, rows=1) == want


@pytest.mark.parametrize("seed", range(4))
def test_candidates_hold_every_similar_pair_of_two_classes(spark, seed):
    """Sets of all sizes over few elements, some of them held by nearly every node."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(60):
        base = set(rnd.sample(range(60), rnd.randint(1, 40)))
        texts += [base ^ set(rnd.sample(range(60), rnd.randint(0, 4))) or {1} for _ in range(rnd.randint(1, 3))]
    sets = spark.createDataFrame([(i, sorted(t)) for i, t in enumerate(texts)], "node long, s array<long>")
    among = [(i, rnd.randrange(30) if i % 3 else 7) for i in range(len(texts))]
    met = {(r.a, r.b) for r in near_dedup._candidates(sets, spark.createDataFrame(among, "node long, c long"), 0.8).collect()}
    met |= {(b, a) for a, b in met}
    for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2):
        if len(x & y) >= 0.8 * len(x | y) and among[i][1] != among[j][1]:
            assert (i, j) in met
    assert len(met) < len(texts) ** 2 / 4


def test_near_recall_against_all_pairs_of_a_table(spark):
    """Every document of the table against all others: at least 0.9 of the links join one class (measured: all)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    bags = {i: bag(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, b in bags.items():
        for g in b:
            holders[g].append(i)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs).collect()}
    links = found = 0
    for i, b in bags.items():
        low = collections.Counter()
        for g, n in b.items():
            for j in holders[g]:
                if j > i:
                    low[j] += min(n, bags[j][g])
        for j, n in low.items():
            if n >= 0.8 * (b.total() + bags[j].total() - n):
                links += 1
                found += classes[i] == classes[j]
    assert links > 20 and found >= 0.9 * links


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.r_[a[:240], rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    sig = near_dedup.dart_signatures(np.r_[a, b], np.repeat([0, 1], 300), np.array([300, 300]), 2048)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.05


# Substring dedup


def brute_repeats(texts, window):
    words = [SPACE.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    passages = [[rnd.choice("abcdefghij") for _ in range(rnd.randint(8, 40))] for _ in range(6)]
    texts = [None, "", "a"]
    for _ in range(60):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(passages)[rnd.randint(0, 5) :] if rnd.random() < 0.6 else [rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 15))]
        texts.append(rnd.choice((" ", "\n", " \t ")).join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, window=9, base=3).collect()}
    for i, (n, gone, kept) in enumerate(brute_repeats(texts, 9)):
        assert got[i] == (n, gone, kept, hashlib.sha256(kept.encode()).hexdigest())


def test_levels_double_up_to_the_window():
    assert substring_dedup.levels(35, 8) == [16, 32, 35] and substring_dedup.levels(8, 8) == []


# Mixing


def test_water_filling_clamps_and_hands_on(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 40)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a, b, c, null weigh 3, 1, 2, 3 of 1725 words; a and null stop at 20 and 80, b at 200.
    assert got == {"a": 20.0, "b": 200.0, None: 80.0, "c": pytest.approx(1425.0)}


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (mixing.mix_sources(docs).toPandas() for _ in range(2))
    assert a.sort_values("doc_id").equals(b.sort_values("doc_id").set_index(a.sort_values("doc_id").index))
    assert (a.taken <= 2 * a["size"]).all()
    per = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per.taken - per.target) <= 1).all()


# Decontamination


@pytest.mark.parametrize("window", [1, 10, 40])
def test_shared_runs_against_brute_force(spark, window):
    """Repeated rows, items that share runs, and windows longer than most items."""
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghijkl") * rnd.randint(1, 2)
    items = [" ".join(word() for _ in range(rnd.choice((1, 3, 9, 10, 14, 30, 60)))) for _ in range(30)] + [None, "--"]
    items += [items[0], items[1] + " " + items[2], items[5].upper()]
    docs = []
    for _ in range(60):
        w = [word() for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            w[5:5] = (rnd.choice(items) or "").upper().split()
        docs.append(rnd.choice((" ", ", ", "\n")).join(w))
    want = []
    for t in docs:
        w = ALNUM.findall(fold(t))
        hit, of = set(), set()
        for k, item in enumerate(items):
            x = ALNUM.findall(fold(item))
            n = min(window, len(x))
            runs = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in runs:
                    hit |= set(range(i, i + n))
                    of.add(str(k))
        want.append((len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.decontaminate(d.unionAll(d), b, window=window, gram=min(5, window)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *w) for i, w in enumerate(want) for _ in range(2))


# Language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs), payload=("lang",)).where("held_out").toPandas()
    assert (found.lang_pred == found.p_0).mean() > 0.98
    assert found.score.between(0, 1).all() and not found.rejected.any()


def test_texts_without_letters_are_und(spark):
    found = {r.doc_id: r for r in OPERATORS["language"](odd_docs(spark)).collect()}
    for i in (2, 3, 5):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[1].lang_pred != "und"


def test_sample_is_bounded_by_rows(spark):
    """One document repeated, and one id with many texts."""
    same = [(3, "the same text again and again", "en")] * 500 + [(3, f"ein anderer Text mit der Zahl {i} und mehr", "de") for i in range(500)]
    docs = spark.createDataFrame(same, "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample=40, centroids=2)
    assert model["langs"] == ["de", "en"] and [int(x) for x in np.bincount(model["owner"])] == [2, 1]
    got = {r.lang_pred for r in language_id.identify(docs.where("lang = 'en'"), model).collect()}
    assert got == {"en"}


FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "letters": "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz    ", k=600)),
    "base64": base64.b64encode(random.Random(7).randbytes(450)).decode(),
    "long letters": "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyz    ", k=20_000)),
}


def test_foreign_and_random_texts_are_rejected_and_clean_ones_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    planted = spark.createDataFrame(list(FOREIGN.items()), "doc_id string, text string")
    found = {r.doc_id: r.rejected for r in language_id.identify(planted, model).collect()}
    assert found == dict.fromkeys(FOREIGN, True)
    # Clean texts, whole and cut to the length of the planted ones.
    clean = docs.where("lang is not null and length(text) > 400").select("doc_id", F.explode(F.array("text", F.substring("text", 1, 300))).alias("text"))
    assert language_id.identify(clean, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.01


def test_grams_reach_all_cells():
    text = "".join(random.Random(12).choices("abcdefghijklmnopqrstuvwxyz", k=200_000)).encode()
    cells, _ = language_id.gram_cells(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert language_id.DIMS == 1 << 14 and language_id.DIMS // 2 < len(np.unique(cells)) and cells.max() < language_id.DIMS


def test_every_labelled_language_is_learned(spark):
    rnd = random.Random(11)
    data = []
    for k in range(80):
        words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(8)]
        data += [(f"l{k}", " ".join(rnd.choices(words, k=30))) for _ in range(16)]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "doc_id long, lang string, text string")
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, payload=("lang",)).toPandas()
    assert len(model["langs"]) == 80 and (found.lang_pred == found.p_0).mean() > 0.98 and found.rejected.mean() < 0.01


# Pages


def cut_cost(leans, edges, labels):
    return sum(abs(x) for x, keep in zip(leans, labels, strict=True) if keep != (x > 0)) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_min_cut_is_minimal():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(1, 9)
        leans = [rnd.randint(-10, 10) for _ in range(n)]
        edges = [(i, j, rnd.randint(0, 8)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4]
        every = {x: cut_cost(leans, edges, x) for x in itertools.product((False, True), repeat=n)}
        least = min(every.values())
        most = max((x for x, cost in every.items() if cost == least), key=sum)
        for fold in (6, 0):
            html_extract._FOLD = fold
            got = html_extract.min_cut(leans, edges)
            html_extract._FOLD = 6
            assert every[tuple(got)] == least
            # Of several, the one with most content, whichever way it is found.
            assert tuple(got) == most


def test_long_weak_pages_take_time_in_proportion():
    rnd = random.Random(3)
    n = 8000
    blocks = [("", 0, "p", 0, False, rnd.randrange(n // 4) if rnd.random() < 0.3 else i // 5) for i in range(n)]
    leans = [rnd.randint(-900, 900) for _ in range(n)]
    began = time.perf_counter()
    html_extract.min_cut(leans, html_extract.edges_of([(*b[:5], i // 5) for i, b in enumerate(blocks)]))
    assert time.perf_counter() - began < 2


def test_extract_is_the_best_of_all_labellings():
    """Pages of up to 11 blocks against every labelling under the same costs."""
    rnd = random.Random(13)
    say = lambda k: " ".join(rnd.choice(("word", "other", "more", "text", "here")) for _ in range(k)).capitalize()
    opens = ['<div class="notice-board-history">', "<div>", '<div class="ad">', "<section id=main-story>", '<ul class="menu-items-of-old">', "<aside>"]
    for _ in range(150):
        page, depth = [], []
        for _ in range(rnd.randint(1, 9)):
            if rnd.random() < 0.5:
                page.append(rnd.choice(opens))
                depth.append(re.match(r"<(\w+)", page[-1])[1])
            page.append(rnd.choice(("<p>{}.</p>", "<h2>{}</h2>", "<a href=x>{}</a><br>", "<li>{}")).format(say(rnd.randint(1, 30))))
            if depth and rnd.random() < 0.4:
                page.append(f"</{depth.pop()}>")
        blocks = html_extract.blocks_of("".join(page))
        leans, edges = [html_extract.lean(b) for b in blocks], html_extract.edges_of(blocks)
        every = {x: cut_cost(leans, edges, x) for x in itertools.product((False, True), repeat=len(blocks))}
        best = max((x for x, cost in every.items() if cost == min(every.values())), key=sum)
        assert html_extract.extract("".join(page)) == "\n".join(b[0] for b, keep in zip(blocks, best, strict=True) if keep)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>One two three four five six seven.", "One two three four five six seven."),
        ("<body><header><p>Site name here.</p></header><div id=content><h1>Ti&amp;tle</h1><p>A  long\nparagraph of the article itself.</p></div><aside class=sidebar><p>Read also many other things here.</p></aside></body>", "Ti&tle\nA long paragraph of the article itself."),
        ("<main><p>The first paragraph of it.</p><div class='ad-box'>Buy now and save a lot of money.</div><script>var a='</p>';</script><p>Short.</p></main><div id='comments'><p>A reader wrote this remark about it.</p></div>", "The first paragraph of it.\nShort."),
        ("<article><form><label>Mail</label><input></form><p>Text of <b>an <i>article</b> here.<p>And more<br>of it &copy; today.", "Text of an article here.\nAnd more of it © today."),
        ('<div class="entry-content"><p>The contract ends as agreed by both.</p><div class="notice-period"><p>The notice period is three months for both.</p></div></div>', "The contract ends as agreed by both.\nThe notice period is three months for both."),
        ('<article><p>It holds that <math><mi>a</mi><mo>=</mo><mn>1</mn></math> for all of these.</p></article>', "It holds that a=1 for all of these."),
        ("<article><p>Before the list of things there.</p><select><option>one<p>After the list there is more of it.</p></article>", "Before the list of things there.\none\nAfter the list there is more of it."),
        ('<article><p>The text of the article is here.</p><div class="comments-area"><p>A reader wrote this remark about it.</p></div><div class="related-posts"><p>Read also this other thing of ours.</p></div></article>', "The text of the article is here."),
        ("<article><p>Seen text is right here.</p><!-- <p>gone</p> --><style>p{}</style><p hidden>Not shown at all here.</p></article", "Seen text is right here."),
    ],
)
def test_pages(page, text):
    assert html_extract.extract(page) == text


# WARC


def archive(n=6):
    return [warc._record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * (i + 1), None) + b"\r\n" for i in range(n)]


def records(data):
    return [(warc._page(x[3]["warc-record-id"]), warc.payload_of(x[4])) for x in warc.salvage(data) if x[0] == "record"]


def test_round_trip_and_recovery():
    parts = archive()
    whole = [(i, f"<p>{i}</p>".encode() * (i + 1)) for i in range(6)]
    assert records(b"".join(parts)) == records(b"".join(map(gzip.compress, parts))) == records(gzip.compress(b"".join(parts))) == whole
    for make in (lambda x: x, gzip.compress):
        bad = [make(x) for x in parts]
        hurt = bytearray(bad[2])
        hurt[-8] ^= 0xFF
        bad[2] = bytes(hurt)
        data = b"".join([b"junk", *bad])
        assert records(data) == [x for x in whole if x[0] != 2]
        gaps = [x[1:3] for x in warc.salvage(data) if x[0] == "gap"]
        at = 4 + len(bad[0]) + len(bad[1])
        assert gaps == [(0, 4), (at, at + len(bad[2]))]
    assert records(b"".join(parts)[:-9]) == whole[:5] and records(b"") == []


def test_damaged_members_give_what_came_before():
    parts = archive(40)
    packed = bytearray(gzip.compress(b"".join(parts), 0))
    at = packed.index(b"urn:tessera:page:30>")
    packed[at + 17] ^= 1
    got = records(bytes(packed))
    # Stored blocks: the damage shows in one record's digest or in the checksum at the end.
    assert [x[0] for x in got[:30]] == list(range(30)) and len(got) >= 38
    assert [x[0] for x in records(gzip.compress(b"".join(parts))[:-200])][:20] == list(range(20))


def test_digests_go_by_their_algorithm():
    def made(digest):
        return warc._record(1, "u", b"page", None).replace(f"WARC-Payload-Digest: sha1:{warc.sha1_base32(b'page')}".encode(), f"WARC-Payload-Digest: {digest}".encode()) + b"\r\n"

    good = [f"sha256:{hashlib.sha256(b'page').hexdigest()}", f"MD5:{hashlib.md5(b'page').hexdigest().upper()}", f"sha1:{warc.sha1_base32(b'page').lower()}", f"sha-1:{hashlib.sha1(b'page').hexdigest()}", "blake9:xyz", "sha1:short", ""]
    for digest in good + [f"sha256:{hashlib.sha256(b'other').hexdigest()}"]:
        rows = [r for b in warc._read([pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([made(digest)])], ["path", "content"])]) for r in b.to_pylist()]
        assert [r["kind"] for r in rows] == ["record" if digest in good else "gap"]


def test_reader_survives_random_damage():
    rnd = random.Random(8)
    plain = archive(8)
    for data in (b"".join(plain), b"".join(map(gzip.compress, plain)), gzip.compress(b"".join(plain))):
        for _ in range(150):
            hurt = bytearray(data)
            for _ in range(rnd.randint(1, 6)):
                i = rnd.randrange(len(hurt))
                kind = rnd.random()
                if kind < 0.5:
                    hurt[i] = rnd.randrange(256)
                elif kind < 0.75:
                    del hurt[i : i + rnd.randint(1, 50)]
                else:
                    hurt[i:i] = rnd.choice(["²", "9" * 5000, "WARC/1.1\r\n", "\r\n\r\n", "\x1f"]).encode()
            found = list(warc.salvage(bytes(hurt)))
            # No digest covers the head, so its values may be damaged.
            assert all("warc-type" in x[3] for x in found if x[0] == "record")
            assert all(0 <= x[1] < x[2] <= len(hurt) for x in found)
    head = warc._record(1, "u", b"page", None).replace(b"Content-Length: ", "Content-Length: ²".encode())
    assert [x[0] for x in warc.salvage(head)] == ["gap"]


def test_reading_takes_time_in_proportion():
    def took(n):
        data = b"".join(gzip.compress(x, 1) for x in archive(20)) * (n // 20)
        began = time.perf_counter()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == n
        return time.perf_counter() - began

    took(200)
    assert took(16_000) < 20 * max(took(2_000), 0.05)


def test_members_made_to_explode_are_cut():
    bomb = gzip.compress(b"".join(archive(3)) + b"x" * 50_000_000)
    found = list(warc.salvage(bomb + gzip.compress(archive(1)[0]), most=1 << 20))
    assert [x[0] for x in found].count("record") == 4
    assert any("more than" in str(x[3]) for x in found if x[0] == "gap")


def test_archives_of_empty_tables_and_long_payloads(spark):
    pages = spark.createDataFrame([(1, None, "é" * 3_000_000), (2, "u", None)], "page_id long, url string, html string")
    assert warc.page_records(spark, pages.limit(0)).count() == 0
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.url) for r in warc.page_records(spark, pages).collect()}
    assert got == {1: (6_000_000, warc.sha1_base32("é".encode() * 3_000_000), None), 2: (0, warc.sha1_base32(b""), "u")}


def test_archives_of_odd_pages(spark):
    data = [(1, "u", "x"), (2, "a\nb", "x"), (3, "v", None), (4, None, ""), (5, "w", "é"), (5, "w", "é"), (None, "n", "q")]
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_records(spark, spark.createDataFrame(data, "page_id long, url string, html string").withColumn("sha", F.lit(1))).collect()}
    assert got == {(1, "revisit", 2, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 2), (None, "response", None, 1)}


# Licences


def test_whole_texts_and_lines(spark):
    mit, bsd = licenses.LICENCES[0][2], licenses.LICENCES[5][2]
    data = [(1, "Copyright (c) 2020 A B\n\n" + mit), (2, "mit licence\n(c) 2001 X\n" + mit.upper()), (3, bsd.replace(" license", " licence")), (4, "x\nReleased under the MIT Licence!\n"), (5, mit + "\nand more")]
    got = {r.doc_id: (r.licence, r.line_licences) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: None, 5: None}
    assert got[4][1] == "MIT"


def test_whole_texts_are_known_in_any_spelling(spark):
    texts = {name: text for name, _, text in licenses.LICENCES if len(text) > 300}
    other = lambda t: t.upper().replace("LICENSE", "Licence").replace("COPYRIGHT HOLDER", "copyright owner").replace("NONINFRINGEMENT", "non-infringement").replace(". ", ".\n").replace(",", " ,")
    data = [(i, make(t), name) for i, (name, t) in enumerate(sorted(texts.items())) for make in (str, other, lambda t: "Copyright (c) 2024 Jane Doe\n\n" + t, lambda t: t + " And more.")]
    docs = spark.createDataFrame(data, "doc_id long, text string, name string")
    got = [r.licence for r in licenses.scan(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")).orderBy("doc_id").collect()]
    want = [None if j % 4 == 3 else name for j, (_, _, name) in enumerate(data)]
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no published texts here")
def test_digests_of_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    data = []
    for file, name in names.items():
        with open(f"/usr/share/common-licenses/{file}") as f:
            text = f.read()
        data += [(len(data), text, name), (len(data) + 1, " ".join(text.replace("license", "licence").split(" ")), name), (len(data) + 2, text[:-60], None)]
    found = licenses.scan(spark.createDataFrame(data, "doc_id long, text string, name string")).orderBy("doc_id").collect()
    assert [r.licence for r in found] == [name for _, _, name in data]


# Quality


def brute_perplexity(texts, scored):
    """Modified Kneser-Ney bigrams with plain dictionaries; every word is its own, nothing is pruned."""
    C = collections.Counter
    words = [w for w in (ALNUM.findall(fold(t)) for t in texts) if w]
    pad = lambda x: ["<s>", *x, "</s>"]
    pair = C(p for x in words for p in itertools.pairwise(pad(x)))
    before, total, left = C(c for _, c in pair), C(), collections.defaultdict(C)
    for (b, _), n in pair.items():
        total[b] += n
        left[b][min(n, 3)] += 1

    def discounts(counts):
        n1, n2, n3, n4 = (sum(v == i for v in counts.values()) for i in (1, 2, 3, 4))
        if not n1 or not n2:
            return (0.5,) * 3
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
        return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))

    d2, d1 = discounts(pair), discounts(before)
    uses = C(w for x in words for w in x)
    f1, f2 = (sum(n == i for n in uses.values()) for i in (1, 2))
    unseen = max(f1 * f1 / (2 * f2) if f2 else f1 * (f1 - 1) / 2, 1)
    every = sum(before.values())
    base = sum(d1[min(n, 3) - 1] for n in before.values()) / every / (len(before) + unseen)
    p1 = lambda c: base + (max(before[c] - d1[min(before[c], 3) - 1], 0) / every if before[c] else 0)

    def p2(b, c):
        if b not in total:
            return p1(c)
        n = pair.get((b, c), 0)
        mass = sum(d2[k - 1] * m for k, m in left[b].items()) / total[b]
        return (max(n - d2[min(n, 3) - 1], 0) / total[b] if n else 0) + mass * p1(c)

    out = []
    for t in scored:
        s = pad(ALNUM.findall(fold(t)))
        out.append(float(np.exp(-np.mean([np.log(p2(b, c)) for b, c in itertools.pairwise(s)]))) if len(s) > 2 else None)
    return out


SCORED = "row long, doc_id long, t string, lang string, held boolean"


def scores(spark, texts, model, **kw):
    docs = spark.createDataFrame([(i, i, t, "en", False) for i, t in enumerate(texts)], SCORED).repartition(3)
    return [r.perplexity for r in quality_lm.perplexities(docs, model, **kw).orderBy("row").collect()]


@pytest.mark.parametrize("hot,frequent", [(0, 4), (7, 4), (1 << 20, 4), (1 << 20, 1 << 18)])
def test_perplexity_against_dictionaries(spark, monkeypatch, hot, frequent):
    """Also with words beyond the numbered ones, many shards and small batches."""
    monkeypatch.setattr(quality_lm, "FREQUENT", frequent)
    monkeypatch.setattr(quality_lm, "FLUSH", 300)
    monkeypatch.setattr(quality_lm, "SHARD", 100)
    rnd = random.Random(8)
    vocabulary = [a + b for a in "abcdefgh" for b in ("", "x", "yy", "é")]
    weights = [1.3**-i for i in range(len(vocabulary))]
    text = lambda: " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(0, 40)))
    good = [text() for _ in range(80)]
    other = [*(text() for _ in range(20)), *good[:20], "zz yy a b", "", None, "h h h h h", "a", "zz", "A, a; É"]
    model = quality_lm.train(spark.createDataFrame([(t,) for t in good], "text string").repartition(4))
    want = brute_perplexity(good, other)
    assert scores(spark, other, model, hot=hot) == [None if w is None else pytest.approx(w, rel=1e-6) for w in want]


def test_unknown_words_cost(spark):
    """Words as frequent as in language: the k-th with a share of 1 / k."""
    rnd = random.Random(9)
    words, weights = [f"w{i}" for i in range(9000)], [1 / (i + 1) for i in range(9000)]
    text = lambda: " ".join(rnd.choices(words, weights, k=60))
    model = quality_lm.train(spark.createDataFrame([(text(),) for _ in range(400)], "text string"))
    seen, junk = scores(spark, [text(), " ".join(f"x{i}" for i in range(60))], model)
    assert junk > 3 * seen


def test_judge_against_plain_thresholds(spark):
    """Default parameters: perplexities by dictionaries, thresholds and what is kept by their definition; few and many labels give the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(None, "a b c", "en"), (1, "x y", None), (70_001, "", "en"), (70_002, None, None)], "doc_id long, text string, lang string"))
    ids = [r[0] for r in docs.select("doc_id").collect()]
    good = {i for i in ids if i is not None and i % 3}
    labels = spark.createDataFrame([(i, int(i in good)) for i in set(ids) if i is not None] + [(None, 1)], "doc_id long, quality int")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % quality_lm.HOLD_OUT == 0
    pp = brute_perplexity([t for i, t, _ in rows if i in good and not held(i)], [t for _, t, _ in rows])
    known = [(l, p) for (i, _, l), p in zip(rows, pp, strict=True) if i in good and held(i) and p is not None]
    assert len(known) > 5
    quantile = lambda x: sorted(x)[max(int(np.ceil(quality_lm.QUANTILE * len(x))) - 1, 0)]
    mean = {l: float(np.mean([np.log(p) for m, p in known if m == l])) for l, _ in known}
    off = [(l, np.log(p) - mean[l]) for l, p in known]
    shared = quantile([x for _, x in off])
    limit = {}
    for l in mean:
        own = [x for m, x in off if m == l]
        limit[l] = float(np.exp(mean[l] + (len(own) * quantile(own) + quality_lm.PRIOR * shared) / (len(own) + quality_lm.PRIOR)))
    overall = quantile([p for _, p in known])
    want = sorted(((i if i is not None else -1), p or 0, limit.get(l, overall), p is not None and p <= limit.get(l, overall) * (1 + 1e-9)) for (i, _, l), p in zip(rows, pp, strict=True))
    for few in (1 << 20, 1):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.perplexity or 0, r.threshold, r.kept) for r in quality_lm.judge(docs, labels, few_labels=few).collect())
        for x, y in zip(got, want, strict=True):
            assert x[0] == y[0] and x[3] == y[3]
            assert x[1:3] == (pytest.approx(y[1], rel=1e-5), pytest.approx(y[2], rel=1e-5))


def test_small_languages_have_their_own_threshold(spark):
    """Four languages, two of them with few trusted texts and one without any."""
    rnd, data = random.Random(10), []
    for lang, n, size in (("en", 400, 30), ("fr", 60, 3000), ("de", 40, 30), ("it", 0, 30)):
        data += [(len(data) + i, " ".join(f"{lang}{rnd.randrange(size)}" for _ in range(50)), lang) for i in range(n + 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    trusted = docs.where("lang <> 'it'").select("doc_id", F.lit(1).alias("quality"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % quality_lm.HOLD_OUT == 0
    few = {r[0]: r[1] for r in docs.where(held).groupBy("lang").count().collect()}
    assert 0 < few["fr"] < 20 and 0 < few["de"] < 20
    judged = quality_lm.judge(docs, trusted).join(docs, "doc_id")
    limits = {r[0]: r[1] for r in judged.groupBy("lang").agg(F.first("threshold")).collect()}
    assert len({limits[x] for x in ("en", "fr", "de")}) == 3 and limits["fr"] > 5 * limits["en"] and limits["de"] < 5 * limits["en"]
    assert limits["it"] not in {limits[x] for x in ("en", "fr", "de")}
