"""Operators whose work must not grow faster than their input."""

from pyspark.sql import functions as F

from tessera.operators import modules


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_hub_types_never_pairs_owners_with_users(spark):
    # One type has 300,000 owners and as many users: their pairs would be 90 billion.
    exports = spark.range(300_000).select(F.lit("t").alias("type"), F.col("id").cast("string").alias("owner"))
    exports = exports.union(spark.createDataFrame([("one", "x"), ("two", "x"), ("two", "y")], "type string, owner string"))
    imports = spark.range(300_000).select(F.lit("t").alias("type"), F.col("id").cast("string").alias("user"))
    imports = imports.union(spark.createDataFrame([("one", "x"), ("one", "z"), ("two", "x"), ("two", "y"), ("none", "x")], "type string, user string"))
    assert rows(modules.hub_types(exports, imports), "type", "n_users") == [("t", 300_000), ("two", 2)]
    assert rows(modules.hub_types(exports, imports, least=1, top=1), "type", "n_users") == [("t", 300_000)]


def test_vector_search_is_exact_across_blocks_ties_and_odd_rows(spark, monkeypatch):
    import numpy as np

    from tessera.operators import search

    monkeypatch.setattr(search, "VECTORS", 7)
    monkeypatch.setattr(search, "ASKED", 3)
    r = np.random.default_rng(1)
    m = np.repeat(r.normal(size=(30, 5)).round(2), 4, axis=0)  # each vector four times: ties go to the smallest id
    data = [(int(i), [float(x) for x in m[i]]) for i in r.permutation(len(m))]
    odd = [(900, None), (901, []), (902, [0.0] * 5), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [1.0, 2.0])]
    v = spark.createDataFrame(data + odd, "id long, vec array<double>")
    got = search.vector_search(v, v.where("id % 10 = 0 or id > 899").select(F.col("id").alias("query_id"), "vec"), 6)
    want = []
    for q in [*range(0, len(m), 10), 904]:
        a = m[q] if q < 900 else np.array([1.0, 2.0])
        of = [(904, a)] if q == 904 else list(enumerate(m))
        s = sorted((-round(float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))), 6), i) for i, b in of)[:6]
        want += [(q, i, -x, k + 1) for k, (x, i) in enumerate(s)]
    assert rows(got, "query_id", "id", "score", "rank") == sorted(want)


def test_vector_search_of_200_million_pairs_ends_soon(spark):
    import time

    from tessera.operators import search

    v = spark.range(100_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin((F.col("id") + 1) * j).cast("float")).alias("vec"))
    began = time.time()
    assert search.vector_search(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")).count() == 20_000
    assert time.time() - began < 120  # row by row this takes far longer


def test_rounding_is_half_up_on_decimal_digits(spark):
    import numpy as np

    from tessera.operators.blocks import rounded

    x = [0.1234565, -0.1234565, 0.0000005, 1.0000015, 2.5, -3e-7, 12.3456785, 0.9999995]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6)).collect()]
    assert list(rounded(np.array(x)) / 1e6) == want


def test_bm25_scores_in_place_as_by_joining_and_shuffles_only_the_best(spark, monkeypatch):
    from tessera.operators import search

    docs = spark.range(3000).select(F.col("id").alias("d"), F.when(F.col("id") % 50 != 7, F.concat_ws(" ", F.lit("the"), *(F.concat(F.lit("w"), (F.hash("id", F.lit(j)) % 40).cast("string")) for j in range(9)))).alias("t"))
    docs = docs.union(docs.select(F.col("d") + 5000, "t"))  # copies: ties
    queries = spark.createDataFrame([("a", "the w1 w2 w2"), ("b", "The, w-3!"), ("c", "nowhere"), ("d", None)], "q string, t string")
    ask = lambda: search.bm25(docs, queries, "d", "t", "q", "t", 7)
    got = rows(ask(), "query_id", "id", "score", "rank")
    monkeypatch.setattr(search, "SCORES", 100)
    assert rows(ask(), "query_id", "id", "score", "rank") == got and len(got) == 14
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    assert [x[:2] for x in rows(ask(), "query_id", "id")] == [x[:2] for x in got]
    assert all(abs(x[2] - y[2]) < 2e-6 and x[3] == y[3] for x, y in zip(rows(ask(), "query_id", "id", "score", "rank"), got, strict=True))
    monkeypatch.undo()
    found = []
    monkeypatch.setattr(search, "top", lambda scores, *_: found.append(scores.count()) or scores)
    ask()
    assert found[0] < 2000  # of 12,000 pairs of a query and a document that share a word


def test_hybrid_search_joins_only_its_two_short_lists(spark):
    from tessera.plans import catalogue

    plan = catalogue.QUERIES["hybrid_rrf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join FullOuter" in plan


def _walk(steps, root, depth):
    found, front = {root: 0}, {root}
    for d in range(1, depth + 1):
        front = {b for a, b in steps if a in front} - set(found)
        found |= dict.fromkeys(front, d)
    return found


def test_roots_walk_64_at_a_time_with_each_at_its_own_depth(spark, monkeypatch):
    import random

    from tessera.operators import checks, graph

    r = random.Random(5)
    steps = {(r.randrange(220), r.randrange(220)) for _ in range(500)}
    roots = list(range(0, 220, 2)) + [900]
    want = {(a, b, d) for a in roots for b, d in _walk(steps, a, 3).items()}
    links = spark.createDataFrame(sorted(steps) * 2, "use long, definition long")
    uses = spark.createDataFrame([(a,) for a in roots], "root long")
    assert rows(checks.slice_back(uses, links), "root", "node", "round") == sorted(want)
    edges = links.select(F.col("definition").alias("source"), F.col("use").alias("target"), F.lit(1).cast("long").alias("weight"))
    assert rows(graph.blast_radius(edges, uses), "root", "node", "depth") == sorted(x for x in want if x[2])
    changed = uses.select(F.col("root").alias("path"))
    got = modules.joint_blast(edges, changed, cap=9).first()
    others = {(b, d) for _, b, d in want if d and b not in roots}
    assert tuple(got) == (len({b for b, _ in others}), max(d for _, d in others), True)
    impact = {a: n for a, n in rows(modules.entity_impact(edges, changed), "root", "n_affected")}
    assert impact == {a: sum(x[0] == a and x[2] > 0 for x in want) for a in roots}


def test_roots_with_the_same_way_share_its_rows(spark):
    from tessera.operators import graph

    # 640 roots lead to the same 1,000 nodes: 640,000 pairs, but a row per pack of roots and node.
    step = spark.range(640).select(F.col("id").alias("at"), F.lit(-1).cast("long").alias("next")).union(spark.range(1000).select(F.lit(-1).cast("long"), -F.col("id") - 2))
    numbered = graph.numbered_roots(spark.range(640).select(F.col("id").alias("root")))
    packs = graph.packed_steps(numbered, step, 2)
    assert packs.where("depth = 2").count() < 100_000
    assert graph.unpacked(packs.where("depth = 2"), numbered).distinct().count() == 640_000


def test_rule_conflicts_are_counted_where_blocks_meet(spark, monkeypatch):
    import random

    from tessera.operators import textscan

    monkeypatch.setattr(textscan, "RULES", 16)
    monkeypatch.setattr(textscan, "EQUAL", 40)
    r = random.Random(3)
    texts = {i: " ".join([*(f"subject{r.randrange(60):03}" for _ in range(r.randrange(6))), "never" if i % 3 == 0 else "", "short"]) for i in range(300)}
    texts[300] = None
    df = textscan.rule_conflicts(spark.createDataFrame(list(texts.items()), "i long, t string"), "i", "t")
    of = {i: set(w for w in (t or "").split() if len(w) > 8) for i, t in texts.items()}
    want = sorted((a, b, len(of[a] & of[b])) for a in of for b in of if a % 3 and b % 3 == 0 and of[a] & of[b])
    assert rows(df, "a", "b", "shared") == want
    df.collect()
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()  # pairs are never shuffled


def test_modularity_in_flat_arrays_is_small_and_the_same(spark):
    import random
    import tracemalloc

    import numpy as np

    from tessera.operators import graph

    def by_dicts(ids, weights):
        near = {i: {} for i in ids}
        for (a, b), w in weights.items():
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        m = sum(sum(x.values()) for x in near.values()) / 2
        of = {i: k for k, i in enumerate(ids)}
        total = {k: len(near[i]) for i, k in of.items()}
        for _ in range(50):
            before = dict(of)
            for i in ids:
                total[of[i]] -= len(near[i])
                inside = {}
                for j, w in near[i].items():
                    inside[of[j]] = inside.get(of[j], 0.0) + w
                gain = {c: inside.get(c, 0.0) / m - total[c] * len(near[i]) / (2 * m * m) for c in [*inside, of[i]]}
                best = max(gain.values())
                of[i] = of[i] if gain[of[i]] == best else min(c for c in gain if gain[c] == best)
                total[of[i]] += len(near[i])
            if of == before:
                break
        number = {c: k for k, c in enumerate(sorted(set(of.values())))}
        return {i: number[c] for i, c in of.items()}

    r = random.Random(2)
    ids = [f"n{i:03}" for i in range(120)]
    pairs = sorted({(r.choice(ids), r.choice(ids[:60])) for _ in range(300)})
    weights = {p: float(r.randrange(1, 4)) for p in pairs}
    want = by_dicts(ids, weights)
    assert graph.move_by_modularity(ids, weights) == want
    nodes = spark.createDataFrame([(i, "x") for i in ids], "id string, layer string")
    edges = spark.createDataFrame([(a, b, int(w)) for (a, b), w in weights.items()], "source string, target string, weight long")
    assert dict(rows(graph.modularity_communities(nodes, edges), "id", "community")) == want
    n = 100_000
    tracemalloc.start()
    graph.moves(n, np.arange(25, n), np.arange(25, n) % 25, np.ones(n - 25), rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 * n  # dictionaries of names take over 800 bytes a node


def test_hidden_coupling_makes_only_links_of_pairs_distinct(spark):
    from tessera.operators import history

    pairs = spark.createDataFrame([(1, 2, 5), (3, 4, 5), (7, 6, 5)], "file_a long, file_b long, co_change_count long")
    links = spark.createDataFrame([(2, 1), (1, 2), (3, 9), (4, 5)], "source long, target long")
    found = history.hidden_coupling(pairs, links)
    assert rows(found, "file_a", "file_b", "has_import", "confidence") == [(1, 2, True, 0.5), (3, 4, False, 0.8), (7, 6, False, 0.8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate") :]
