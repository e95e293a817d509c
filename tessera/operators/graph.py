"""Graph analytics over ``nodes (id, layer)`` and ``edges (source, target, weight)``; an edge means source imports target."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import settle, shared_dir


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration with a checkpoint in the session's shared folder; only a local master may do without the setting."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In-, out- and total degree of every node; isolated nodes have 0."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.join(n, "id", "left").select("id", "layer", zero("out_degree").alias("out_degree"), zero("in_degree").alias("in_degree"), (zero("out_degree") + zero("in_degree")).alias("degree"))


#: Roots are followed 64 at a time, one bit each.
_BITS = 64
_BIT = f"shiftleft(1L, cast(root_no % {_BITS} as int))"


def numbered_roots(roots: DataFrame) -> DataFrame:
    """(root, root_no, pack): different roots with numbers in their order, so that roots that are near each other share a pack of 64."""
    numbered = roots.select("root").distinct().orderBy("root").withColumn("root_no", F.monotonically_increasing_id())
    return settle(numbered.withColumn("pack", F.expr(f"root_no div {_BITS}")), "roots")


def packed_steps(numbered: DataFrame, step: DataFrame, depth: int, follow: Column | None = None) -> DataFrame:
    """(pack, node, mask, depth): the roots of a pack that find a node first after ``depth`` hops of ``step`` (at, next), one bit each; depth 0 are the roots.

    A node that many roots find is one row per pack and depth, before and after the shuffle. Nodes for which ``follow`` does not hold are found but not followed.
    """
    seen = numbered.select("pack", F.col("root").alias("node"), F.expr(_BIT).alias("mask")).groupBy("pack", "node").agg(F.bit_or("mask").alias("mask")).withColumn("depth", F.lit(0))
    front = seen = settle(seen, "front")
    for d in range(1, depth + 1):
        go = front if follow is None else front.where(follow | (F.col("depth") == 0))
        new = go.join(step, F.col("node") == F.col("at")).groupBy("pack", F.col("next").alias("node")).agg(F.bit_or("mask").alias("new"))
        old = seen.groupBy("pack", "node").agg(F.bit_or("mask").alias("old"))
        mask = F.col("new").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        front = settle(new.join(old, ["pack", "node"], "left").select("pack", "node", mask.alias("mask")).where("mask <> 0").withColumn("depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen


def unpacked(packs: DataFrame, numbered: DataFrame) -> DataFrame:
    """(root, node, depth): one row per root and node of ``packed_steps``."""
    names = numbered.groupBy("pack").agg(F.collect_list(F.struct(F.expr(_BIT).alias("bit"), "root")).alias("roots"))
    each = packs.join(names, "pack").select("node", "depth", F.explode(F.expr("filter(roots, r -> (mask & r.bit) <> 0)")).alias("r"))
    return each.select("r.root", "node", "depth")


def blast_packs(edges: DataFrame, numbered: DataFrame, depth: int = 3, is_test=None) -> DataFrame:
    """``packed_steps`` against the edges: what depends on each root."""
    step = settle(edges.select(F.col("target").alias("at"), F.col("source").alias("next")).distinct(), "steps")
    return packed_steps(numbered, step, depth, None if is_test is None else ~is_test(F.col("node")))


def blast_radius(edges: DataFrame, roots: DataFrame, depth: int = 3, is_test=None) -> DataFrame:
    """(root, node, depth): what depends on each root over at most ``depth`` hops, without the root.

    All roots are followed at once; a node counts at its smallest depth. Nodes for which ``is_test`` holds are found but not followed.
    """
    numbered = numbered_roots(roots)
    return unpacked(blast_packs(edges, numbered, depth, is_test).where("depth > 0"), numbered)


def blast_summary(radius: DataFrame, cap: int = 50) -> DataFrame:
    n = F.count("*")
    return radius.groupBy("root").agg(n.alias("affected"), F.max("depth").cast("long").alias("max_depth"), (n > cap).alias("exceeded_cap"), F.when(n == 0, "safe").when(n <= 3, "low").when(n <= 10, "medium").otherwise("high").alias("risk"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) over any number of hops, without the root; stops when a round finds nothing new."""
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("next")).distinct()
    seen = roots.select("root", F.col("root").alias("node"))
    front = seen
    while True:
        new = front.join(step, F.col("node") == F.col("at")).select("root", F.col("next").alias("node")).distinct()
        front = _cut(new.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return seen.where("root <> node")
        seen = _cut(seen.unionByName(front))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank), normalised to a sum of 1. Mass of nodes without out-edges is lost in each round; every edge counts once."""
    n = nodes.count()
    links = edges.select("source", "target").join(edges.groupBy("source").agg(F.count("*").alias("out")), "source")
    # Links stay where their source's rank is, so a round deals out nothing but what nodes hand on.
    links = _cut(links.repartition("source"))
    start = _cut(nodes.select("id", F.lit(0.0).alias("got")).repartition("id"))
    rank = start.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        got = links.join(rank, links["source"] == rank["id"]).select(F.col("target").alias("id"), (F.col("rank") / F.col("out")).alias("got"))
        got = got.unionByName(start).groupBy("id").agg(F.sum("got").alias("got"))
        rank = got.select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("got")).alias("rank"))
        if i % 5 == 4:
            rank = _cut(rank)
    total = rank.agg(F.sum("rank").alias("total"))
    return rank.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))


def god_nodes(degree: DataFrame, factor: float = 2.0) -> DataFrame:
    """Nodes whose degree exceeds ``factor`` times the mean."""
    mean = degree.agg(F.avg("degree").alias("mean"))
    return degree.crossJoin(F.broadcast(mean)).where(F.col("degree") > factor * F.col("mean")).select("id", "layer", "degree")


def hubs(degree: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    n = degree.agg(F.count("*").alias("n"))
    return degree.crossJoin(F.broadcast(n)).where(F.col("in_degree") >= F.greatest(F.lit(float(least)), share * F.col("n"))).select("id", "in_degree")


def layered_pattern(degree: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: top and bottom nodes, edges from bottom to top, confidence ``max(0, 0.9 - 2 * violations / edges)``."""
    top = (F.col("in_degree") == 0) & (F.col("out_degree") > 0)
    bottom = (F.col("out_degree") == 0) & (F.col("in_degree") > 0)
    sides = degree.select("id", top.alias("top"), bottom.alias("bottom"))
    bad = edges.join(sides.where("bottom").select(F.col("id").alias("source")), "source").join(sides.where("top").select(F.col("id").alias("target")), "target").agg(F.count("*").alias("violations"))
    all_ = sides.agg(F.count_if("top").alias("top_nodes"), F.count_if("bottom").alias("bottom_nodes"), F.count("*").alias("modules"))
    one = all_.crossJoin(bad).crossJoin(edges.agg(F.count("*").alias("edges")))
    ok = (F.col("modules") >= 3) & (F.col("top_nodes") > 0) & (F.col("bottom_nodes") > 0)
    score = F.greatest(F.lit(0.0), 0.9 - 2 * F.coalesce(F.try_divide(F.col("violations"), F.col("edges")), F.lit(0.0)))
    return one.select("top_nodes", "bottom_nodes", "violations", F.when(ok, F.round(score, 6)).otherwise(0.0).alias("confidence"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): weakly connected components, named by their smallest id, by label spreading with pointer jumps."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select("id", F.col("id").alias("comp"))
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("comp").alias("m"))
        new = label.join(near, label["id"] == near["a"], "left").select("id", "comp", F.least("comp", F.coalesce("m", "comp")).alias("new"))
        jump = new.select(F.col("id").alias("new"), F.col("new").alias("far"))
        new = _cut(new.join(jump, "new", "left").select("id", F.col("comp").alias("old"), F.least("new", F.coalesce("far", "new")).alias("comp")))
        label = new.select("id", "comp")
        if new.where("old <> comp").isEmpty():
            return label


def spread_labels(ids: list[str], pairs: list[tuple[str, str]], rounds: int = 50) -> dict[str, str]:
    """Asynchronous label propagation: nodes in id order, the most frequent neighbour label, ties to the smallest."""
    near: dict[str, list[str]] = {i: [] for i in ids}
    for a, b in pairs:
        if a in near and b in near:
            near[a].append(b)
            near[b].append(a)
    label = {i: i for i in ids}
    for _ in range(rounds):
        changed = False
        for i in sorted(ids):
            if near[i]:
                seen: dict[str, int] = {}
                for j in near[i]:
                    seen[label[j]] = seen.get(label[j], 0) + 1
                best = min(seen, key=lambda x: (-seen[x], x))
                changed |= best != label[i]
                label[i] = best
        if not changed:
            break
    return label


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, community). The order of visits matters inside a component only, so components run in parallel, each in one task."""
    comp = components(nodes, edges)
    rows = comp.select("comp", "id", F.lit(None).cast("string").alias("b")).unionByName(edges.join(comp, F.col("source") == F.col("id")).select("comp", F.col("source").alias("id"), F.col("target").alias("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf["b"].isna(), "id"])
        links = pdf[pdf["b"].notna()]
        found = spread_labels(ids, sorted(zip(links["id"], links["b"], strict=True)), rounds)
        return pd.DataFrame({"id": ids, "community": [found[i] for i in ids]})

    return rows.groupBy("comp").applyInPandas(run, "id string, community string")


def move_by_modularity(ids: list[str], weights: dict[tuple[str, str], float], rounds: int = 50) -> dict[str, int]:
    """``moves`` over names; the visits go in the order of ``ids``."""
    place = {i: k for k, i in enumerate(ids)}
    known = [(place[a], place[b], w) for (a, b), w in weights.items() if a in place and b in place]
    a, b, w = (np.array([x[k] for x in known], t) for k, t in enumerate((np.int64, np.int64, np.float64)))
    return dict(zip(ids, moves(len(ids), a, b, w, rounds).tolist(), strict=True))


def moves(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 50) -> np.ndarray:
    """One level of greedy modularity moves of the nodes 0 to ``n`` in their order; degree is the number of different neighbours.

    The graph is held in flat arrays, about 100 bytes a node and a link.
    """
    loop = a == b
    ends, far = np.stack([a[~loop], b[~loop]], 1).ravel(), np.stack([b[~loop], a[~loop]], 1).ravel()
    # Both directions of a link between two nodes become one neighbour, at the place of the first.
    order = np.lexsort((far, ends))
    ends, far, weight = ends[order], far[order], np.repeat(w[~loop], 2)[order]
    first = np.flatnonzero(np.r_[True, (ends[1:] != ends[:-1]) | (far[1:] != far[:-1])]) if len(ends) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(first) else weight
    ends, far, was = ends[first], far[first], order[first]
    del order, first
    order = np.lexsort((was, ends))
    start = array("q", np.searchsorted(ends[order], np.arange(n + 1)).tobytes())
    far, weight = array("q", far[order].tobytes()), array("d", weight[order].tobytes())
    del order, ends, was
    m = sum(weight) / 2
    of, total = array("q", range(n)), array("q", (start[i + 1] - start[i] for i in range(n)))
    if not m:
        return np.array(of)
    for _ in range(rounds):
        moved = False
        for i in range(n):
            own, degree = of[i], start[i + 1] - start[i]
            total[own] -= degree
            inside: dict[int, float] = {}
            for k in range(start[i], start[i + 1]):
                c = of[far[k]]
                inside[c] = inside.get(c, 0.0) + weight[k]
            gain = lambda c: inside.get(c, 0.0) / m - total[c] * degree / (2 * m * m)  # noqa: B023, E731
            best, most = own, gain(own)
            for c in sorted(inside):
                if gain(c) > most:
                    best, most = c, gain(c)
            total[best] += degree
            moved |= best != own
            of[i] = best
        if not moved:
            break
    return np.unique(np.array(of), return_inverse=True)[1]


def modularity_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, community). The gain of a move depends on the whole graph, so one task visits all nodes; names stay outside, it holds numbers only.

    It is meant for module graphs, not for corpora.
    """
    number = settle(nodes.select("id").distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id()), "numbers")
    of = lambda side: number.select(F.col("id").alias(side), F.col("n").alias(side[0]))
    links = edges.groupBy("source", "target").agg(F.sum(F.col("weight").cast("double")).alias("w")).join(of("source"), "source").join(of("target"), "target")
    rows = number.select("n", F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("w")).unionByName(links.select(F.col("s").alias("n"), "t", "w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, links = [], []
        for b in batches:
            link = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            n, t, w = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            names.append(n[~link])
            links.append((n[link], t[link].astype(np.int64), w[link]))
        if not names:
            return
        # Numbers ascend with the names, with gaps between partitions.
        ids = np.sort(np.concatenate(names))
        a, b, w = (np.concatenate(x) for x in zip(*links, strict=True))
        links.clear()
        order = np.lexsort((b, a))
        a, b, w = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order]), w[order]
        found = moves(len(ids), a, b, w, rounds)
        for at in range(0, len(ids), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000]), pa.array(found[at : at + 10_000], pa.int64())], ["n", "community"])

    found = settle(rows.repartition(1).mapInArrow(run, "n long, community long"), "communities")
    return nodes.select("id").join(number, "id").join(found, "n").select("id", "community")


def back_edges(pairs: list[tuple[str, str]]) -> int:
    """Edges back to an open node in depth-first search from each node in order."""
    near: dict[str, list[str]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    found = 0
    for root in sorted(near):
        if root in state:
            continue
        state[root] = 1
        stack = [(root, iter(near.get(root, ())))]
        while stack:
            at, rest = stack[-1]
            for b in rest:
                if state.get(b) == 1:
                    found += 1
                elif b not in state:
                    state[b] = 1
                    stack.append((b, iter(near.get(b, ()))))
                    break
            else:
                state[at] = 2
                stack.pop()
    return found


def circular_pattern(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(comp, cycles, confidence) of components with cycles; 0.3 per back edge, at most 1."""
    comp = components(nodes, edges)
    rows = edges.join(comp, F.col("source") == F.col("id")).select("comp", "source", "target")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = back_edges(sorted(zip(pdf["source"], pdf["target"], strict=True)))
        return pd.DataFrame({"comp": [pdf["comp"].iloc[0]], "cycles": [n], "confidence": [min(1.0, 0.3 * n)]}).head(int(n > 0))

    return rows.groupBy("comp").applyInPandas(run, "comp string, cycles long, confidence double")


def dead_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Exports (module, name) that no other module imports (importer, name)."""
    used = imports.select(F.col("importer"), F.col("name").alias("used"))
    return exports.join(used, (F.col("name") == F.col("used")) & (F.col("module") != F.col("importer")), "left_anti")


#: How an edge was found, its provenance and its weight.
PROVENANCE = {"import": ("extracted", 1.0), "call_direct": ("extracted", 0.7), "call_imported": ("inferred", 0.6), "type": ("inferred", 0.5), "name": ("ambiguous", 0.4), "text": ("ambiguous", 0.3)}


def with_provenance(edges: DataFrame, rule: str = "rule") -> DataFrame:
    kind, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (k, w) in PROVENANCE.items():
        kind, weight = F.when(F.col(rule) == name, k).otherwise(kind), F.when(F.col(rule) == name, w).otherwise(weight)
    return edges.withColumn("provenance", kind).withColumn("provenance_weight", weight)
