"""Mixing sources to target weights by capped water-filling.

Sizes are words. All sources share ``budget`` times the total size in proportion to
their weights; a source whose share exceeds ``max_epochs`` times its size is clamped
there and the excess goes to the others by weight, until none is above. That fixed
point is a water level: in order of cap by weight, the clamped sources are a prefix,
found with running sums over one row per source.

A source with target e epochs takes every document floor(e) times whole and a seeded
sample for the fraction: documents are ordered by a seeded hash of ``doc_id`` and text,
taken while the words suffice, and the document at the edge gives only the words still
lacking. The order is never sorted per source as a whole: hash cells are summed first,
in two levels, and only the one cell at each source's edge is sorted, a millionth of
the source. Rows equal in all columns are counted there and sorted as one.

A null text has size 0, is taken 0 words; a null source is a source of its own, last
in order. Rows of one ``doc_id`` are documents of their own. Rows that tie in the order are
taken in the order of a hash of the columns in ``payload``. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_WORD, settle, with_running_sums

#: The weights of sources, in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
#: Hash cells per level; two levels leave a millionth of a source to sort.
CELLS = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes``: (source, source_size), a row per source. Adds ``target``."""
    source = F.col("source")
    ranked = with_running_sums(sizes, [source.isNull(), source], {"k": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rows = ranked.select("source", "source_size", "k", weight.alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    rows = settle(with_running_sums(rows, [F.col("cap") / F.col("w"), F.col("k")], {"clamped": F.col("cap"), "closed_w": F.col("w"), "place": F.lit(1)}), "levels")
    whole = rows.agg((F.sum("source_size") * budget).alias("total"), F.sum("w").alias("all_w"))
    # The level if this source and all after it are open; the first source not above its cap tells the level of all after it.
    level = (F.col("total") - F.col("clamped")) / (F.col("all_w") - F.col("closed_w"))
    leveled = rows.join(F.broadcast(whole)).withColumn("level", level)
    water = leveled.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min("place").alias("first"), F.min_by("level", "place").alias("water"))
    target = F.when(F.col("place") >= F.col("first"), F.least(F.col("water") * F.col("w"), F.col("cap"))).otherwise(F.col("cap"))
    # Both are one row.
    return rows.join(F.broadcast(water)).select("source", "source_size", target.alias("target"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, payload: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(SPACE_WORD)).cast("long")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text))), 1, 15), 16, 10).cast("long")
    bits = CELLS.bit_length() - 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h"), *(F.col(c).alias(f"p_{i}") for i, c in enumerate(payload)))
    return rows.select("*", *(F.shiftright("h", 60 - bits * k).alias(f"c{k}") for k in (1, 2)))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = 17, payload: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, whole, part, taken`` and the columns named in ``payload`` as ``p_0`` on.

    ``whole`` repetitions and then ``part`` words once more make ``taken`` words.
    """
    held = [f"p_{i}" for i in range(len(payload))]
    sizes = settle(_measured(docs, id_col, text_col, source_col, seed, ()), "sizes")
    per_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)
    epochs = F.col("target") / F.col("source_size")
    plan = settle(
        per_source.withColumn("whole", F.coalesce(F.floor(epochs), F.lit(0)).cast("long"))
        .withColumn("lack", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")),
        "targets",
    )

    # The first cell of each level in which the words run out, and the words left for it.
    edges = plan.select(F.col("source").alias("s"), "lack")
    found = []
    for level in (1, 2):
        name = f"c{level}"
        some = sizes if level == 1 else sizes.join(edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("c1") == F.col("e1")), "left_semi")
        cells = some.groupBy("source", name).agg(F.sum("size").alias("words"))
        # At most CELLS rows per source.
        run = Window.partitionBy("source").orderBy(name)
        run = cells.withColumn("before", F.sum("words").over(run) - F.col("words"))
        over = run.join(edges, F.col("source").eqNullSafe(F.col("s"))).where("before <= lack and before + words > lack")
        found.append(over.groupBy("source").agg(F.min_by(F.struct(F.col(name).alias("cell"), (F.col("lack") - F.col("before")).alias("left")), name).alias("x")).select(F.col("source").alias("s"), F.col("x.cell").alias(f"e{level}"), F.col("x.left").alias("lack")))
        found[-1] = settle(found[-1], f"edge{level}")
        edges = found[-1]
    edge1, edge2 = (x.withColumnRenamed("s", f"s{i}").withColumnRenamed("lack", f"left{i}") for i, x in enumerate(found, 1))
    known = plan.join(edge1, F.col("source").eqNullSafe(F.col("s1")), "left").join(edge2, F.col("source").eqNullSafe(F.col("s2")), "left")
    known = settle(known.select(F.col("source").alias("s0"), "source_size", "target", "whole", "lack", "e1", "e2", "left2"), "plan")
    rows = _measured(docs, id_col, text_col, source_col, seed, payload)
    at = rows.join(known, F.col("source").eqNullSafe(F.col("s0")))
    at_edge = F.coalesce((F.col("c1") == F.col("e1")) & (F.col("c2") == F.col("e2")), F.lit(False))
    below = F.col("e1").isNull() | (F.col("c1") < F.col("e1")) | (F.col("c1") == F.col("e1")) & (F.col("c2") < F.coalesce(F.col("e2"), F.lit(1 << 62)))
    cols = lambda part: ["doc_id", "source", "size", "source_size", "target", "whole", part.cast("long").alias("part"), (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), *held]
    rest = at.where(~at_edge).select(*cols(F.when((F.col("lack") > 0) & below, F.col("size")).otherwise(F.lit(0))))

    own = ["doc_id", "source", "size", "source_size", "target", "whole", "h", "left2", *held]
    groups = at.where(at_edge).groupBy(*own).agg(F.count("*").alias("times"))
    run = Window.partitionBy("source").orderBy("h", "doc_id", F.xxhash64(*held) if held else F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("left2") - F.coalesce(F.sum(F.col("size") * F.col("times")).over(run), F.lit(0))
    edge = groups.withColumn("left", left).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("nth") * F.col("size")))
    return rest.unionByName(edge.select(*cols(part)))


ORACLE_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s GROUP BY source),
w AS (SELECT *, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM p),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS o,
             (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(o) AS o, min_by(level, o) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN l.o >= f.o THEN least(f.level * w, cap) ELSE cap END AS target FROM l CROSS JOIN f),
x AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
y AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS lack FROM x),
z AS (SELECT doc_id, s.source, size, source_size, target, whole,
             greatest(0, least(size, lack - (sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size))) AS part
      FROM s JOIN y ON s.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken, source, whole, CAST(part AS BIGINT) AS part FROM z
"""
