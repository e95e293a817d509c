"""Graphs and tables as text: one row per document, built by ordered aggregation. For module graphs and reports, not for corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(rows: DataFrame, line: Column, order: list[str], first: str, last: str = "") -> DataFrame:
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    out = F.concat_ws("\n", F.lit(first), F.nullif(body, F.lit("")))
    return rows.agg((F.concat(out, F.lit(f"\n{last}")) if last else out).alias("text"))


def mermaid(edges: DataFrame, direction: str = "LR") -> DataFrame:
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    line = F.concat(F.lit("    "), clean("source"), F.lit(" --> "), clean("target"))
    return _joined(edges, line, ["source", "target"], f"graph {direction}")


def dot(edges: DataFrame) -> DataFrame:
    line = F.concat(F.lit('  "'), F.col("source"), F.lit('" -> "'), F.col("target"), F.lit('";'))
    return _joined(edges, line, ["source", "target"], "digraph G {", "}")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the graph as JSON with sorted nodes and edges."""
    pack = lambda df, cols: df.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("x"))
    both = pack(nodes, ["id", "layer"]).withColumnRenamed("x", "nodes").crossJoin(pack(edges, ["source", "target", "weight"]).withColumnRenamed("x", "edges"))
    return both.select(F.to_json(F.struct("nodes", "edges")).alias("text"))


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    cols = rows.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), F.lit(" |"))
    head = "| " + " | ".join(cols) + " |\n|" + " --- |" * len(cols)
    return _joined(rows, line, order, head)


def svg_layout(nodes: DataFrame, degree: DataFrame, width: int = 220, height: int = 60) -> DataFrame:
    """(id, x, y): a column per layer, in each the nodes by degree."""
    from pyspark.sql import Window

    rows = nodes.join(degree.select("id", "degree"), "id")
    col = F.dense_rank().over(Window.orderBy("layer")) - 1
    row = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("degree"), "id")) - 1
    return rows.select("id", (col * width).cast("long").alias("x"), (row * height).cast("long").alias("y"))


#: What an export takes first.
PRIORITY = (("README", 0), ("docs/", 1), ("src/", 2), ("lib/", 2), ("tests/", 4))


def export_view(files: DataFrame, budget: int) -> DataFrame:
    """(path, priority, tokens, kept): by priority and path until the first file that exceeds the budget."""
    from pyspark.sql import Window

    p = F.lit(3)
    for start, rank in reversed(PRIORITY):
        p = F.when(F.col("path").startswith(start), rank).otherwise(p)
    rows = files.select("path", p.cast("long").alias("priority"), F.floor(F.length("content") / 4).cast("long").alias("tokens"))
    return rows.withColumn("kept", F.sum("tokens").over(Window.orderBy("priority", "path")) <= budget)


def graph_summary(modules: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges, layers and nodes without an edge."""
    ends = links.select(F.col("source").alias("path")).union(links.select("target")).distinct()
    alone = modules.join(ends, "path", "left_anti").agg(F.count("*").alias("isolated"))
    n = modules.agg(F.count("*").alias("nodes"), F.countDistinct("layer").alias("layers"))
    return n.join(links.agg(F.count("*").alias("edges"))).join(alone)


def wiki_pages(rows: DataFrame, topic: str, item: str) -> DataFrame:
    """(topic, page): a heading and its items, one row per topic."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(F.lit("- "), x)), "\n")
    return rows.groupBy(topic).agg(F.concat(F.lit("## "), F.first(topic), F.lit("\n"), listed).alias("page"))


def architecture(modules: DataFrame, links: DataFrame) -> DataFrame:
    """(ord, line): one diagram line per pair of layers with a link; as many rows as pairs of layers."""
    layer = lambda side: modules.select(F.col("path").alias(side), F.col("layer").alias(side[0]))
    pairs = links.select("source", "target").join(layer("source"), "source").join(layer("target"), "target").where("s <> t").select("s", "t").distinct()
    return pairs.select(F.row_number().over(Window.orderBy("s", "t")).cast("long").alias("ord"), F.concat(F.lit("    "), "s", F.lit(" --> "), "t").alias("line"))


def table_row(*columns: str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |"))


def erd_entities(columns: DataFrame) -> DataFrame:
    """(entity, columns): the column lines of each entity (entity, name, type)."""
    line = F.concat(F.lit("    "), "name", F.lit(" "), "type")
    return columns.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("columns"))


def top_diagram(degree: DataFrame, links: DataFrame, k: int = 20) -> DataFrame:
    """(ord, line): the links among the ``k`` nodes of highest degree (id, degree), as diagram lines."""
    top = F.broadcast(degree.orderBy(F.desc("degree"), "id").limit(k).select("id"))
    kept = links.join(top, links["source"] == top["id"], "left_semi").join(top, links["target"] == top["id"], "left_semi").select("source", "target").distinct()
    # At most k * k rows.
    return kept.select(F.row_number().over(Window.orderBy("source", "target")).cast("long").alias("ord"), F.concat(F.lit("    "), "source", F.lit(" --> "), "target").alias("line"))


def index_lines(modules: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, line): an index entry per module, with how much it exports."""
    n = exports.groupBy("path").agg(F.count("*").alias("n"))
    out = modules.join(n, "path", "left")
    return out.select("path", F.concat(F.lit("- ["), "path", F.lit("]("), "path", F.lit("): "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" exports")).alias("line"))
