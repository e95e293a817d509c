"""Order-dependent operators: budgets, chunks, neighbours, nearest and enclosing rows, snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(items: DataFrame, group: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Items before the first one that would exceed the budget of its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return items.withColumn("used_tokens", F.sum(tokens).over(w)).where(F.col("used_tokens") <= budget)


def first_fit(items: DataFrame, group: str, order: list[str], tokens: str, item: str, budget: int) -> DataFrame:
    """(group, item, used_tokens): items that do not fit are skipped and later smaller ones still taken. Groups must fit a task."""
    listed = items.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(item).alias("_item"), F.col(tokens).cast("long").alias("_t")))).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<item: bigint, used: bigint>>)").alias("taken"))

    def step(acc, x):
        used = acc["used"] + x["_t"]
        more = F.concat(acc["taken"], F.array(F.struct(x["_item"].cast("long").alias("item"), used.alias("used"))))
        return F.when(used <= budget, F.struct(used.alias("used"), more.alias("taken"))).otherwise(acc)

    return listed.select(group, F.explode(F.aggregate("xs", zero, step)["taken"]).alias("x")).select(group, F.col("x.item").alias(item), F.col("x.used").alias("used_tokens"))


def page_links(turns: DataFrame, group: str, order: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return turns.select(group, order, F.lag(order).over(w).alias("prev_page"), F.lead(order).over(w).alias("next_page"))


def context_window(turns: DataFrame, group: str, order: str, tokens: str, n: int) -> DataFrame:
    """Per row: how many rows and tokens lie within ``n`` places on either side."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-n, n)
    return turns.select(group, order, F.count("*").over(w).alias("window_rows"), F.sum(tokens).over(w).alias("window_tokens"))


BOUNDARY = r"^(#{1,6} |def |class |function |async def |export )"


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, boundary: str = BOUNDARY, least_lines: int = 3) -> DataFrame:
    """(id, chunk, start_line, end_line, kind): a new chunk starts at a boundary line once the open one has ``least_lines``."""
    import re

    rule = re.compile(boundary)

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["t"], strict=True):
                rows, start = text.split("\n"), 0
                cuts = []
                for k, line in enumerate(rows):
                    if k - start >= least_lines and rule.match(line):
                        cuts.append((start, k))
                        start = k
                cuts.append((start, len(rows)))
                for c, (a, b) in enumerate(cuts):
                    m = rule.match(rows[a])
                    out.append((i, c, a + 1, b, m[1].strip() if m else "text"))
            yield pd.DataFrame(out, columns=["id", "chunk", "start_line", "end_line", "kind"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, chunk long, start_line long, end_line long, kind string")


def page_cuts(text: str, size: int = 6000, back: int = 800) -> list[tuple[int, int]]:
    """Page bounds: prefer a section break past half the window, else a paragraph break past 70 %; the next page steps back."""
    cuts, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            section = text.rfind("\n\n## ", start, end)
            paragraph = text.rfind("\n\n", start, end)
            if section > start + size // 2:
                end = section
            elif paragraph > start + size * 7 // 10:
                end = paragraph
        cuts.append((start, end))
        if end >= n:
            break
        start = max(end - back, start + 1)
    return cuts


def page_texts(docs: DataFrame, id_col: str, text_col: str, size: int = 6000, back: int = 800) -> DataFrame:
    """(id, page_num, total_pages, n_chars, token_count) of overlapping pages."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["t"], strict=True):
                cuts = page_cuts(text, size, back)
                for k, (a, b) in enumerate(cuts, 1):
                    body = text[a:b].strip()
                    out.append((i, k, len(cuts), len(body), max(1, len(body) // 4)))
            yield pd.DataFrame(out, columns=["id", "page_num", "total_pages", "n_chars", "token_count"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, page_num long, total_pages long, n_chars long, token_count long")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, within: int, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, distance): the nearest row of ``right`` with the same key at most ``within`` away.

    Positions are cut into cells of ``within``; a row meets three cells, so the join is
    an equi-join on (key, cell). Ties go to the smallest ``right_id``.
    """
    cell = lambda c: F.floor(F.col(c) / within)
    a = left.select(F.col(left_id).alias("left_id"), F.col(key).alias("k"), F.col(at).alias("at_l"), F.explode(F.sequence(cell(at) - 1, cell(at) + 1)).alias("cell"))
    b = right.select(F.col(right_id).alias("right_id"), F.col(key).alias("k"), F.col(at).alias("at_r"), cell(at).alias("cell"))
    d = F.abs(F.col("at_l") - F.col("at_r"))
    met = a.join(b, ["k", "cell"]).where(d <= within).groupBy("left_id").agg(F.min(F.struct(d.alias("distance"), "right_id")).alias("x"))
    return met.select("left_id", F.col("x.right_id").alias("right_id"), F.col("x.distance").alias("distance"))


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, point_id: str, span_id: str) -> DataFrame:
    """(point_id, span_id): the first span of the same key with ``start < at <= end``."""
    p = points.select(F.col(point_id).alias("point_id"), F.col(key).alias("k"), F.col(at).alias("at"))
    s = spans.select(F.col(span_id).alias("span_id"), F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    return p.join(s, "k").where("s < at and at <= e").groupBy("point_id").agg(F.min_by("span_id", F.struct("s", "span_id")).alias("span_id"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of rows added, removed or modified; values are compared by hash."""
    h = F.sha2(F.coalesce(F.col(value), F.lit("")).cast("binary"), 256)
    both = old.select(key, h.alias("a")).join(new.select(key, h.alias("b")), key, "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select(key, status.alias("status")).where("status is not null")


def entity_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, kind, name, old_name, status) of (file, name, kind, body) rows: modified by body, then renames of equal kind and body, one to one in order of names."""
    h = F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)
    a, b = (x.select("file", "kind", "name", h.alias(f"h{i}"), F.lit(True).alias(f"in{i}")) for i, x in enumerate((old, new)))
    both = a.join(b, ["file", "kind", "name"], "full_outer")
    same = both.where("in0 and in1 and h0 <> h1").select("file", "kind", "name", F.lit(None).cast("string").alias("old_name"), F.lit("modified").alias("status"))
    w = Window.partitionBy("file", "kind", "h").orderBy("name")
    gone = both.where("in1 is null").select("file", "kind", F.col("name").alias("old_name"), F.col("h0").alias("h")).withColumn("rn", F.row_number().over(Window.partitionBy("file", "kind", "h").orderBy("old_name")))
    come = both.where("in0 is null").select("file", "kind", "name", F.col("h1").alias("h")).withColumn("rn", F.row_number().over(w))
    moved = gone.join(come, ["file", "kind", "h", "rn"], "full_outer")
    status = F.when(F.col("name").isNull(), "removed").when(F.col("old_name").isNull(), "added").otherwise("renamed")
    return same.unionByName(moved.select("file", "kind", F.coalesce("name", "old_name").alias("name"), F.when(status == "renamed", F.col("old_name")).alias("old_name"), status.alias("status")))


def stale_chapters(chapter_sources: DataFrame, changed: DataFrame) -> DataFrame:
    """Chapters with a changed source."""
    return chapter_sources.join(changed, "path", "left_semi").select("chapter").distinct()
