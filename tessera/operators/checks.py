"""Checks of documents against facts, sections and runs of lines, and definitions with their uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import settle


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, text): lines counted from 1; a null text has none."""
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("p", "text")).select("id", (F.col("p") + 1).cast("long").alias("line"), "text")


def under_headers(rows: DataFrame, is_header: Column) -> DataFrame:
    """``rows`` with the last header line at or above each, null before the first."""
    upto = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header_line", F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(upto))


def sections(rows: DataFrame, is_header: Column) -> DataFrame:
    """(id, header_line, heading, body): what stands between a header and the next one, trimmed."""
    labelled = under_headers(rows, is_header).where("header_line is not null")
    listed = F.array_sort(F.collect_list(F.struct("line", "text")))
    parts = labelled.groupBy("id", "header_line").agg(listed.alias("l"))
    text = F.array_join(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x["text"]), "\n")
    return parts.select("id", "header_line", F.col("l")[0]["text"].alias("heading"), F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "").alias("body"))


def long_runs(rows: DataFrame, is_prose: Column, more_than: int = 5) -> DataFrame:
    """(id, first_line, n_lines): runs of more than so many prose lines."""
    upto = Window.partitionBy("id").orderBy("line")
    island = F.col("line") - F.row_number().over(upto)
    runs = rows.where(is_prose).withColumn("island", island).groupBy("id", "island").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"))
    return runs.where(F.col("n_lines") > more_than).select("id", "first_line", "n_lines")


def advice(rows: DataFrame, caps: tuple[int, int] = (20, 10)) -> DataFrame:
    """(id, kind, ord, text): lines that advise against something, then lines that advise something, each once whatever its case; the first of each kind."""
    low = F.lower("text")
    kind = F.when(low.rlike(r"(^|[^a-z])(never|avoid|do not|don't|nicht|jamais)([^a-z]|$)"), "anti_pattern").when(low.rlike(r"(^|[^a-z])(always|prefer|use|should|und|les)([^a-z]|$)"), "pattern")
    found = rows.withColumn("kind", kind).where("kind is not null").withColumn("key", F.lower(F.trim("text")))
    once = found.groupBy("id", "kind", "key").agg(F.min("line").alias("line"), F.min_by(F.trim("text"), "line").alias("text"))
    ranked = once.withColumn("ord", F.row_number().over(Window.partitionBy("id", "kind").orderBy("line")).cast("long"))
    return ranked.where(F.when(F.col("kind") == "pattern", F.col("ord") <= caps[0]).otherwise(F.col("ord") <= caps[1])).select("id", "kind", "ord", "text")


def first_comment(rows: DataFrame, comment: str = r"^\s*(?:#|//)\s*(\S.*)$") -> DataFrame:
    """(id, hint): the text of the first comment line."""
    hint = rows.withColumn("hint", F.regexp_extract("text", comment, 1)).where("hint <> ''")
    return hint.groupBy("id").agg(F.min_by("hint", "line").alias("hint"))


# Claims against facts. Suffixes, prefixes and parts of paths are looked up as keys, so no pairs are compared.


def normal_endpoint(path: Column) -> Column:
    """Parameters of any spelling become ``{}``; no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"\{[^}]*\}|:[a-z_]\w*|<[^>]*>", "{}"), r"(?<=.)/+$", "")


def _suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))


def unknown_endpoints(claimed: DataFrame, real: DataFrame) -> DataFrame:
    """Claimed endpoints (id, path) that are no real one, nor end with one, nor are the end of one, parameters apart."""
    c = claimed.withColumn("n", F.ltrim(normal_endpoint(F.col("path")), F.lit("/")))
    r = real.select(F.ltrim(normal_endpoint(F.col("path")), F.lit("/")).alias("n")).distinct()
    of_real = r.select(F.explode(_suffixes(F.col("n"))).alias("k")).distinct()
    whole = r.select(F.concat(F.lit("/"), "n").alias("k"))
    ends = c.select("id", "path", F.concat(F.lit("/"), "n").alias("k")).join(of_real, "k", "left_semi").select("id", "path")
    begins = c.select("id", "path", F.explode(_suffixes(F.col("n"))).alias("k")).join(whole, "k", "left_semi").select("id", "path")
    return claimed.join(ends.union(begins).distinct(), ["id", "path"], "left_anti").select("id", "path")


def unmentioned(facts: DataFrame, docs: DataFrame, text_col: str, word: str = r"[\w-]+(?:/[\w-]+)*") -> DataFrame:
    """Facts (value) that no document names, as a path or a run of a path's parts."""
    parts = F.split("w", "/")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(i, F.size(parts)), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "/"))))
    named = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(word), 0))).alias("w")).distinct()
    return facts.join(named.select(F.explode(runs).alias("value")).distinct(), "value", "left_anti")


def unknown_dependencies(claimed: DataFrame, real: DataFrame) -> DataFrame:
    """Claimed names (id, name) that equal no real one, nor begin one, nor begin with one, in any case."""
    low = F.lower("name")
    prefixes = lambda df, *keep: df.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(low, F.lit(1), i))).alias("k"))
    some = lambda df: df.where(F.length("name") > 0)
    begins = claimed.withColumn("k", low).join(prefixes(some(real)).distinct(), "k", "left_semi").select("id", "name")
    longer = prefixes(some(claimed), "id", "name").join(real.select(low.alias("k")).distinct(), "k", "left_semi").select("id", "name")
    return claimed.join(begins.union(longer).distinct(), ["id", "name"], "left_anti").select("id", "name")


def symbol_refs(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, name, path, status): names a document mentions and the first file that defines each."""
    first = definitions.groupBy("name").agg(F.min("path").alias("path"))
    out = refs.select("id", "name").distinct().join(first, "name", "left")
    return out.select("id", "name", "path", F.when(F.col("path").isNotNull(), "valid").otherwise("broken").alias("status"))


def corrections(docs: DataFrame, id_col: str, text_col: str, ports: list[int], version: str, host: str = "localhost") -> DataFrame:
    """(id, text, n_ports, n_versions, n_urls): text before the first heading goes; ports that do not exist become the smallest that does; versions become the real one; example URLs become a placeholder."""
    t = F.coalesce(text_col, F.lit(""))
    body = F.when(t.rlike(r"(?m)^#"), F.regexp_replace(t, r"^(?s:.*?)(?m:^)(?=#)", "")).otherwise(t)
    wrong = rf"{host}:(?!(?:{'|'.join(str(p) for p in sorted(ports))})\b)\d+"
    urls, versions = r"https?://(?:www\.)?example\.(?:com|org)\S*", r"\bv?\d+\.\d+\.\d+\b"
    out = docs.select(F.col(id_col).alias("id"), body.alias("b"))
    n = lambda p: F.regexp_count("b", F.lit(p)).cast("long")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("b", wrong, f"{host}:{min(ports)}"), versions, version), urls, "<url>")
    return out.select("id", text.alias("text"), n(wrong).alias("n_ports"), F.size(F.filter(F.regexp_extract_all("b", F.lit(versions), 0), lambda x: x != version)).cast("long").alias("n_versions"), n(urls).alias("n_urls"))


# Definitions and uses


def latest_before(uses: DataFrame, definitions: DataFrame, keys: list[str], at: str, inclusive: bool = False) -> DataFrame:
    """Each use (keys, at) with ``def_at``, the last definition of its keys before it (or at it); one sort per key, no pairs."""
    both = uses.select(*keys, at, F.lit(1).alias("_u"), "use_id").unionByName(definitions.select(*keys, at, F.lit(0 if inclusive else 2).alias("_u"), F.lit(None).cast(uses.schema["use_id"].dataType).alias("use_id")))
    upto = Window.partitionBy(*keys).orderBy(at, "_u").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("def_at", F.last(F.when(F.col("_u") != 1, F.col(at)), ignorenulls=True).over(upto))
    return out.where("_u = 1").select("use_id", *keys, at, "def_at")


def slice_back(uses: DataFrame, links: DataFrame, rounds: int = 3) -> DataFrame:
    """(root, node, round): statements that a statement's values come from, over at most ``rounds`` rounds of definitions."""
    from tessera.operators.graph import numbered_roots, packed_steps, unpacked

    numbered = numbered_roots(uses)
    step = settle(links.select(F.col("use").alias("at"), F.col("definition").alias("next")).distinct(), "steps")
    found = unpacked(packed_steps(numbered, step, rounds).where("depth > 0"), numbered)
    start = uses.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("round"))
    return start.unionByName(found.select("root", "node", F.col("depth").cast("long").alias("round")))


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, additions, deletions, modifications) of two versions (id, text), by different lines and how often each occurs; the smaller count are modifications."""
    count = lambda df, name: lines(df, "id", "text").groupBy("id", "text").agg(F.count("*").alias(name))
    both = count(old, "o").join(count(new, "n"), ["id", "text"], "full_outer")
    more = lambda a, b: F.sum(F.greatest(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)), F.lit(0)))
    out = both.groupBy("id").agg(more("n", "o").alias("additions"), more("o", "n").alias("deletions"))
    return out.withColumn("modifications", F.least("additions", "deletions"))


def marker_counts(found: DataFrame) -> DataFrame:
    """Decisions by marker, with how many documents hold one."""
    return found.groupBy("marker").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_docs"))


def united_changes(*changes: DataFrame) -> DataFrame:
    """Changed paths of several sources, each once."""
    out = changes[0].select("path")
    for c in changes[1:]:
        out = out.union(c.select("path"))
    return out.distinct()


def ordered_distinct(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, ord, value): values of a key in the order of their first occurrence, each once."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("_o", value)).cast("long")).drop("_o")
