"""Loaders for Parquet tables and the stand-ins that the catalogue makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, parts as files, suppliers as authors: (sha, author, path), distinct."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("path")).distinct()


def schema_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows as modules, foreign keys as imports: nodes (id, layer), edges (source, target, weight)."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    nodes = (
        region.select(key("r", "r_regionkey").alias("id"), F.lit("region").alias("layer"))
        .unionByName(nation.select(key("n", "n_nationkey").alias("id"), F.lit("nation").alias("layer")))
        .unionByName(customer.select(key("c", "c_custkey").alias("id"), F.lit("customer").alias("layer")))
        .unionByName(supplier.select(key("s", "s_suppkey").alias("id"), F.lit("supplier").alias("layer")))
    )
    edges = (
        nation.select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"))
        .unionByName(customer.select(key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target")))
        .unionByName(supplier.select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target")))
    )
    return nodes, edges.groupBy("source", "target").agg(F.count("*").alias("weight"))


GRAPH_SQL = """
nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier),
edges AS (SELECT source, target, count(*) AS weight FROM (
          SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
          UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) GROUP BY 1, 2)"""


def repo_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as modules of their brand's layer, with names they export; order lines as imports: modules (path, layer), exports (path, ord, name), imports (path, name, n)."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    key, layer = F.col("p_partkey"), F.lower(F.regexp_replace("p_brand", "#", ""))
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".ts"), F.lit(".go")), (key % 3 + 1).cast("int"))
    name = F.when(key % 10 == 0, F.concat(F.lit("test_m"), (key + 1).cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("m"), key.cast("string"), ext))
    rows = part.select(key.alias("id"), F.concat(layer, F.lit("/"), name).alias("path"), layer.alias("layer"), (F.col("p_size") % 4).alias("k"))
    each = rows.where("k > 0").select("id", "path", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("ord"))
    exports = each.select("path", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("e"), ((F.col("id") * 7 + F.col("ord") * 31) % 600).cast("string")).alias("name"))
    n = F.col("l_linenumber")
    word = F.when(n == 7, F.concat(F.lit("m"), (F.col("l_suppkey") % 50).cast("string"))).when(n == 6, F.concat(F.lit("brand"), (F.col("l_suppkey") % 40).cast("string"))).otherwise(F.concat(F.lit("e"), ((F.col("l_orderkey") * 3 + n * 17) % 900).cast("string")))
    imports = line.select(F.col("l_partkey").alias("id"), word.alias("name")).join(rows.select("id", "path"), "id").groupBy("path", "name").agg(F.count("*").alias("n"))
    return rows.select("path", "layer"), exports, imports


REPO_SQL = """
mods AS (SELECT id, layer || '/' || name AS path, layer, k FROM (SELECT p_partkey AS id, lower(replace(p_brand, '#', '')) AS layer, p_size % 4 AS k,
         CASE WHEN p_partkey % 10 = 0 THEN 'test_m' || (p_partkey + 1) || '.py' ELSE 'm' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END END AS name FROM part)),
exports AS (SELECT path, o AS ord, 'e' || ((id * 7 + o * 31) % 600) AS name FROM (SELECT id, path, unnest(range(0, k)) AS o FROM mods)),
imports AS (SELECT path, CASE WHEN l_linenumber = 7 THEN 'm' || (l_suppkey % 50) WHEN l_linenumber = 6 THEN 'brand' || (l_suppkey % 40)
            ELSE 'e' || ((l_orderkey * 3 + l_linenumber * 17) % 900) END AS name, count(*) AS n FROM lineitem JOIN mods ON l_partkey = id GROUP BY 1, 2),
stems AS (SELECT path, layer, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM mods),
found AS (SELECT i.path, i.name, (SELECT min(e.path) FROM exports e WHERE e.name = i.name AND e.path <> i.path) AS x, (SELECT min(s.path) FROM stems s WHERE s.stem = i.name AND s.path <> i.path) AS m,
          (SELECT min(layer) FROM mods WHERE layer = i.name) AS l FROM imports i),
resolved AS (SELECT path, name, coalesce(x, m, l) AS target, CASE WHEN x IS NOT NULL THEN 'export' WHEN m IS NOT NULL THEN 'module' ELSE 'layer' END AS via FROM found WHERE coalesce(x, m, l) IS NOT NULL),
links AS (SELECT path AS source, target, count(*) AS weight FROM resolved WHERE via <> 'layer' GROUP BY 1, 2)"""
