"""Queries on repository maps, each with its SQL; parts stand for modules, order lines for imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import modules as M
from tessera.sources.tables import REPO_SQL, repo_map, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _links(spark, d):
    found = M.resolve_names(*repo_map(spark, d)).where("via <> 'layer'")
    return found.groupBy(F.col("path").alias("source"), "target").agg(F.count("*").alias("weight"))


def _is_test():
    return F.substring_index("path", "/", -1).startswith("test_")


def _tested():
    return F.regexp_replace(M.stem(F.col("path")), "^test_", "")


# The changed modules: names of one or two digits, the last of them 3 or 7.
_CHANGED = "changed AS (SELECT path FROM stems WHERE regexp_matches(stem, '^m[0-9]*[37]$') AND length(stem) <= 3)"


def _small_changed(spark, d):
    return repo_map(spark, d)[0].where(M.stem(F.col("path")).rlike("^m[0-9]*[37]$") & (F.length(M.stem(F.col("path"))) <= 3)).select("path")


# All ways from a changed module against the links, up to three steps, each node at its least depth.
_REACH = """, one AS (SELECT DISTINCT target AS was, source AS nxt FROM links),
r1 AS (SELECT c.path AS root, nxt AS node, 1 AS depth FROM changed c JOIN one ON was = c.path), r2 AS (SELECT DISTINCT root, nxt AS node, 2 AS depth FROM r1 JOIN one ON was = node),
r3 AS (SELECT DISTINCT root, nxt AS node, 3 AS depth FROM r2 JOIN one ON was = node),
reach AS (SELECT root, node, min(depth) AS depth FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) WHERE node <> root GROUP BY 1, 2)"""


@query(f"WITH {REPO_SQL} SELECT * FROM resolved")
def name_resolution(spark, d):
    return M.resolve_names(*repo_map(spark, d))


@query(f"WITH {REPO_SQL} SELECT path AS source, target, 'imports' AS kind, count(*) AS weight FROM resolved GROUP BY 1, 2 UNION ALL SELECT layer, path, 'contains', 1 FROM mods")
def name_graph(spark, d):
    return M.name_graph(*repo_map(spark, d))


@query(f"WITH {REPO_SQL} SELECT path, layer FROM mods m WHERE path IN (SELECT path FROM exports) AND NOT EXISTS (SELECT 1 FROM exports e JOIN imports i ON e.name = i.name AND e.path <> i.path WHERE e.path = m.path)")
def islands(spark, d):
    return M.islands(*repo_map(spark, d))


@query(f"""WITH {REPO_SQL} SELECT i.path, m.layer, i.name, min(x.layer) AS other FROM imports i JOIN mods m ON i.path = m.path JOIN exports e ON e.name = i.name JOIN mods x ON x.path = e.path AND x.layer <> m.layer
GROUP BY 1, 2, 3 ORDER BY i.path, i.name LIMIT 15""")
def cross_layer(spark, d):
    return M.cross_layer(*repo_map(spark, d))


@query(f"WITH {REPO_SQL} SELECT path, layer FROM stems WHERE stem NOT LIKE 'test\\_%' ESCAPE '\\' AND stem NOT IN (SELECT substr(stem, 6) FROM stems WHERE stem LIKE 'test\\_%' ESCAPE '\\')")
def name_tested(spark, d):
    return M.name_tested(repo_map(spark, d)[0], _is_test(), _tested())


@query(f"WITH {REPO_SQL} SELECT path, count(*) AS n_exports FROM exports GROUP BY 1 ORDER BY n_exports DESC, path LIMIT 15")
def heavy_modules(spark, d):
    return M.heavy_modules(repo_map(spark, d)[1])


@query("SELECT lower(replace(p_name, ' ', '/')) || p_partkey AS path, p_type AS layer FROM part WHERE regexp_matches(lower(p_name), 'ring|gear')")
def sensitive_paths(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lower(F.regexp_replace("p_name", " ", "/")), F.col("p_partkey").cast("string")).alias("path"), F.col("p_type").alias("layer"))
    return M.sensitive_paths(part, ("ring", "gear"))


@query(f"""WITH {REPO_SQL}, f AS (SELECT path, layer FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY path) AS r FROM mods) WHERE r <= 5)
SELECT f.path, f.layer, coalesce((SELECT string_agg(name, ',' ORDER BY ord) FROM (SELECT * FROM exports e WHERE e.path = f.path ORDER BY ord LIMIT 2)), '') AS exports,
coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM imports i WHERE i.path = f.path ORDER BY name LIMIT 2)), '') AS imports FROM f""")
def layer_scan(spark, d):
    return M.layer_scan(*repo_map(spark, d), per_layer=5, names=2)


@query(f"WITH {REPO_SQL} SELECT c AS layer, min_by(dir, j) AS dir FROM (VALUES ('web', 0, 'brand99'), ('web', 1, 'brand7'), ('web', 2, 'brand3'), ('api', 0, 'brand5'), ('ops', 0, 'brand0')) v(c, j, dir) WHERE dir IN (SELECT layer FROM mods) GROUP BY 1")
def first_layers(spark, d):
    dirs = repo_map(spark, d)[0].select(F.col("layer").alias("dir"))
    return M.first_layers(dirs, [("web", ("brand99", "brand7", "brand3")), ("api", ("brand5",)), ("ops", ("brand0",))])


@query("""WITH f AS (SELECT regexp_extract(p_name, '[^ ]*$') AS name, p_type AS content FROM part), r AS (SELECT * FROM (VALUES (0, 'fasteners', 'bolt', NULL), (1, 'small rings', 'ring', 'SMALL'), (2, 'none', 'nothing', NULL), (3, 'fasteners', 'gear', NULL), (4, 'widgets', 'widget', 'ECO')) v(ord, tech, marker, word))
SELECT tech, CAST(min(ord) AS BIGINT) AS ord FROM f JOIN r ON name = marker AND (word IS NULL OR contains(content, word)) GROUP BY 1""")
def tech_stack(spark, d):
    files = table(spark, d, "part").select(F.regexp_replace("p_name", " ", "/").alias("path"), F.col("p_type").alias("content"))
    return M.tech_stack(files, [("fasteners", "bolt", None), ("small rings", "ring", "SMALL"), ("none", "nothing", None), ("fasteners", "gear", None), ("widgets", "widget", "ECO")])


@query(f"""WITH {REPO_SQL}, p AS (SELECT path FROM mods UNION ALL SELECT DISTINCT layer FROM mods), c AS (SELECT path FROM mods WHERE length(path) % 5 = 0 AND layer <> 'brand7' UNION ALL SELECT 'brand3')
SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = p.path OR starts_with(c.path, p.path || '/') OR starts_with(p.path, c.path || '/'))""")
def uncovered_packages(spark, d):
    mods = repo_map(spark, d)[0]
    packages = mods.select("path").union(mods.select("layer").distinct())
    covered = mods.where((F.length("path") % 5 == 0) & (F.col("layer") != "brand7")).select("path").union(spark.createDataFrame([("brand3",)], "path string"))
    return M.uncovered(packages, covered)


@query(f"WITH {REPO_SQL} SELECT path FROM mods WHERE regexp_extract(path, '[^/]*$') IN ('m1.ts', 'm3.py', 'm5.go')")
def entry_points(spark, d):
    return M.entry_points(repo_map(spark, d)[0], ("m1.ts", "m3.py", "m5.go"))


@query(f"""WITH {REPO_SQL}, p AS (SELECT CASE WHEN length(path) % 3 = 0 THEN path WHEN length(path) % 3 = 1 THEN 'src/' || path ELSE stem || '.x' END AS path FROM stems),
s AS (SELECT path, string_split(path, '/') AS a FROM p), every AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS dir FROM (SELECT a, unnest(range(1, len(a))) AS i FROM s)),
every_root AS (SELECT dir FROM every UNION SELECT '(root)')
SELECT r.dir, CAST((SELECT count(*) FROM s WHERE CASE WHEN len(a) = 1 THEN '(root)' ELSE array_to_string(a[1:len(a) - 1], '/') END = r.dir) AS BIGINT) AS files,
CAST((SELECT count(*) FROM every e WHERE CASE WHEN contains(e.dir, '/') THEN regexp_replace(e.dir, '/[^/]*$', '') ELSE '(root)' END = r.dir) AS BIGINT) AS children FROM every_root r""")
def directory_counts(spark, d):
    p, n = F.col("path"), F.length("path") % 3
    paths = repo_map(spark, d)[0].select(F.when(n == 0, p).when(n == 1, F.concat(F.lit("src/"), p)).otherwise(F.concat(M.stem(p), F.lit(".x"))).alias("path"))
    return M.directory_counts(paths)


@query(f"""WITH {REPO_SQL}, t AS (SELECT DISTINCT name FROM exports ORDER BY name LIMIT 20)
SELECT e.name AS type, count(DISTINCT i.path) AS n_users FROM exports e JOIN t ON e.name = t.name JOIN imports i ON i.name = e.name AND i.path <> e.path GROUP BY 1 HAVING count(DISTINCT i.path) >= 2 ORDER BY n_users DESC, type LIMIT 8""")
def hub_types(spark, d):
    _, exports, imports = repo_map(spark, d)
    return M.hub_types(exports.select(F.col("name").alias("type"), F.col("path").alias("owner")), imports.select(F.col("name").alias("type"), F.col("path").alias("user")))


@query(f"WITH {REPO_SQL} SELECT (SELECT count(*) FROM mods) AS n_modules, (SELECT count(*) FROM exports) AS n_exports, (SELECT count(*) FROM imports) AS n_imports")
def repo_totals(spark, d):
    return M.totals(*repo_map(spark, d))


@query(f"""WITH {REPO_SQL}, {_CHANGED}{_REACH}, a AS (SELECT path AS root, CAST(coalesce((SELECT sum(weight) FROM links WHERE target = path), 0) AS BIGINT) AS n_direct,
(SELECT count(DISTINCT node) FROM reach WHERE root = path) AS n_affected FROM changed)
SELECT *, CASE WHEN n_affected = 0 THEN 'none' WHEN n_affected <= 2 THEN 'low' WHEN n_affected <= 5 THEN 'medium' ELSE 'high' END AS risk FROM a""")
def entity_impact(spark, d):
    return M.entity_impact(_links(spark, d), _small_changed(spark, d))


@query(f"WITH {REPO_SQL}, {_CHANGED}{_REACH} SELECT count(DISTINCT node) AS n_affected, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth, count(DISTINCT node) > 50 AS exceeded FROM reach WHERE node NOT IN (SELECT path FROM changed)")
def joint_blast(spark, d):
    return M.joint_blast(_links(spark, d), _small_changed(spark, d))


@query(f"""WITH {REPO_SQL}, {_CHANGED}{_REACH}, t AS (SELECT path, stem, path IN (SELECT node FROM reach) AS by_graph, substr(stem, 6) IN (SELECT stem FROM stems WHERE path IN (SELECT path FROM changed)) AS by_name
FROM stems WHERE starts_with(stem, 'test_')) SELECT path, by_graph, by_name FROM t WHERE by_graph OR by_name""")
def impact_tests(spark, d):
    return M.impact_tests(_links(spark, d), _small_changed(spark, d), repo_map(spark, d)[0], _is_test(), _tested())


@query(f"""WITH {REPO_SQL}, {_CHANGED} SELECT DISTINCT i.path FROM imports i JOIN links l ON l.source = i.path WHERE l.target IN (SELECT path FROM changed) AND i.name IN (SELECT name FROM exports WHERE path IN (SELECT path FROM changed))""")
def naming_users(spark, d):
    _, exports, imports = repo_map(spark, d)
    changed = _small_changed(spark, d)
    return M.naming_users(imports, exports.join(changed, "path", "left_semi").select("name").distinct(), _links(spark, d), changed)


@query(f"WITH {REPO_SQL} SELECT DISTINCT s.stem AS name, l.source AS caller FROM links l JOIN stems s ON s.path = l.target WHERE s.stem IN ('m1', 'm2', 'm3', 'm11')")
def callers(spark, d):
    return M.callers(_links(spark, d), spark.createDataFrame([(x,) for x in ("m1", "m2", "m3", "m11")], "name string"))


@query(f"""WITH {REPO_SQL} SELECT r.path AS caller_path, r.target AS callee_path, r.name AS callee, CASE WHEN EXISTS (SELECT 1 FROM exports e WHERE e.path = r.target AND e.name = r.name) THEN 'linked' ELSE 'heuristic' END AS confidence FROM resolved r""")
def upgraded_calls(spark, d):
    calls = M.resolve_names(*repo_map(spark, d)).select(F.col("path").alias("caller_path"), F.col("target").alias("callee_path"), F.col("name").alias("callee"), F.lit("heuristic").alias("confidence"))
    return M.upgrade_confidence(calls, repo_map(spark, d)[1])


@query(f"WITH {REPO_SQL}, e AS (SELECT path AS source, target, via AS provenance, CAST(CASE via WHEN 'export' THEN 1.0 WHEN 'module' THEN 0.6 ELSE 0.3 END AS DOUBLE) AS weight FROM resolved) SELECT * FROM e WHERE weight >= 0.5 AND provenance IN ('module', 'layer')")
def provenance_query(spark, d):
    via = F.col("via")
    edges = M.resolve_names(*repo_map(spark, d)).select(F.col("path").alias("source"), "target", via.alias("provenance"), F.when(via == "export", 1.0).when(via == "module", 0.6).otherwise(0.3).alias("weight"))
    return M.provenance_query(edges, kinds=("module", "layer"), least=0.5)


def _audit(spark, d):
    part = table(spark, d, "part")
    subject = F.col("p_partkey").cast("string").alias("subject")
    mods, exports, imports = repo_map(spark, d)
    return M.audit(
        part.select(subject, F.col("p_size").alias("value")), M.islands(mods, exports, imports).select(F.col("path").alias("subject")),
        part.where("p_size % 13 = 0").select(subject), part.where("p_size % 11 = 0").select(subject, (F.col("p_partkey") % 2 == 0).alias("is_license")),
    )


_AUDIT = f"""WITH {REPO_SQL}, a AS (SELECT 'complexity' AS kind, CASE WHEN p_size >= 15 THEN 'high' ELSE 'medium' END AS severity, CAST(p_partkey AS VARCHAR) AS subject FROM part WHERE p_size >= 10
UNION ALL SELECT 'dead_code', 'medium', path FROM mods m WHERE path IN (SELECT path FROM exports) AND NOT EXISTS (SELECT 1 FROM exports e JOIN imports i ON e.name = i.name AND e.path <> i.path WHERE e.path = m.path)
UNION ALL SELECT 'drift', 'medium', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 13 = 0 UNION ALL SELECT 'dependency', CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'medium' END, CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 11 = 0) """


@query(_AUDIT + "SELECT * FROM a")
def audit_findings(spark, d):
    return _audit(spark, d)


@query(_AUDIT + "SELECT kind, count(*) AS n, count(*) FILTER (severity = 'high') AS high, count(*) AS failing FROM a GROUP BY 1")
def audit_summary(spark, d):
    return M.audit_counts(_audit(spark, d), "medium")


@query("SELECT p_brand AS dimension, count(*) FILTER (p_size >= 20) AS passed, count(*) AS total, round(CAST(count(*) FILTER (p_size >= 20) AS DOUBLE) / count(*), 4) AS score FROM part GROUP BY 1")
def dimension_scores(spark, d):
    return M.dimension_scores(table(spark, d, "part").select(F.col("p_brand").alias("dimension"), (F.col("p_size") >= 20).alias("ok")))
