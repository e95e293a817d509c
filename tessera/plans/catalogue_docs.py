"""Queries on documents, claims and flows of values, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.functions import text as ft
from tessera.operators import checks as C
from tessera.operators import code, documents, graph, modules, render, search
from tessera.sources import coverage, stores
from tessera.sources.tables import REPO_SQL, repo_map, table
from tessera.streaming import daily

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# Lines of documents; a line that starts with D, L or T stands for a header.

_L = "lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line FROM documents WHERE text IS NOT NULL)"
_H = "h AS (SELECT *, max(CASE WHEN regexp_matches(text, '^[DLT]') THEN line END) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS header_line FROM lines)"


def _lines(spark, d):
    return C.lines(table(spark, d, "documents"), "doc_id", "text")


def _header():
    return F.col("text").rlike("^[DLT]")


@query(f"WITH {_L}, {_H} SELECT id, header_line, count(*) AS n_lines FROM h GROUP BY 1, 2")
def lines_under_headers(spark, d):
    return C.under_headers(_lines(spark, d), _header()).groupBy("id", "header_line").agg(F.count("*").alias("n_lines"))


@query(f"WITH {_L}, {_H} SELECT id, header_line, min_by(text, line) AS heading, trim(coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (line > header_line), ''), ' ' || chr(10)) AS body FROM h WHERE header_line IS NOT NULL GROUP BY 1, 2")
def doc_sections(spark, d):
    return C.sections(_lines(spark, d), _header())


@query(f"WITH {_L}, r AS (SELECT id, line, line - row_number() OVER (PARTITION BY id ORDER BY line) AS i FROM lines WHERE length(text) > 30) SELECT id, min(line) AS first_line, count(*) AS n_lines FROM r GROUP BY id, i HAVING count(*) > 5")
def walls_of_text(spark, d):
    return C.long_runs(_lines(spark, d), F.length("text") > 30)


_A = "'(^|[^a-z])(never|avoid|do not|don''t|nicht|jamais)([^a-z]|$)'"
_P = "'(^|[^a-z])(always|prefer|use|should|und|les)([^a-z]|$)'"


@query(f"""WITH {_L}, k AS (SELECT *, CASE WHEN regexp_matches(lower(text), {_A}) THEN 'anti_pattern' WHEN regexp_matches(lower(text), {_P}) THEN 'pattern' END AS kind FROM lines),
o AS (SELECT id, kind, min(line) AS line, min_by(trim(text), line) AS text FROM k WHERE kind IS NOT NULL GROUP BY id, kind, lower(trim(text))), r AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY line) AS ord FROM o)
SELECT id, kind, ord, text FROM r WHERE ord <= CASE kind WHEN 'pattern' THEN 20 ELSE 10 END""")
def doc_advice(spark, d):
    return C.advice(_lines(spark, d))


@query(f"WITH {_L}, c AS (SELECT id, line, regexp_extract(text, '^\\s*(?:D|L)(\\S.*)$', 1) AS hint FROM lines) SELECT id, min_by(hint, line) AS hint FROM c WHERE hint <> '' GROUP BY 1")
def first_comments(spark, d):
    return C.first_comment(_lines(spark, d), r"^\s*(?:D|L)(\S.*)$")


# Claims: part names as endpoints, types as dependencies.

_ENDPOINTS = """claimed AS (SELECT p_partkey AS id, '/' || lower(replace(p_brand, '#', '')) || '/:id/' || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END AS path FROM part),
real AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN '/api/' || lower(replace(p_brand, '#', '')) || '/{key}/' || replace(p_name, ' ', '/') ELSE '/' || replace(p_name, ' ', '/') || '/x' || p_size END AS path FROM part WHERE p_size % 5 = 0)"""


@query(f"""WITH {_ENDPOINTS}, n AS (SELECT id, path, '/' || ltrim(regexp_replace(regexp_replace(lower(path), ':[a-z_]\\w*', '{{}}', 'g'), '/+$', ''), '/') AS k FROM claimed), r AS (SELECT '/' || ltrim(regexp_replace(lower(path), '\\{{[^}}]*\\}}', '{{}}', 'g'), '/') AS k FROM real)
SELECT id, path FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = n.k OR ends_with(r.k, n.k) OR ends_with(n.k, r.k))""")
def unknown_endpoints(spark, d):
    part, key = table(spark, d, "part"), F.col("p_partkey")
    brand, name = F.lower(F.regexp_replace("p_brand", "#", "")), F.regexp_replace("p_name", " ", "/")
    claimed = part.select(key.alias("id"), F.concat(F.lit("/"), brand, F.lit("/:id/"), name, F.when(key % 2 == 0, "/").otherwise("")).alias("path"))
    real = part.where("p_size % 5 = 0").select(F.when(key % 3 == 0, F.concat(F.lit("/api/"), brand, F.lit("/{key}/"), name)).otherwise(F.concat(F.lit("/"), name, F.lit("/x"), F.col("p_size").cast("string"))).alias("path"))
    return C.unknown_endpoints(claimed, real)


@query("""WITH v AS (SELECT DISTINCT replace(p_name, ' ', '/') AS value FROM part UNION SELECT DISTINCT lower(p_type) || '/none' FROM part UNION SELECT DISTINCT regexp_extract(p_name, '^[a-z]*') FROM part),
t AS (SELECT '/' || replace(p_name, ' ', '/') || '/' AS x FROM part WHERE p_size > 45) SELECT value FROM v WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(x, '/' || value || '/'))""")
def unmentioned_facts(spark, d):
    part, slashed = table(spark, d, "part"), F.regexp_replace("p_name", " ", "/")
    facts = part.select(slashed.alias("value")).union(part.select(F.concat(F.lower("p_type"), F.lit("/none")))).union(part.select(F.regexp_extract("p_name", "^[a-z]*", 0))).distinct()
    return C.unmentioned(facts, part.where("p_size > 45").select(F.concat(F.lit("see "), slashed, F.lit(".")).alias("text")), "text")


@query("""WITH c AS (SELECT p_partkey AS id, p_type || p_size AS name FROM part), r AS (SELECT DISTINCT lower(p_type) || (p_size * 3) AS name FROM part WHERE p_size < 12)
SELECT id, name FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE starts_with(r.name, lower(c.name)) OR starts_with(lower(c.name), r.name))""")
def unknown_dependencies(spark, d):
    part = table(spark, d, "part")
    size = F.col("p_size")
    real = part.where("p_size < 12").select(F.concat(F.lower("p_type"), (size * 3).cast("string")).alias("name")).distinct()
    return C.unknown_dependencies(part.select(F.col("p_partkey").alias("id"), F.concat("p_type", size.cast("string")).alias("name")), real)


@query(f"WITH {REPO_SQL} SELECT i.path AS id, i.name, min(e.path) AS path, CASE WHEN min(e.path) IS NULL THEN 'broken' ELSE 'valid' END AS status FROM imports i LEFT JOIN exports e ON e.name = i.name GROUP BY 1, 2")
def symbol_refs(spark, d):
    _, exports, imports = repo_map(spark, d)
    return C.symbol_refs(imports.select(F.col("path").alias("id"), "name"), exports)


@query(r"""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Sure, here it is.' || chr(10) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '# ' || p_name || chr(10) ELSE p_name || ' ' END || 'at localhost:' || (8000 + p_size % 7) || ' v1.' || (p_size % 4) || '.0 see https://example.com/' || p_partkey AS t FROM part),
b AS (SELECT id, CASE WHEN regexp_matches(t, '(?m)^#') THEN regexp_extract(t, '(?s)(?:^|\n)(#.*)$', 1) ELSE t END AS b FROM t)
SELECT id, regexp_replace(regexp_replace(regexp_replace(b, 'localhost:800[1245-9]', 'localhost:8000', 'g'), '\bv?\d+\.\d+\.\d+\b', 'v1.2.0', 'g'), 'https?://(?:www\.)?example\.(?:com|org)\S*', '<url>', 'g') AS text,
CAST(regexp_matches(b, 'localhost:800[1245-9]') AS BIGINT) AS n_ports, CAST(NOT contains(b, 'v1.2.0') AS BIGINT) AS n_versions, CAST(contains(b, 'https://') AS BIGINT) AS n_urls FROM b""")
def corrected_docs(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.concat(F.when(size % 2 == 0, "Sure, here it is.\n").otherwise(""), F.when(size % 3 == 0, F.concat(F.lit("# "), "p_name", F.lit("\n"))).otherwise(F.concat("p_name", F.lit(" "))), F.lit("at localhost:"), (size % 7 + 8000).cast("string"), F.lit(" v1."), (size % 4).cast("string"), F.lit(".0 see https://example.com/"), key.cast("string"))
    return C.corrections(table(spark, d, "part").select(key.alias("id"), text.alias("t")), "id", "t", [8003, 8000], "v1.2.0")


# Flows of values: purchases use what views have defined.

_E = "e AS (SELECT event_id, user_id, epoch_us(ts) AS sec, event_type FROM events)"


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("use_id"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("sec"), "event_type")


@query(f"WITH {_E} SELECT u.event_id AS use_id, u.user_id, u.sec, (SELECT max(sec) FROM e v WHERE v.user_id = u.user_id AND v.event_type = 'view' AND v.sec < u.sec) AS def_at FROM e u WHERE u.event_type = 'purchase'")
def latest_definitions(spark, d):
    e = _events(spark, d)
    return C.latest_before(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "sec")


@query(f"WITH {_E} SELECT u.event_id AS use_id, u.user_id, u.sec, (SELECT max(sec) FROM e v WHERE v.user_id = u.user_id AND v.event_type IN ('click', 'error') AND v.sec <= u.sec) AS def_at FROM e u WHERE u.event_type IN ('click', 'view')")
def controlling_branches(spark, d):
    e = _events(spark, d)
    return C.latest_before(e.where("event_type in ('click', 'view')"), e.where("event_type in ('click', 'error')"), ["user_id"], "sec", inclusive=True)


@query("""WITH l AS (SELECT DISTINCT l_partkey AS use, l_suppkey AS definition FROM lineitem WHERE l_partkey <> l_suppkey), r AS (SELECT p_partkey AS root FROM part WHERE p_size = 7),
s1 AS (SELECT DISTINCT root, definition AS node FROM r JOIN l ON use = root), s2 AS (SELECT DISTINCT root, definition AS node FROM s1 JOIN l ON use = node), s3 AS (SELECT DISTINCT root, definition AS node FROM s2 JOIN l ON use = node)
SELECT root, node, CAST(min(k) AS BIGINT) AS round FROM (SELECT root, root AS node, 0 AS k FROM r UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3) GROUP BY 1, 2""")
def program_slice(spark, d):
    links = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("use"), F.col("l_suppkey").alias("definition")).distinct()
    return C.slice_back(table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("root")), links)


_CUT = "replace(text, ' de ', chr(10))"


@query(f"""WITH o AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t FROM documents), n AS (SELECT doc_id AS id, unnest(string_split({_CUT}, chr(10))) AS t FROM documents), b AS (SELECT id, t, sum(x) AS o, sum(y) AS n FROM (SELECT id, t, 1 AS x, 0 AS y FROM o UNION ALL SELECT id, t, 0, 1 FROM n) GROUP BY 1, 2)
SELECT id, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS additions, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS deletions, CAST(least(sum(greatest(n - o, 0)), sum(greatest(o - n, 0))) AS BIGINT) AS modifications FROM b GROUP BY 1""")
def line_changes(spark, d):
    docs = table(spark, d, "documents")
    return C.line_changes(docs.select(F.col("doc_id").alias("id"), "text"), docs.select(F.col("doc_id").alias("id"), F.regexp_replace("text", " de ", "\n").alias("text")))


@query("SELECT event_type AS marker, count(*) AS n, count(DISTINCT user_id) AS n_docs FROM events GROUP BY 1")
def marker_counts(spark, d):
    return C.marker_counts(table(spark, d, "events").select(F.col("event_type").alias("marker"), F.col("user_id").alias("id")))


@query("SELECT DISTINCT path FROM (SELECT p_name AS path FROM part WHERE p_size < 5 UNION ALL SELECT p_type FROM part WHERE p_size > 40)")
def united_changes(spark, d):
    part = table(spark, d, "part")
    return C.united_changes(part.where("p_size < 5").select(F.col("p_name").alias("path")), part.where("p_size > 40").select(F.col("p_type").alias("path")))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY o) AS ord FROM f")
def ordered_distinct(spark, d):
    return C.ordered_distinct(table(spark, d, "events"), "user_id", "event_id", "event_type")


# Search texts


@query("SELECT 'part:' || p_partkey AS entity_id, 'symbol' AS entity_type, p_type || ' ' || p_name || ' in ' || p_brand AS text FROM part UNION ALL SELECT 'nation:' || n_nationkey, 'module', 'module ' || n_name || ' exports ' || (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation")
def entity_texts(spark, d):
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    symbols = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    found = nation.join(n, "n_nationkey", "left").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n_exports"))
    return search.entity_texts(symbols, found, "part:", "nation:")


@query("WITH t AS (SELECT p_partkey AS id, unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(p_name || 'Get' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]', ' ', 'g')), '\\s+'), lambda w : w <> '')) AS word FROM part) SELECT id, word, count(*) AS n FROM t GROUP BY 1, 2")
def camel_postings(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(ft.camel_tokens(F.concat("p_name", F.lit("Get"), "p_type"))).alias("word"))
    return part.groupBy("id", "word").agg(F.count("*").alias("n"))


# Renderings


@query(f"WITH {REPO_SQL} SELECT (SELECT count(*) FROM mods) AS nodes, (SELECT count(*) FROM links) AS edges, (SELECT count(DISTINCT layer) FROM mods) AS layers, (SELECT count(*) FROM mods WHERE path NOT IN (SELECT source FROM links) AND path NOT IN (SELECT target FROM links)) AS isolated")
def graph_summary(spark, d):
    mods, exports, imports = repo_map(spark, d)
    links = modules.resolve_names(mods, exports, imports).where("via <> 'layer'").groupBy(F.col("path").alias("source"), "target").agg(F.count("*").alias("weight"))
    return render.graph_summary(mods, links)


@query(f"WITH {REPO_SQL} SELECT layer, '## ' || layer || chr(10) || string_agg('- ' || path, chr(10) ORDER BY path) AS page FROM mods GROUP BY 1")
def wiki_pages(spark, d):
    return render.wiki_pages(repo_map(spark, d)[0], "layer", "path")


@query(f"WITH {REPO_SQL}, l AS (SELECT DISTINCT a.layer AS s, b.layer AS t FROM links JOIN mods a ON a.path = source JOIN mods b ON b.path = target WHERE a.layer <> b.layer), r AS (SELECT row_number() OVER (ORDER BY s, t) AS ord, '    ' || s || ' --> ' || t AS line FROM l) SELECT * FROM r")
def architecture_lines(spark, d):
    mods, exports, imports = repo_map(spark, d)
    links = modules.resolve_names(mods, exports, imports).where("via <> 'layer'").select(F.col("path").alias("source"), "target")
    return render.architecture(mods, links)


@query("SELECT p_type AS kind, '| ' || p_brand || ' | ' || count(*) || ' | ' || max(p_size) || ' |' AS line FROM part GROUP BY p_type, p_brand")
def report_rows(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_type").alias("kind"), "p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("m"))
    return rows.select("kind", render.table_row("p_brand", "n", "m").alias("line"))


@query("SELECT n_name AS entity, string_agg('    ' || c_mktsegment || ' ' || n, chr(10) ORDER BY c_mktsegment) AS columns FROM (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def erd_entities(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("name")).agg(F.count("*").cast("string").alias("type"))
    return render.erd_entities(rows)


# Predicates, stores

_PATHS = "p AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'a/README.md' WHEN 1 THEN 'a/b.py' WHEN 2 THEN 'x/tests/y.rs' WHEN 3 THEN 'tests/z.py' WHEN 4 THEN 'k/test_z.py' WHEN 5 THEN 'k/z.spec.ts' WHEN 6 THEN '.gitignore' WHEN 7 THEN 'img/A.PNG' ELSE 'k/z.test.tsx' END AS path FROM part)"


@query(f"WITH {_PATHS} SELECT id, path, path NOT IN ('a/README.md', '.gitignore', 'img/A.PNG') AS is_code, path IN ('x/tests/y.rs', 'k/test_z.py', 'k/z.spec.ts', 'k/z.test.tsx') AS is_test FROM p")
def path_predicates(spark, d):
    names = ("a/README.md", "a/b.py", "x/tests/y.rs", "tests/z.py", "k/test_z.py", "k/z.spec.ts", ".gitignore", "img/A.PNG", "k/z.test.tsx")
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    return rows.select("id", "path", filters.is_code_file(F.col("path")).alias("is_code"), filters.is_test_module(F.col("path")).alias("is_test"))


@query("SELECT p_partkey AS id, p_size % 4 = 0 AS is_skill FROM part")
def skill_candidates(spark, d):
    size = F.col("p_size") % 4
    text = F.when(size == 0, F.concat(F.lit("---\nkind: x\nname: "), "p_name", F.lit("\n---\nbody"))).when(size == 1, "---\nkind: x\n---\nname: y\n").when(size == 2, F.col("p_name")).otherwise(F.lit(None))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), filters.is_skill(text).alias("is_skill"))


@query("SELECT event_id AS id, event_type AS fact_type FROM events WHERE event_type IN ('click', 'view')")
def chapter_facts(spark, d):
    # Views stand for endpoints, clicks for ports; both belong to the chapter.
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.when(F.col("event_type") == "view", "endpoint").when(F.col("event_type") == "click", "port").otherwise("version").alias("fact_type"))
    return filters.facts_for("06-api-reference.md", events).select("id", F.col("event_type").alias("fact_type"))


@query("SELECT p_brand AS page, p_name AS type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord FROM part WHERE p_size % 3 > 0")
def enabled_sections(spark, d):
    return filters.enabled_sections(table(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_name").alias("type"), F.col("p_partkey").alias("position"), (F.col("p_size") % 3 > 0).alias("enabled")))


@query("SELECT p_brand AS file, p_partkey AS line, p_size > 25 AS is_stale, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25 DESC, p_partkey) AS place FROM part")
def stale_decisions(spark, d):
    return filters.stale_first(table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), (F.col("p_size") > 25).alias("is_stale")))


@query("SELECT sha256(coalesce(text, '')) AS key_hash, min(conv_id) AS first, count(*) AS uses FROM conversations GROUP BY 1")
def response_cache(spark, d):
    return stores.cache_entries(table(spark, d, "conversations"), F.col("text"), "conv_id")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 2 = 1 OR p_partkey % 5 = 0")
def changed_entries(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("hash"))
    old = part.where("id % 5 <> 0").withColumn("hash", F.when(F.col("hash") % 2 == 1, F.lit(None)).otherwise(F.col("hash")))
    return stores.changed_keys(old, part, "id", "hash")


@query("SELECT 'u' || user_id AS name, 'r/' || max_by(event_id, event_id) AS path, count(*) AS n_changes FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def repository_registry(spark, d):
    e = table(spark, d, "events")
    return stores.registry(e.select(F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.concat(F.lit("r/"), F.col("event_id").cast("string")).alias("path")))


# Changes, states, reports

_OLD_NEW = "o AS (SELECT p_name || p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE p_type END AS hash FROM part WHERE p_size % 5 > 0), n AS (SELECT p_name || p_partkey AS path, p_type AS hash FROM part WHERE p_size % 7 > 0)"


@query(f"WITH {_OLD_NEW} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS event_type FROM o FULL JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash")
def change_events(spark, d):
    part, path = table(spark, d, "part"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path")
    old = part.where("p_size % 5 > 0").select(path, F.when(F.col("p_size") % 3 == 0, "x").otherwise(F.col("p_type")).alias("hash"))
    return daily.change_events(old, part.where("p_size % 7 > 0").select(path, F.col("p_type").alias("hash")))


@query("SELECT user_id AS generation_id, max_by(event_type, event_id) AS status, max(event_id) AS updated_at FROM events GROUP BY 1")
def latest_status(spark, d):
    return daily.latest_status(table(spark, d, "events").select(F.col("user_id").alias("generation_id"), "event_type", F.col("event_id").alias("created_at")))


@query("SELECT 'q' || query AS query_id, repo, id, score FROM (SELECT l_linenumber AS query, 's' || l_suppkey AS repo, l_orderkey AS id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, repo, id) <= 10")
def search_repositories(spark, d):
    found = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("query"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("repo"), F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("score"))
    return documents.search_repositories(found.select(F.concat(F.lit("q"), F.col("query").cast("string")).alias("query_id"), "repo", "id", "score")).select("query_id", "repo", "id", "score")


@query(f"WITH {REPO_SQL}, g AS (SELECT path AS id, (SELECT count(*) FROM links WHERE source = path) + (SELECT count(*) FROM links WHERE target = path) AS degree FROM mods), t AS (SELECT id FROM g ORDER BY degree DESC, id LIMIT 20) SELECT row_number() OVER (ORDER BY source, target) AS ord, '    ' || source || ' --> ' || target AS line FROM links WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t)")
def top_diagram(spark, d):
    mods, exports, imports = repo_map(spark, d)
    links = modules.resolve_names(mods, exports, imports).where("via <> 'layer'").select(F.col("path").alias("source"), "target").distinct()
    return render.top_diagram(graph.degrees(mods.select(F.col("path").alias("id"), "layer"), links), links)


@query(f"WITH {REPO_SQL} SELECT path, '- [' || path || '](' || path || '): ' || (SELECT count(*) FROM exports e WHERE e.path = m.path) || ' exports' AS line FROM mods m")
def index_lines(spark, d):
    mods, exports, _ = repo_map(spark, d)
    return render.index_lines(mods, exports)


@query("SELECT p_brand AS path, p_name || p_partkey AS name, CAST(p_size AS BIGINT) AS complexity FROM part ORDER BY p_size DESC, p_brand, p_name || p_partkey LIMIT 10")
def complexity_hotspots(spark, d):
    return code.hotspots(table(spark, d, "part").select(F.col("p_brand").alias("path"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("complexity")))


@query("""WITH r AS (SELECT p_brand AS path, CAST(sum(p_size) AS BIGINT) AS lines_covered, CAST(count(*) * 50 AS BIGINT) AS lines_total, CAST(sum(p_size) AS DOUBLE) / (count(*) * 50) AS line_rate FROM part GROUP BY 1)
SELECT path, round(line_rate, 6) AS line_rate, CASE WHEN line_rate >= 0.8 THEN 'green' WHEN line_rate >= 0.6 THEN 'yellow' ELSE 'red' END AS badge FROM r ORDER BY r.line_rate, path LIMIT 5""")
def worst_covered(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sum("p_size").alias("lines_covered"), (F.count("*") * 50).alias("lines_total"))
    return coverage.worst_files(rows.withColumn("line_rate", F.col("lines_covered") / F.col("lines_total")), 5).select("path", F.round("line_rate", 6).alias("line_rate"), "badge")


@query("SELECT p_partkey AS id, CAST(CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS BOOLEAN) AS is_test, CASE p_partkey % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'backend' WHEN 2 THEN 'frontend' WHEN 3 THEN 'shared' WHEN 4 THEN 'main' ELSE 'infra' END AS layer FROM part")
def path_rules(spark, d):
    # A Python file in a folder of tests is no test by its name.
    names = ("a/test_x.py", "api/tests/x.py", "web/x.spec.ts", "lib/x.go", "a/x_test.go", "deploy/x.rs")
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ft.is_test_file(path).alias("is_test"), ft.layer_of(path).alias("layer"))
