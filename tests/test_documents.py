"""Documentation operators against small cases."""

from pyspark.sql import functions as F

from tessera.operators import documents


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_references(spark):
    docs = spark.createDataFrame([(1, "see ./src/a.py and b.ts, not gone.go\n```\nx.py\n```"), (2, None)], "i long, t string")
    files = spark.createDataFrame([("src/a.py",), ("deep/er/b.ts",), ("lib/b.ts",)], "path string")
    checked = documents.check_refs(documents.file_refs(docs, "i", "t"), files)
    assert rows(checked.fillna("-"), "ref", "status", "target") == [("./src/a.py", "valid", "src/a.py"), ("b.ts", "suffix", "lib/b.ts"), ("gone.go", "missing", "-")]
    assert rows(documents.ref_counts(checked), "id", "refs", "missing") == [(1, 3, 1)]


def test_topics_and_compression(spark):
    docs = spark.createDataFrame([(1, "# A\n## B\n**c** and **A**"), (2, None)], "i long, t string")
    assert rows(documents.page_topics(docs, "i", "t"), "id", "topics") == [(1, ["A", "B", "c"]), (2, [])]
    text = "In order to  go,\n\n\n\nrun:\n```\nin order to  stay\n```\n---\nend"
    got = spark.createDataFrame([(text,)], "t string").select(documents.compress(F.col("t"))).first()[0]
    assert got == "to go,\n\nrun:\n```\nin order to  stay\n```\n\nend"
    assert rows(documents.compression(docs, "i", "t"), "id", "original_tokens", "ratio") == [(1, 6, 1.0), (2, 0, 1.0)]


def test_types(spark):
    types = spark.createDataFrame([("A", "class A extends B<T> implements C, x.D {"), ("B", "class B {"), ("P", "class P(Q, object)")], "name string, signature string")
    assert rows(documents.type_hierarchy(types), "type", "parent", "known") == [("A", "B", True), ("A", "C", False), ("A", "D", False), ("P", "Q", False)]


def test_manifest_and_progress(spark):
    chapters = spark.createDataFrame([("one", "a"), ("one", "b"), ("two", "b"), ("three", "c")], "chapter string, path string")
    old = documents.content_hashes(chapters.where("chapter <> 'three'"), spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string"))
    new = documents.content_hashes(chapters, spark.createDataFrame([("a", "9"), ("b", "2"), ("c", None)], "path string, content string"))
    assert rows(documents.drift(old, new), "chapter", "stale") == [("one", True), ("three", True), ("two", False)]
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (2, 1, 0.1), (2, 2, 0.2), (2, 3, 0.3), (2, 4, 0.9)], "id long, iteration long, overall double")
    assert rows(documents.first_passing(scores), "id", "iterations") == [(1, 2), (2, 3)]
    found = spark.createDataFrame([(1, "r", 5, 0.5), (1, "q", 9, 0.5), (1, "z", 1, 0.1)], "query_id long, repo string, id long, score double")
    assert rows(documents.search_repositories(found, 2), "repo", "rank") == [("q", 1), ("r", 2)]


def test_stores_replace_partitions(spark, tmp_path):
    from tessera.functions import filters
    from tessera.sources import stores

    path = f"file://{tmp_path}/pages"
    stores.save(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "repo string, page long"), path, ["repo"])
    stores.save(spark.createDataFrame([("a", 9)], "repo string, page long"), path, ["repo"])
    assert sorted(tuple(r) for r in stores.load(spark, path).select("repo", "page").collect()) == [("a", 9), ("b", 3)]
    facts = spark.createDataFrame([("port",), ("db_table",)], "fact_type string")
    assert [filters.facts_for(c, facts).count() for c in ("index.md", "01-overview.md", "05-data-models.md", "own.md")] == [0, 1, 1, 2]
