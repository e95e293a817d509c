"""The pipeline's stages one after the other."""

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.common import settle

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(900_001, None, None, None, None), (900_002, "12 34", "en", "src0", 5)], docs.schema))
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = settle(stage(spark, docs, SF), name)
        assert docs.columns == columns if k < len(corpus_pipeline.STAGES) - 1 else set(columns) < set(docs.columns)
        m = docs.count()
        assert 0 < m <= n, name
        n = m
        if name == "language_id":
            assert docs.where("doc_id > 900000").count() == 0
        if name == "exact_dedup":
            assert docs.select("doc_id").distinct().count() == m == docs.select("text").distinct().count()
    assert docs.where("taken <= 0 or taken > 2 * size").count() == 0


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_are_known_by_id_and_text(spark):
    a, b, c = ("one two three four five six", "some other text that is quite long", "x")
    data = [(5, a), (5, b), (9, b), (9, c), (9, c), (None, c), (None, None), (7, "X"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 2}", n) for n, (i, t) in enumerate(data)], DOC)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert rows_of(exact.select("doc_id", "text")) == sorted([(5, a), (9, b), (9, c), (7, None)], key=repr)
    # Of the two rows (9, "x") the one that is smaller in its other columns stays.
    assert exact.where("doc_id = 9 and text = 'x'").first()["n_chars"] == 4
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    # Texts without words are alike to nothing; "x" and "X" are one class, whose smallest id stays.
    assert rows_of(near.select("doc_id", "text")) == sorted([(5, a), (5, b), (7, "X"), (7, None), (None, None)], key=repr)


def test_mix_takes_each_row_by_its_own_size_and_again_the_same(spark):
    data = [(5, "a b c d e f"), (5, "a")] * 3 + [(6, "a b c"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(data)], DOC)
    first = corpus_pipeline.mix(spark, docs, SF)
    assert all(r.size == len(r.text.split()) and 0 < r.taken <= 2 * r.size for r in first.collect())
    assert abs(sum(r.taken for r in first.collect()) - 36) <= 1
    assert rows_of(first) == rows_of(corpus_pipeline.mix(spark, docs.repartition(5), SF))


def test_clashing_names_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = ("i", "k", "p_0", "p_4", "_key", "kept", "row", "th", "size", "target", "h", "letter", "spans", "times")
    odd = docs.select("*", *(F.lit(7).alias(c) for c in clash))
    for d in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            d = settle(stage(spark, d, SF), "stage")
            want = odd.columns if k < 4 else [c for c in odd.columns if c not in ("size", "target")] + ["size", "source_size", "target", "taken"]
            assert d.columns == want
            assert d.where("p_0 <> 7 or times <> 7").isEmpty()
