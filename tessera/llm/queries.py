"""The queries over the whole tables, one per operator, with their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import decontaminate, exact_dedup, html_extract, language_id, licenses, mixing, near_dedup, quality_lm, substring_dedup, warc
from tessera.llm.common import table


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.page_records(spark, table(spark, sf_dir, "pages"))


def op3_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "part")


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op8_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_lm(spark, sf_dir):
    return quality_lm.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_quality_lm": op10_quality_lm,
}
ORACLE_SQL = {
    "op2_warc": warc.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_license_scan": licenses.oracle_sql(),
    "op9_decontamination": decontaminate.ORACLE_SQL,
}
