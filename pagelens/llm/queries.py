"""Registered queries: each applies one operator with its production settings to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import (
    chat, clusters, decontaminate, host_quality, html_text, language, licenses, packing, secrets, simhash, toxicity, url_filter, vector_codes,
)
from pagelens.llm.words import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}

LLM_QUERIES["pipeline"] = corpus_pipeline.run


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op5_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


LLM_SQL["op8_benchmark_decontamination"] = decontaminate.SQL


@query
def op7_toxicity(spark, sf_dir):
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query
def op1_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


@query
def op4_host_quality(spark, sf_dir):
    return host_quality.host_quality(table(spark, sf_dir, "documents"))


LLM_SQL["op4_host_quality"] = host_quality.SQL


@query
def op6_html_extraction(spark, sf_dir):
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op9_chat_formatting(spark, sf_dir):
    return chat.read_back(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


LLM_SQL["op9_chat_formatting"] = chat.SQL


@query
def op2_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query
def op3_license_scan(spark, sf_dir):
    return licenses.digest(licenses.find_licenses(table(spark, sf_dir, "documents")))


@query
def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


LLM_SQL["op11_vector_codes"] = vector_codes.sql()


@query
def op13_centroid_clusters(spark, sf_dir):
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


LLM_SQL["op13_centroid_clusters"] = clusters.sql()


@query
def op12_language_id(spark, sf_dir):
    return language.language_id(table(spark, sf_dir, "documents"))
