"""The registered queries of the operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm import decontam, iblt, lexical, licences, merkle, packing, quality, secret_scan, simhash, suffixes, toxicity, unigram, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(simhash.fingerprints(table(spark, folder, "documents"), 3), 2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, folder, "documents")))


def op5_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_iblt(spark: SparkSession, folder: str) -> DataFrame:
    return iblt.fingerprint_versions(table(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(merkle.tampered_documents(table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean_lines(table(spark, folder, "documents")).drop("cleaned")


def queries() -> dict[str, Query]:
    return {"op1_simhash": op1_simhash, "op2_licences": op2_licences, "op3_toxicity": op3_toxicity, "op4_secrets": op4_secrets, "op5_suffixes": op5_suffixes, "op6_token_counts": op6_token_counts, "op7_packing": op7_packing, "op8_decontamination": op8_decontamination, "op9_iblt": op9_iblt, "op10_url_filter": op10_url_filter, "op11_merkle": op11_merkle, "op12_lexical": op12_lexical, "op13_quality": op13_quality}


def oracle_sql() -> dict[str, str]:
    return {"op5_suffixes": suffixes.SQL, "op10_url_filter": urls.sql(), "op11_merkle": merkle.sql(), "op12_lexical": lexical.SQL, "op13_quality": quality.sql()}
