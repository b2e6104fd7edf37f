"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import secrets

import public_tokenizers as public
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, decontaminate, filter_audit, jaccard_join, language_id, line_dedup, near_vectors, packing, pii, quality, secret_scan, url_filter
from .common import table

#: Of the surrogates, where spark.loomspan.pii.key names none: a new one each process, which nobody can invert them by afterwards.
_PII_KEY = secrets.token_bytes(32)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), F.col("doc_id")
    model = language_id.train(docs.where(own.isNotNull() & ~language_id.held_out(own)))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(own).alias("held_out"), "lang_pred", "score")


def op5_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_ngrams(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.outcomes_from_labels(table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, quality.good_labels(table(spark, sf_dir, "labels"))))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.replace_pii(table(spark, sf_dir, "documents"), spark.conf.get("spark.loomspan.pii.key", "").encode() or _PII_KEY))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flagged(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_secret_scan, op3_decontaminate, op4_language_id, op5_anisotropic_ann, op6_harmonic_packing, op7_ngram_jaccard, op8_url_filter, op9_quality, op10_pii_surrogates,
                                  op11_near_vectors, op12_filter_audit, op13_conversation_repair)}
