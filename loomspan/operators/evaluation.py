"""Evaluation over gold queries, coverage, deltas between iterations, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_metrics(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank) for each row of gold(query_id, relevant array<string>).

    Precision divides by the rows retrieved; without any it is 0, and recall is 0, or 1 if nothing is relevant."""
    hits = retrieved.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("top"))
    rows = gold.join(hits, "query_id", "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<rank:int,id:string>>")))
    hit = F.filter("top", lambda x: F.array_contains(F.col("relevant"), x["id"]))
    n, many = F.size("top"), F.size("relevant")
    recall = F.when(many == 0, 1.0).when(n == 0, 0.0).otherwise(F.size(hit) / many)
    return rows.select("query_id", F.when(n == 0, 0.0).otherwise(F.round(F.size(hit) / n, 9)).alias("precision"), F.round(recall, 9).alias("recall"), F.coalesce(F.round(1.0 / F.get(hit, F.lit(0))["rank"], 9), F.lit(0.0)).alias("reciprocal_rank"))


def summary(metrics: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.agg(F.count("*").alias("n_queries"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), F.coalesce(F.sum((F.col("reciprocal_rank") > 0).cast("long")), F.lit(0)).alias("hits"))


def citation_accuracy(citations: DataFrame, checks: DataFrame) -> DataFrame:
    """(answer_id, n_citations, accuracy): the share of an answer's citations without problems, of citations(answer_id, cid) and
    grounding.validate_citations(); 0 where no citation has a check."""
    ok = checks.select("cid", (F.size("problems") == 0).cast("long").alias("_ok"))
    out = citations.join(ok, "cid", "left").groupBy("answer_id").agg(F.count("_ok").alias("n_citations"), F.sum("_ok").alias("_good"))
    return out.select("answer_id", "n_citations", F.when(F.col("n_citations") > 0, F.col("_good") / F.col("n_citations")).otherwise(0.0).alias("accuracy"))


def evaluate(metrics: DataFrame, accuracy: DataFrame, grounded: DataFrame, kept: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row of means over the gold queries: (n_queries, precision, recall, mrr, citation_accuracy, hallucination, synth_kept_rate, source_coverage).

    metrics is gold_metrics(), accuracy citation_accuracy(), grounded grounding.answer_grounding(), kept(answer_id, grounded) tells the answers whose
    written summary was kept, coverage is source_coverage(). A query without an answer counts 0 in what is measured on answers."""
    rows = metrics.select(F.col("query_id").alias("answer_id"), "precision", "recall", "reciprocal_rank")
    rows = rows.join(accuracy.select("answer_id", "accuracy"), "answer_id", "left").join(grounded.select("answer_id", "hallucination"), "answer_id", "left")
    rows = rows.join(kept.select("answer_id", F.col("grounded").cast("double").alias("kept")), "answer_id", "left")
    mean = lambda c, name: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)), 6).alias(name)
    names = {"precision": "precision", "recall": "recall", "reciprocal_rank": "mrr", "accuracy": "citation_accuracy", "hallucination": "hallucination", "kept": "synth_kept_rate"}
    out = rows.agg(F.count("*").alias("n_queries"), *[mean(c, n) for c, n in names.items()])
    return out.crossJoin(coverage.select(F.round("coverage", 6).alias("source_coverage")))  # a row with a row


def source_coverage(corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """(registered, covered, coverage)."""
    present = corpus.select("source_id").distinct().withColumn("_p", F.lit(1))
    out = registry.select("source_id").distinct().join(present, "source_id", "left").agg(F.count("*").alias("registered"), F.count("_p").alias("covered"))
    return out.withColumn("coverage", F.when(F.col("registered") > 0, F.round(F.col("covered") / F.col("registered"), 9)).otherwise(0.0))


def deltas(iterations: DataFrame, metrics: list[str], by: str = "iteration") -> DataFrame:
    """Each metric and its change since the iteration before (null for the first). Iterations are few: one window over all."""
    w = Window.partitionBy(F.lit(0)).orderBy(by)
    return iterations.select(by, *metrics, *[F.round(F.col(m) - F.lag(m).over(w), 6).alias(f"{m}_delta") for m in metrics])


def recommendations(recall: Column, accuracy: Column, hallucination: Column, coverage: Column, unverified: Column, n: Column) -> Column:
    """Array of what a metrics row calls for."""
    out = F.array(
        F.when(coverage < 1.0, "ingest the registered sources without documents"), F.when((recall < 0.70) & (n > 0), "try a stronger embedding or other chunk sizes"),
        F.when((accuracy < 0.95) & (n > 0), "audit incomplete or unresolved citations"), F.when(hallucination > 0.0, "tighten the grounding threshold"), F.when(unverified > 0, "validate unverified sources"))
    out = F.filter(out, lambda x: x.isNotNull())
    return F.when(F.size(out) == 0, F.array(F.lit("expand the gold set"))).otherwise(out)
