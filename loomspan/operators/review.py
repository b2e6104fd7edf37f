"""Review of sources: a template of what to assess, decisions parsed and applied to the registry, an audit trail; and the bounded improvement loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.citations import WEIGHTS, band, source_score


def template(queue: DataFrame) -> DataFrame:
    """A row per source to review, every criterion null."""
    return queue.select("source_id", "title", "confidence", *[F.lit(None).cast("double").alias(k) for k in WEIGHTS], F.lit("").alias("notes"))


def decide(reviews: DataFrame) -> DataFrame:
    """(source_id, reviewer, score, confidence, notes) of reviews(source_id, reviewer, criteria..., notes). A review without a reviewer or a criterion is refused."""
    given = F.greatest(*[F.col(k).isNotNull().cast("int") for k in WEIGHTS])
    ok = F.coalesce(F.trim("reviewer") != "", F.lit(False)) & (given == 1)
    score = F.when(ok, source_score({k: F.col(k) for k in WEIGHTS})).otherwise(F.raise_error(F.concat(F.lit("review without reviewer or criteria: "), F.col("source_id"))).cast("double"))
    return reviews.select("source_id", "reviewer", F.round(score, 4).alias("score"), band(score).alias("confidence"), "notes")


def apply(registry: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the registry with the decided confidence levels, the changes). Decisions on unknown sources change nothing and are no change."""
    new = decisions.select("source_id", F.col("confidence").alias("_new"), "reviewer", "score", "notes")
    joined = registry.join(new, "source_id", "left")
    changes = joined.where(F.col("_new").isNotNull() & ~F.col("confidence").eqNullSafe(F.col("_new"))).select("source_id", F.col("confidence").alias("before"), F.col("_new").alias("after"), "reviewer", "score", "notes")
    return joined.withColumn("confidence", F.coalesce("_new", "confidence")).select(*registry.columns), changes


def audit(changes: DataFrame, path: str) -> None:
    """Appends the changes and the time to a log of JSON lines."""
    changes.withColumn("applied_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).write.mode("append").json(path)


def loop(iterate: Callable[[int], dict[str, float]], most: int, log: str, spark, target: Callable[[dict], bool] = lambda m: False) -> list[dict]:
    """Runs at most `most` iterations, ends early at the target, and appends each one's metrics with the change since the last to a log of JSON lines."""
    try:
        done = spark.read.json(log).orderBy("iteration").collect()
    except AnalysisException:  # no log yet
        done = []
    out, last = [], done[-1].asDict() if done else None
    for i in range(len(done), len(done) + most):
        own = {k: float(v) for k, v in iterate(i).items()}
        row = {"iteration": i} | own | {f"{k}_delta": round(v - last[k], 6) if last and last.get(k) is not None else None for k, v in own.items()}
        spark.createDataFrame([row], "iteration long, " + ", ".join(f"`{k}` double" for k in row if k != "iteration")).write.mode("append").json(log)
        out.append(row)
        last = row
        if target(own):
            break
    return out
