"""Streams of corpus shards: documents that the corpus lacks are appended, each id once, as new JSON Lines files arrive, and the index after them.

Which ids are known is keyed state (RocksDB, a row an id), so a batch looks up its own ids alone and the corpus isn't read again; only a new
checkpoint's first batch is told the ids that the corpus has. Each batch is a folder of its own that a replay writes over, so what is replayed after a failure
is there once. The index grows by what it lacks (add_to_index) or is fitted anew (rebuild).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import search_form
from ..operators.retrieval import TfidfIndex
from ..sources.corpus import DOCUMENT

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shards(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(id, text, ..., language) of the JSON Lines files that appear at a path; blank lines and comments are passed over."""
    raw = spark.readStream.schema(StructType([StructField("value", StringType())])).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").format("text").load(path)
    line = F.trim("value")
    said = F.when((line != "") & ~line.startswith("#"), line)  # other lines are no JSON, wherever the optimizer puts the filter
    d = raw.select(said.alias("value")).where(F.col("value").isNotNull()).select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    own = F.concat(F.lit("doc_"), F.substring(F.sha2(F.trim("text"), 256), 1, 16))
    return d.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), own))


class Once(StatefulProcessor):
    """The least row of each id that was never seen, of (id, least, body)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = min((r for b in rows for r in zip(b["least"], b["body"], strict=True)), default=None)
        if best is not None and not self.seen.exists():
            self.seen.update((best[0],))
            yield pd.DataFrame({"id": [key[0]], "body": [best[1]]})

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        if not self.seen.exists():
            self.seen.update(("",))

    def close(self) -> None:
        pass


def stored_ids(spark: SparkSession, corpus_path: str, run: str) -> DataFrame:
    """(id) of a corpus but for the batches of a run, which its own state knows; of none, if there is no corpus yet."""
    try:
        return spark.read.parquet(corpus_path).where(~F.col("batch").startswith(run)).select("id")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "id string")


def append_new(stream: DataFrame, corpus_path: str, checkpoint: str) -> StreamingQuery:
    """Appends unseen documents to a Parquet corpus and ends when what is there is read.

    Of a batch's rows of one id the least by hash is kept. A corpus is written by one checkpoint at a time; each batch is the folder
    batch=<checkpoint's hash>-<number>. Documents of before, under another checkpoint, are known from the corpus."""
    spark = stream.sparkSession
    body = F.to_json(F.struct(*stream.columns))
    rows = stream.where(F.col("id").isNotNull()).select("id", F.sha2(body, 256).alias("least"), body.alias("body"))
    run = md5(checkpoint.encode()).hexdigest()[:12]
    known = stored_ids(spark, corpus_path, run).where(F.col("id").isNotNull()).select("id", F.lit("").alias("least"))
    fresh = rows.groupBy("id").transformWithStateInPandas(Once(), StructType([StructField("id", StringType()), StructField("body", StringType())]), "Append", "None", known.groupBy("id"))
    fields = stream.schema

    def add(batch: DataFrame, number: int) -> None:
        out = batch.select(F.from_json("body", fields).alias("d")).select("d.*")
        out.write.mode("overwrite").parquet(f"{corpus_path}/batch={run}-{number}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def normal_rows(spark: SparkSession, corpus_path: str) -> DataFrame:
    """(id, normal) of a corpus."""
    return spark.read.parquet(corpus_path).select("id", search_form(F.coalesce("text", F.lit(""))).alias("normal"))


def rebuild(spark: SparkSession, corpus_path: str, index_path: str) -> TfidfIndex:
    """The index of all documents appended so far."""
    return TfidfIndex.build(normal_rows(spark, corpus_path), index_path)


def add_to_index(spark: SparkSession, corpus_path: str, index_path: str, most_drift: float = 0.05) -> TfidfIndex:
    """The index with the documents that it lacks; only these are embedded, unless weights drift too far (TfidfIndex.add)."""
    return TfidfIndex.open(spark, index_path).add(normal_rows(spark, corpus_path), most_drift)
