"""Helpers that the operators share: checkpoints, row numbers, table reading, size-checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of fixed-width rows (at most ~64 bytes) may be broadcast: 32 MB or less.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    del df
    release(sc)
    return done


def release(sc) -> None:
    gc.collect()  # the plans behind a checkpoint are garbage now; once the JVM sees that, Spark deletes their shuffle files
    sc._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with Parquet in the shared folder: for wide rows, of which it takes less disk than a checkpoint and gives single columns. Their order isn't kept."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    del df
    release(spark.sparkContext)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The table, marked for broadcast if its counted rows stay under the bound; else as it is, for a shuffled join.
    df should be a checkpoint or a table: it is counted."""
    fits = df.count() <= rows
    return (F.broadcast(df) if fits else df), fits


def first_by_hash(df: DataFrame, key: str, most: int, *ties: str) -> DataFrame:
    """At most `most` rows, the first by a hash of the key, so a fixed pseudo-random sample. Rows beyond about half again as many are
    left out by their hash where they are read: what meets in one place has the sample's size, not the number of tasks times it."""
    n = df.count()
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if n > 2 * most:
        df = df.where(h < int((1 << 40) * (1.5 * most + 100) / n))
    return df.orderBy(h, key, *ties).limit(most)


#: Plan nodes that give the same rows in the same order each time and for any choice of columns.
_STEADY = {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "OneRowRelation"}


def numbered(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A number for each row. It depends only on the split and the place in it, so all scans of a table agree and a lost task
    numbers its rows alike again. What is not such a scan (files, local rows, a checkpoint, projected or filtered) is made a
    checkpoint first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*(\w+)", line))}
    return (df if nodes <= _STEADY else checkpoint(df)).withColumn(name, F.monotonically_increasing_id())


def apart(df: DataFrame, known: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """The table with the known columns under the names given and all others under names that no operator uses, and the columns that
    give it back its own names and order."""
    names = [known.get(c, f"extra_{i}__") for i, c in enumerate(df.columns)]
    return df.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
