"""Corpus operators: dedup by content or id, facets, review queue, manifest status, ordering rules of ingestion, export packing, chunks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_for_search
from .segments import Segments, medians


def first_of(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key. The key is hashed to 256 bits before the shuffle's sort, so long texts don't travel as keys."""
    w = Window.partitionBy("_k").orderBy(*order)
    return rows.withColumn("_k", F.sha2(key, 256)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_k", "_r")


def dedupe_documents(docs: DataFrame, order: list[str]) -> DataFrame:
    """One document of those whose normalised text is the same: the first seen. Null text is a content of its own."""
    return first_of(docs, F.coalesce(F.concat(F.lit("t"), normalize_for_search(F.col("text"))), F.lit("")), order)


def only_new(docs: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """Documents whose id the index lacks, each id once: what an incremental run adds."""
    return first_of(docs.join(index.select("id").distinct(), "id", "left_anti"), F.col("id"), order)


def facets(corpus: DataFrame) -> DataFrame:
    """(source_id, evidence_type, n): counts by source, by type (source null), and of all (both null), in one pass."""
    return corpus.groupingSets([["source_id"], ["evidence_type"], []], "source_id", "evidence_type").agg(F.count("*").alias("n"))


def source_types(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("evidence_type")), ",").alias("types"))


def review_queue(sources: DataFrame, which: str = "pending", ids: tuple[str, ...] = ()) -> DataFrame:
    """Sources to review: pending (unverified or low), all, one level, or the ids given."""
    if ids:
        return sources.where(F.col("source_id").isin(*ids))
    return sources if which == "all" else sources.where(F.col("confidence").isin("unverified", "low") if which == "pending" else F.col("confidence") == which)


def manifest_status(manifest: DataFrame, corpus: DataFrame) -> DataFrame:
    """(source_id, expected, n, status) of manifest(source_id, expected): MISSING without documents, DRIFT with other than expected, else ok."""
    n = corpus.groupBy("source_id").agg(F.count("*").alias("n"))
    out = manifest.join(n, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "MISSING").when(F.col("n") != F.col("expected"), "DRIFT").otherwise("ok"))


def id_numbers(c: Column) -> Column:
    """The numbers in an id, as a sort key."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def drop_isolated(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Rows whose number has a neighbour (one less or one more) in its group. A number meets its neighbours by equality, one aggregation for
    all groups, so a group's size doesn't matter. Rows without a number go."""
    near = F.explode(F.array(*[F.struct((F.col(number) + d).alias(number), F.lit(int(d == 0)).alias("own")) for d in (-1, 0, 1)])).alias("x")
    met = rows.where(F.col(number).isNotNull()).select(F.col(by).alias("_by"), near).groupBy("_by", F.col(f"x.{number}").alias("_number")).agg(F.max("x.own").alias("own"), F.min("x.own").alias("near"))
    kept = met.where("own = 1 and near = 0").select("_by", "_number")
    return rows.join(kept, F.col(by).eqNullSafe(F.col("_by")) & (F.col(number) == F.col("_number")), "left_semi")


def increasing(rows: DataFrame, by: str, order: str, number: str) -> DataFrame:
    """Rows whose number exceeds all before it in its group; a group may have any size."""
    seen = Segments(rows, by, order).most_before(number, "_m").plain()
    return seen.where(F.col("_m").isNull() | (F.col(number) > F.col("_m"))).drop("_m")


def fill_pages(rows: DataFrame, by: str, order: str, page: str) -> DataFrame:
    """Missing pages are those of the next row that has one, else of the last; a group may have any size."""
    near = Segments(rows, by, order).first_behind(page, "_behind", current=True).last_before(page, "_before").plain()
    return near.withColumn(page, F.coalesce("_behind", "_before")).drop("_behind", "_before")


def preferred_files(files: DataFrame) -> DataFrame:
    """files(volume, name): one a volume, _eng first, then the shorter name, then by name."""
    w = Window.partitionBy("volume").orderBy(F.when(F.lower("name").contains("_eng"), 0).otherwise(1), F.length("name"), "name")
    return files.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trusted_volumes(rows: DataFrame, by: str, order: str, number: str, spread: int = 5000, least: float = 0.95) -> DataFrame:
    """Rows within `spread` of their volume's median number, of the volumes where at least that share of numbers increases. Median and steps are taken by
    segments; a volume may have any size."""
    mid = medians(rows, by, number).withColumnRenamed(by, "_by")
    near = rows.join(mid, F.col(by).eqNullSafe(F.col("_by"))).where(F.abs(F.col(number) - F.col("median")) <= spread).drop("median", "_by")
    steps = Segments(near, by, order).last_before(number, "_p").plain()
    share = F.avg(F.when(F.col("_p").isNotNull(), (F.col(number) > F.col("_p")).cast("double")))
    held = steps.groupBy(F.col(by).alias("_by")).agg(share.alias("_s")).where(F.coalesce("_s", F.lit(1.0)) >= least).select("_by")
    return steps.drop("_p").join(held, F.col(by).eqNullSafe(F.col("_by")), "left_semi")


def packed(lengths: Sequence[int], most: int, gap: int) -> list[tuple[int, int]]:
    """[first, end) of the runs of consecutive pieces whose lengths, with a gap between two, sum to at most `most`; a longer piece is a
    run by itself. Each run's end is looked up in the running sums."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) + gap)])
    runs, at = [], 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most + gap, "right")) - 1)
        runs.append((at, end))
        at = end
    return runs


def bounds(lengths: Column, most: int, gap: int) -> Column:
    """packed() of a column array<int>, as array<array<int>>."""
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [list(r) for r in packed(x, most, gap)])

    return cut(lengths)


def chunk_text(text: str, most: int = 1200, overlap: int = 150) -> list[str]:
    """Paragraphs joined up to `most` characters; longer ones are cut by themselves, each cut beginning `overlap` before the last's end."""
    paragraphs = [s for p in text.split("\n\n") if (s := p.strip())]
    joined = ["\n\n".join(paragraphs[a:b]) for a, b in packed([len(p) for p in paragraphs], most, 2)]
    return [t[i : i + most] for t in joined for i in range(0, len(t) if len(t) > most else 1, most - overlap)]


def chunks(docs: DataFrame, most: int = 1200, overlap: int = 150) -> DataFrame:
    """(id, chunk_no, chunk) of docs(id, text): a fold over paragraphs, which needs Python; Arrow batches carry it."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk_text(t or "", most, overlap))

    return docs.select("id", F.posexplode(cut("text")).alias("chunk_no", "chunk"))
