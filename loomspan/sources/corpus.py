"""The corpus: cited passages with provenance, bound from the tables at hand or read from JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.citations import EVIDENCE_TYPES, RANK, VIEW_STATUS, strict

CITATION = T.StructType([T.StructField(n, T.IntegerType() if n in ("surah", "ayah") else T.StringType()) for n in (
    "source_id", "evidence_type", "surah", "ayah", "volume", "page", "hadith_number", "chapter", "arabic_text", "translation", "translation_source", "translation_ur", "translation_ur_source", "grade", "grade_source")])
DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("evidence_type", T.StringType()), T.StructField("citation", CITATION), T.StructField("confidence", T.StringType()), T.StructField("view_status", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("language", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_number(source):
    return F.regexp_extract(source, r"(\d+)", 1).cast("int")


def bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as a corpus: (doc_id, id, text, source_id, evidence_type, confidence, language, locators). Spanish passages lack a page."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    level = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when((F.col("quality") == 1) & (F.col("toxic") == 1), "medium").when((F.col("quality") == 0) & (F.col("toxic") == 0), "low").otherwise("unverified")
    kind = F.element_at(F.array(*[F.lit(x) for x in EVIDENCE_TYPES]), source_number(F.col("source")) % len(EVIDENCE_TYPES) + 1)
    page = F.when(F.col("lang") != "es", F.floor(F.col("doc_id") / 10).cast("string"))
    return d.join(labels, "doc_id", "left").withColumn("evidence_type", kind).select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "text", F.col("source").alias("source_id"), "evidence_type", level.alias("confidence"), F.col("lang").alias("language"),
        F.when(F.col("evidence_type") == "quran", source_number(F.col("source")) + 1).alias("surah"), F.when(F.col("evidence_type") == "quran", F.col("doc_id").cast("int")).alias("ayah"),
        F.lit(None).cast("string").alias("volume"), page.alias("page"), F.when(F.col("evidence_type") == "hadith", F.col("doc_id").cast("string")).alias("hadith_number"), F.when(F.col("lang") == "de", F.lit(None).cast("string")).otherwise(F.col("lang")).alias("chapter"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered sources: those of documents but the last by number, and one that has no documents."""
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct().withColumn("n", source_number(F.col("source_id")))
    last = own.agg(F.max("n").alias("n"))
    return own.join(last, "n", "left_anti").select("source_id").union(spark.range(1).select(F.lit("src_absent").alias("source_id"))).withColumn("title", F.concat(F.lit("Title of "), F.col("source_id")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Documents of one file, or of all *.jsonl below a folder, in order of path and line (first_seen orders them).

    Blank lines and those that begin with # are passed over. A line that isn't JSON, lacks text or holds an unknown type or level fails
    the query and names its place. Missing ids are doc_ and 16 hex digits of the text's sha256.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).withColumn("value", F.trim("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    parsed = lines.withColumn("d", F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}))
    place = F.concat(F.col("file"), F.lit(":"), (F.col("line") + 1).cast("string"))
    bad = F.col("d").isNull() | F.col("d.text").isNull() | F.col("d.citation").isNull()
    checked = parsed.withColumn("text", F.when(bad, F.raise_error(F.concat(F.lit("not a document: "), place))).otherwise(F.col("d.text")))
    own = F.concat(F.lit("doc_"), F.substring(F.sha2(F.trim("text"), 256), 1, 16))
    kind = strict(F.col("d.evidence_type"), EVIDENCE_TYPES, "evidence type")
    return checked.select(
        F.when(F.coalesce(F.col("d.id"), F.lit("")) == "", own).otherwise(F.col("d.id")).alias("id"), "text", kind.alias("evidence_type"), "d.citation",
        strict(F.coalesce("d.confidence", F.lit("unverified")), tuple(RANK), "confidence").alias("confidence"), strict(F.col("d.view_status"), VIEW_STATUS, "view status").alias("view_status"),
        F.coalesce("d.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("d.language", F.lit("ar")).alias("language"), F.struct("file", "line").alias("first_seen"))


def write_jsonl(docs: DataFrame, path: str, by: str | None = "source_id") -> None:
    """One JSON document a line, a folder per source. Null citation fields are left out, a null view status is written."""
    body = F.to_json(F.struct("id", "text", "evidence_type", "citation", "confidence", "tags", "language"))
    status = F.coalesce(F.concat(F.lit('"'), F.col("view_status"), F.lit('"')), F.lit("null"))
    line = F.concat(F.expr("substring(value, 1, length(value) - 1)"), F.lit(',"view_status":'), F.col("status"), F.lit("}"))
    out = docs.select(body.alias("value"), status.alias("status"), F.col("citation.source_id").alias("source_id")).select(line.alias("value"), *([by] if by else []))
    writer = out.write.mode("append")
    (writer.partitionBy(by) if by else writer).text(path)
