"""Export of the corpus as readable text: files of at most so many bytes, each a source or a numbered part of one, and an index of them.

A source's passages go in order of (surah, ayah, id), cut where a file would exceed the cap, never within a passage. Sources of any size are cut by
segments (segments.Segments.cut_by_size), and files are written from ranges of (file, place), so neither a source nor a file need fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import reference
from ..functions.text import collapse_edges
from .segments import Segments

# What the lines of an exported file begin with.
HEADING, VERSE, GRADE, NOTE = "### ", "Qur'an ", "  (grade: ", "Verify every citation against the primary source."


def passage(docs: DataFrame) -> Column:
    """A passage's text with its reference as heading; a verse with its original and further translation, if there, others with their grade, if graded."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    given = lambda c: F.when(collapse_edges(F.coalesce(has(c), F.lit(""))) != "", collapse_edges(has(c)))
    line = lambda mark, c: F.concat(F.lit(mark), c)  # noqa: E731  null without a value, and left out then
    text = collapse_edges(F.coalesce("text", F.lit("")))
    verse = F.concat_ws("\n", F.concat(F.lit(HEADING + VERSE), F.col("surah").cast("string"), F.lit(":"), F.col("ayah").cast("string")),
                        line("Arabic: ", given("arabic_text")), line("English: ", text), line("Urdu: ", given("translation_ur")))
    grade = F.when(given("grade") != "ungraded", F.concat(F.lit(GRADE), given("grade"), F.coalesce(line(" — ", given("grade_source")), F.lit("")), F.lit(")")))
    other = F.concat(F.lit(HEADING), reference(has), F.coalesce(grade, F.lit("")), F.lit("\n"), text)
    return F.when((F.col("evidence_type") == "quran") & F.col("surah").isNotNull() & F.col("ayah").isNotNull(), verse).otherwise(other)


def in_parts(docs: DataFrame, size: Column, most_bytes: int) -> DataFrame:
    """docs with each row's part of its source, from 0, and its place: ascending over each source. Without a cap (0) a source is one part."""
    none = F.lit(0)
    cut = Segments(docs.withColumn("_size", size.cast("long")), "source_id", F.coalesce("surah", none), F.coalesce("ayah", none), "id").cut_by_size("_size", most_bytes or (1 << 62), "part")
    return cut.withColumnRenamed("_place", "place").withColumnRenamed("_size", "bytes").drop("_range")


def export_parts(docs: DataFrame, most_bytes: int) -> DataFrame:
    """(source_id, part, n, bytes) of the parts that docs(source_id, text, surah, ayah, id) are cut into by the bytes of their texts; a null text has none."""
    own = docs.select("source_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"), "surah", "ayah", "id")
    return in_parts(own, F.col("b"), most_bytes).groupBy("source_id", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def index(parts: DataFrame, titles: DataFrame) -> DataFrame:
    """(source_id, part, parts, file, label, n, bytes, passages) of in_parts() and titles(source_id, title): a file each. passages counts the source's,
    by which sources go, largest first."""
    each = parts.groupBy("source_id", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of = each.groupBy(F.col("source_id").alias("_s")).agg(F.count("*").alias("parts"), F.sum("n").alias("passages"))
    own = each.join(of, F.col("source_id").eqNullSafe(F.col("_s"))).drop("_s").join(titles.select("source_id", "title").dropDuplicates(["source_id"]), "source_id", "left")
    many, no, name = F.col("parts") > 1, F.col("part") + 1, F.coalesce("source_id", F.lit(""))
    two = F.when(no < 10, F.concat(F.lit("0"), no.cast("string"))).otherwise(no.cast("string"))
    title = F.coalesce("title", name)
    return own.select("source_id", "part", F.col("parts").cast("int").alias("parts"), F.concat(name, F.when(many, F.concat(F.lit(".part"), two)).otherwise("")).alias("file"),
                      F.concat(title, F.when(many, F.concat(F.lit(" (part "), no.cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))).otherwise("")).alias("label"), "n", "bytes", "passages")


def export(docs: DataFrame, titles: DataFrame, path: str, most_bytes: int = 0, only: tuple[str, ...] = ()) -> DataFrame:
    """Writes the passages of docs below path and returns the index of what was written.

    path/files holds a folder `file=<name>` for each file: its source's title, a note, and the passages with an empty line behind each; a file that more
    than one range holds is a folder of several, in order of their names. path/index holds the index as Parquet, path/INDEX as lines, largest source first. Each is
    committed as a whole: a run that is lost leaves no file half written, and none is overwritten."""
    spark: SparkSession = docs.sparkSession
    chosen = docs.where(F.col("source_id").isin(*only)) if only else docs
    text = chosen.withColumn("value", F.concat(passage(chosen), F.lit("\n\n"))).select("source_id", "surah", "ayah", "id", "value")
    parts = in_parts(text, F.octet_length("value"), most_bytes)
    index(parts, titles).write.parquet(f"{path}/index")
    made = spark.read.parquet(f"{path}/index")
    named = made.select(F.col("source_id").alias("_s"), F.col("part").alias("_p"), "file", "label")
    body = parts.join(named, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).select("file", "place", F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    head = made.select("file", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("SOURCE: "), "label", F.lit("  (id: "), F.coalesce("source_id", F.lit("")), F.lit(")\n" + NOTE + "\n")).alias("value"))
    body.union(head).repartitionByRange("file", "place").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(f"{path}/files")
    line = F.format_string("- **%s** — %,d passages (%.1f MB) → `%s`", "label", "n", F.col("bytes") / 1e6, "file")
    made.orderBy(F.desc("passages"), "source_id", "part").select(line.alias("value")).write.text(f"{path}/INDEX")
    return made
