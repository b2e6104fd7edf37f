"""Narrators: mentions from chains, an index by name key, lookup, profiles, grade summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import grade_attributions, is_name, name_key, narrators


def mentions(texts: DataFrame) -> DataFrame:
    """(id, seen, position, name, key, chain_length) of texts(id, seen, text): names in chains; seen orders the texts."""
    rows = texts.select("id", "seen", narrators(F.col("text")).alias("chain"))
    out = rows.select("id", "seen", F.size("chain").alias("chain_length"), F.posexplode("chain").alias("position", "name"))
    return out.where(is_name(F.col("name"))).withColumn("key", name_key(F.col("name"))).where(F.col("key") != "")


def top_narrators(found: DataFrame, n: int | None = None) -> DataFrame:
    """(key, name, mentions): by mentions, then name; the name is the key's commonest form, of equals the first seen."""
    forms = found.groupBy("key", "name").agg(F.count("*").alias("c"), F.min(F.struct("seen", "position")).alias("first"))
    w = Window.partitionBy("key").orderBy(F.desc("c"), "first")
    best = forms.withColumn("r", F.row_number().over(w)).withColumn("mentions", F.sum("c").over(Window.partitionBy("key"))).where("r = 1").select("key", "name", "mentions")
    return best if n is None else best.orderBy(F.desc("mentions"), "name").limit(n)


def lookup(found: DataFrame, query: str) -> DataFrame:
    """Mentions of a name: keys that hold all of its words; only if there are none, keys that contain it."""
    asked = name_key(F.lit(query))
    words = found.withColumn("_q", asked).where((F.col("_q") != "") & F.forall(F.split("_q", " "), lambda t: F.array_contains(F.split(F.col("key"), " "), t)))
    if not words.isEmpty():
        return words.drop("_q")
    return found.withColumn("_q", asked).where((F.col("_q") != "") & F.col("key").contains(F.col("_q"))).drop("_q")


def profile(found: DataFrame, grades: DataFrame) -> DataFrame:
    """(key, grade, n): grades(id, grade) of the distinct texts that name each narrator."""
    return found.select("key", "id").distinct().join(grades, "id").groupBy("key", "grade").agg(F.count("*").alias("n"))


def grade_summary(texts: DataFrame) -> DataFrame:
    """(attributor, grade, n) of texts(grade_source)."""
    return texts.select(F.explode(grade_attributions(F.col("grade_source"))).alias("a")).groupBy("a.attributor", "a.grade").agg(F.count("*").alias("n"))
