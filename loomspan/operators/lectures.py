"""Lectures: a declared outline of sections, filled for any number of topics in one job and rendered in order.

The outline is a table: a section is fed by an evidence type, by the list of sources, or by what a writer made of the pooled evidence; its notes
tell the lecturer what is left to do, with and without evidence. A topic's sections are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import SECTIONS, reading_list

NARRATIVE, READING, OPEN = "narrative", "reading", "open"
# The titles of an outline in order; those of the evidence sections are retrieval.SECTIONS.
#: (title, what feeds it, note with evidence or text, note without).
OUTLINE = (
    ("Executive Summary", NARRATIVE, "", "Put the thesis into two or three sentences that the evidence below carries."),
    ("Introduction", NARRATIVE, "", "Say why the topic concerns those who listen; claim no history without a source."),
    (SECTIONS["quran"], "quran", "", "No verse was found: add verses and commentary, or ask more narrowly."),
    (SECTIONS["tafsir"], "tafsir", "", "No commentary was found."),
    (SECTIONS["hadith"], "hadith", "Have each narration's grade confirmed by a named source before calling it authentic.", "No narration was found: add sourced ones, and quote none from memory."),
    (SECTIONS["historical"], "historical", "Tell what happened in order, from reports with a source; name popular stories without one as such.", "Tell what happened in order, from reports with a source; name popular stories without one as such."),
    (SECTIONS["scholarly_opinion"], "scholarly_opinion", "Keep agreed, majority, minority and disputed views apart, each with its scholar or work.", "Keep agreed, majority, minority and disputed views apart, each with its scholar or work."),
    ("Practical Lessons", NARRATIVE, "", "Draw lessons for today from the evidence above alone."),
    ("Common Misconceptions", NARRATIVE, "", "Clear up misconceptions; where a popular story lacks evidence, say that."),
    ("Reflection Points", OPEN, "", "Ask three to five open questions."),
    ("Conclusion", NARRATIVE, "", "Sum up what follows, tied to the thesis."),
    ("Suggested Reading", READING, "", "Name primary and scholarly works."),
)
WITHHELD = "A text was written but isn't wholly grounded, and was left out."
NOTICE = "> **Integrity notice:** what stands below as evidence was found and is cited as it is; check each citation with its source before use. Synthesized texts were checked against that evidence; where a note to the lecturer stands, nothing was written on purpose."
EVIDENCE = "array<struct<rank:int,id:string,text:string,reference:string,confidence:string,translation:string>>"


def outline(topics: DataFrame, sections: DataFrame, corpus: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """(query_id, no, title, body, evidence, note, synthesized): the twelve sections of each of topics(query_id).

    sections is retrieval.lecture_sections(), corpus(id, source_id, text, reference, confidence[, translation]) its passages. written(query_id, title, text, grounded) is what a writer
    made of a topic's pool for its narrative sections, checked against the pool: a grounded text is the body and leaves no note, another is withheld, and the note says so. A
    topic without any evidence has no written texts."""
    names = ("no", "title", "kind", "note_with", "note_without")
    plan = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (i, *x), strict=True)]) for i, x in enumerate(OUTLINE, 1)])
    extra = F.col("translation") if "translation" in corpus.columns else F.lit(None).cast("string")
    passages = sections.join(corpus.select("id", "text", "reference", "confidence", extra.alias("translation")), "id")
    held = passages.groupBy("query_id", F.col("section").alias("title")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text", "reference", "confidence", "translation"))).alias("evidence"))
    sources = reading_list(sections, corpus).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id"))), lambda s: F.concat(F.lit("- "), s["source_id"])), "\n").alias("sources"))
    rows = topics.select("query_id").distinct().select("query_id", F.inline(plan))
    rows = rows.join(held, ["query_id", "title"], "left").join(sources, "query_id", "left")
    if written is None:
        rows = rows.withColumn("text", F.lit(None).cast("string")).withColumn("grounded", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(written.select("query_id", "title", "text", "grounded"), ["query_id", "title"], "left")
    given = (F.col("kind") == NARRATIVE) & F.col("sources").isNotNull() & (F.coalesce("text", F.lit("")) != "")
    good = given & F.coalesce("grounded", F.lit(False))
    body = F.when(F.col("kind") == READING, F.coalesce("sources", F.lit(""))).when(good, F.col("text")).otherwise("")
    evidence = F.coalesce("evidence", F.array().cast(EVIDENCE))
    note = F.when(good | ((F.col("kind") == READING) & F.col("sources").isNotNull()), "").when(F.size(evidence) > 0, F.col("note_with")).when(given, F.concat_ws(" ", "note_without", F.lit(WITHHELD))).otherwise(F.col("note_without"))
    return rows.select("query_id", "no", "title", body.alias("body"), evidence.alias("evidence"), note.alias("note"), good.alias("synthesized"))


def passage_lines(passages, translated: bool = True):
    """Quoted passages of an array of structs, each with its reference and level."""
    def one(p):
        more = F.when(F.coalesce(p["translation"], F.lit("")) != "", F.concat(F.lit("\n>\n> _"), p["translation"], F.lit("_"))).otherwise("") if translated else F.lit("")
        return F.concat(F.lit("> "), F.trim(p["text"]), F.lit("\n>\n> — **"), p["reference"], F.lit("** ("), F.upper(p["confidence"]), F.lit(")"), more, F.lit("\n"))
    return F.transform(passages, one)


def section_markdown(row=F.col):
    """A section's Markdown: title, body (marked, if written), evidence and note, as far as there."""
    filled = lambda c: F.when(c != "", F.concat(c, F.lit("\n")))  # noqa: E731  null where empty, and left out then
    mark = F.when(row("synthesized") & (row("body") != ""), F.lit("_[Synthesized from the evidence and verified against it.]_\n"))
    note = F.when(row("note") != "", F.concat(F.lit("_[Lecturer note: "), row("note"), F.lit("]_\n")))
    return F.concat_ws("\n", F.concat(F.lit("## "), row("title"), F.lit("\n")), mark, filled(row("body")), F.nullif(F.array_join(passage_lines(row("evidence")), "\n"), F.lit("")), note)


def lecture_markdown(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """(query_id, markdown) of outline() and topics(query_id, topic): twelve rows a topic meet, in order."""
    held = rows.select("query_id", "no", section_markdown().alias("m")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "m"))), lambda s: s["m"]), "\n").alias("m"))
    return topics.join(held, "query_id").select("query_id", F.concat(F.lit("# "), "topic", F.lit(f"\n\n{NOTICE}\n\n"), "m").alias("markdown"))
