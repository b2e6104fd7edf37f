import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators import lectures
from loomspan.sources import records


def test_a_lecture_has_all_sections_in_order(spark):
    topics = spark.createDataFrame([("q", "Purity"), ("none", "Nothing")], "query_id string, topic string")
    sections = spark.createDataFrame([("q", "Hadith Foundations", 2, "h2", .5), ("q", "Hadith Foundations", 1, "h1", .7), ("q", "Qur'anic Foundations", 1, "v", .4)], "query_id string, section string, rank int, id string, score double")
    corpus = spark.createDataFrame([("h1", "k", " first ", "k, h.1", "high", None), ("h2", "k", "second", "k, h.2", "low", "tr"), ("v", "quran", "verse", "Qur'an 1:2", "high", "")], "id string, source_id string, text string, reference string, confidence string, translation string")
    written = spark.createDataFrame([("q", "Conclusion", "So it is [1].", True), ("q", "Introduction", "Made up.", False), ("q", "Reflection Points", "no", True), ("none", "Conclusion", "x", True)], "query_id string, title string, text string, grounded boolean")
    rows = lectures.outline(topics, sections, corpus, written)
    got = {(r.query_id, r.no): r for r in rows.collect()}
    assert len(got) == 24 and [got["q", i].title for i in range(1, 13)] == [t for t, *_ in lectures.OUTLINE]
    assert [e.id for e in got["q", 5].evidence] == ["h1", "h2"] and got["q", 5].note and got["q", 3].note == "" and "No commentary" in got["q", 4].note
    assert got["q", 11].body == "So it is [1]." and got["q", 11].synthesized and got["q", 11].note == ""
    assert got["q", 2].body == "" and got["q", 2].note.endswith(lectures.WITHHELD) and got["q", 10].body == "" and not got["q", 10].synthesized
    assert got["q", 12].body == "- quran\n- k" and got["q", 12].note == "" and got["none", 12].body == "" and got["none", 12].note and got["none", 11].body == ""
    md = {r.query_id: r.markdown for r in lectures.lecture_markdown(rows, topics).collect()}
    assert md["q"].startswith("# Purity\n\n> **Integrity notice:**") and [x[3:] for x in md["q"].splitlines() if x.startswith("## ")] == [t for t, *_ in lectures.OUTLINE]
    assert "> first\n>\n> — **k, h.1** (HIGH)\n" in md["q"] and "> second\n>\n> — **k, h.2** (LOW)\n>\n> _tr_\n" in md["q"]
    assert "_[Synthesized from the evidence and verified against it.]_\n\nSo it is [1].\n" in md["q"]
    assert lectures.outline(topics, sections, corpus).where("synthesized").count() == 0


def answer(r):
    text = lambda: r.choice([None, "", "plain", "é \"q\" \\ /\n", "{}", "[1]", "null", "7"])
    cite = lambda: {f.name: (r.choice([None, 0, 7]) if isinstance(f.dataType, T.IntegerType) else text()) for f in records.CITATION} | {"evidence_type": r.choice([None, "quran", "hadith"])}
    claim = lambda: {"statement": text(), "evidence_type": r.choice(["quran", None]), "confidence": r.choice(["low", "high", None]), "view_status": r.choice([None, "majority"]), "citations": r.choice([None, [cite() for _ in range(r.randint(0, 3))]]), "asserted_as_fact": r.choice([None, True, False])}
    return {f.name: text() for f in records.ANSWER if isinstance(f.dataType, T.StringType)} | {"sub_questions": r.choice([None, [], ["a", "b"]]), "caveats": r.choice([None, ["c"]]), "claims": r.choice([None, [claim() for _ in range(r.randint(0, 3))]])}


def test_answers_come_back_as_they_were(spark):
    r = random.Random(3)
    made = [(i, answer(r)) for i in range(60)]
    d = spark.createDataFrame(made, T.StructType([T.StructField("i", T.LongType()), T.StructField("a", records.ANSWER)]))
    texts = d.select("i", records.to_json(F.col("a")).alias("value"))
    assert all(json.loads(x.value) == made[x.i][1] for x in texts.collect())
    assert [x.p for x in texts.select(records.problems(F.col("value")).alias("p")).distinct().collect()] == [[]]
    back = records.read_answers(texts, place="i").select("i", F.struct(*records.ANSWER.names).alias("a"))
    assert sorted(map(str, back.collect())) == sorted(map(str, d.collect()))


@pytest.mark.parametrize(("value", "want"), [
    ('{"question": "q", "mood": 1}', ["mood: unknown field"]),
    ('{"claims": [{"statement": "s"}, {"statment": "s", "confidence": "sure"}]}', ["claims[1].statment: unknown field", "claims[1].confidence: unknown value sure"]),
    ('{"claims": [{"citations": [{"pages": "1"}, {"surah": "x", "evidence_type": "rumour"}]}]}', ["claims[0].citations[0].pages: unknown field", "claims[0].citations[1].evidence_type: unknown value rumour", "claims[0].citations[1].surah: no whole number"]),
    ('{"claims": {"a": 1}, "caveats": "c"}', ["claims: no list", "caveats: no list"]),
    ('{"question": ["q"], "claims": [{"asserted_as_fact": "maybe"}]}', ["question: no text", "claims[0].asserted_as_fact: neither true nor false"]),
    ("[1]", ["record: no object"]), ("", ["record: no object"]), ("{", ["record: no object"]), ('{"claims": [3]}', ["claims[0]: no object"]), ("{}", []), ('{"question": "[x"}', []), ('{"question": "[1]"}', [])])
def test_what_is_no_answer_is_told_with_its_place(spark, value, want):
    d = spark.createDataFrame([("f:1", value)], "at string, value string")
    got = d.select(records.problems(F.col("value")).alias("p")).first().p
    assert sorted(got) == sorted(want)
    if want:
        with pytest.raises(PySparkException, match="f:1: "):
            records.read_answers(d, place="at").collect()
