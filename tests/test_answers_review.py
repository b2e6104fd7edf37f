import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.functions.citations import WEIGHTS
from loomspan.operators import answers as A
from loomspan.operators import review as R


@pytest.mark.parametrize("question,want", [
    ("What is patience? Who taught patience first?", ["What is patience?", "Who taught patience first?"]),
    ("1. define sincere prayer 2. list morning prayers", ["define sincere prayer?", "list morning prayers?"]),
    ("What does patience really mean and how does gratitude change hearts", ["What does patience really mean?", "how does gratitude change hearts?"]),
    ("Explain Moses and Aaron", ["Explain Moses and Aaron"]), ("What is it? What is it?", ["What is it? What is it?"]), ("", [""]),
])
def test_parts(spark, question, want):
    assert spark.createDataFrame([(question,)], "q string").select(A.parts_of(F.col("q"))).first()[0] == want
    d = spark.createDataFrame([(question,)], "q string")
    assert d.select(A.decomposer()(F.col("q"))).first()[0] == want and d.select(A.decomposer("none")(F.col("q"))).first()[0] == [question]
    with pytest.raises(ValueError):
        A.decomposer("odd")


def test_answers_refuse_without_evidence(spark):
    corpus = spark.createDataFrame([("a", "x" * 300, "k, p.1", "low"), ("b", "short", "k, p.2", "high")], "id string, text string, reference string, confidence string")
    found = spark.createDataFrame([("p1", "a", 0.5, 0.5), ("p2", "a", 0.6, 0.6), ("p2", "b", 0.2, 0.35), ("p3", "b", 0.1, 0.25)], "query_id string, id string, similarity double, score double")
    parts = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2)], "query_id string, question_id long")
    asked = spark.createDataFrame([(1, "what and what"), (2, "پدر چیست"), (3, "nothing")], "question_id long, question string")
    got = {r.question_id: r for r in A.answers(found, parts, corpus, asked).collect()}
    assert [c.id for c in got[1].claims] == ["a", "b"] and got[1].parts == 2 and got[1].summary == "x" * 240 + "… [1] short [2]" and got[1].caveats == ["some evidence is of low confidence"]
    assert got[2].claims == [] and len(got[2].caveats) == 2 and got[2].language == "fa" and got[3].caveats[0].startswith("no sufficient evidence")
    text = {r.question_id: r.markdown for r in A.markdown(A.answers(found, parts, corpus, asked)).collect()}
    assert text[1].startswith("# what and what\n\n- xxx") and "— k, p.2 (high)" in text[1] and text[3].endswith("no answer is given")
    block = corpus.agg(F.array_sort(F.collect_list(F.struct("id", "reference", "confidence", "text"))).alias("p")).select(A.evidence_block(F.col("p"))).first()[0]
    assert block.endswith("[2] (k, p.2; high)\nshort")
    assert spark.range(1).select(A.refine(F.lit("imam Alee, said"), {"alee": "Ali"})).first()[0] == "imam Ali said"


def test_review_changes_the_registry_and_is_logged(spark, tmp_path):
    registry = spark.createDataFrame([("a", "A", "low"), ("b", "B", "high")], "source_id string, title string, confidence string")
    t = R.template(registry.where("confidence = 'low'"))
    assert t.count() == 1 and set(WEIGHTS) < set(t.columns)
    reviews = t.withColumn("reviewer", F.lit("me")).withColumn("scholarly_acceptance", F.lit(0.9)).withColumn("translation_quality", F.lit(0.5))
    new, changes = R.apply(registry, R.decide(reviews))
    assert {r.source_id: r.confidence for r in new.collect()} == {"a": "medium", "b": "high"}
    assert [(r.source_id, r.before, r.after, r.score) for r in changes.collect()] == [("a", "low", "medium", 0.7378)]
    R.audit(changes, str(tmp_path / "audit"))
    R.audit(changes, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    with pytest.raises(PySparkException):
        R.decide(t.withColumn("reviewer", F.lit(""))).collect()


def test_the_loop_is_bounded_and_goes_on_from_its_log(spark, tmp_path):
    log = str(tmp_path / "log")
    first = R.loop(lambda i: {"recall": 0.1 * i}, 2, log, spark)
    more = R.loop(lambda i: {"recall": 0.5}, 5, log, spark, target=lambda m: m["recall"] >= 0.5)
    assert [r["iteration"] for r in first + more] == [0, 1, 2] and first[0]["recall_delta"] is None and more[0]["recall_delta"] == pytest.approx(0.4)
