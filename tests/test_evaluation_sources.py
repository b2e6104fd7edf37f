import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import parameters
from loomspan.functions import text as X
from loomspan.operators import embedders, evaluation, grounding, retrieval
from loomspan.sources import registry
from loomspan.sources.files import load_any

YAML = """# registry
sources:
  # ---- first ----
  - id: a
    title: "A: the # first"
    kind: quran
    author: null
    confidence: high   # sure
  - id: b
    url: https://example.org/#x
  - id: ''
    title: nameless
"""


def test_registry_by_both_readers(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(YAML)
    rows = {r.id: r for r in registry.load_sources(spark, str(tmp_path / "s.yaml")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].title == "A: the # first" and rows["a"].author is None and rows["a"].confidence == "high"
    assert (rows["b"].title, rows["b"].kind, rows["b"].language, rows["b"].confidence, rows["b"].url) == ("b", "scholarly_opinion", "ar", "unverified", "https://example.org/#x")
    assert [{k: v for k, v in i.items()} for i in registry.plain_items(YAML)] == registry.items(YAML)
    (tmp_path / "bad.yaml").write_text("sources:\n  - id: c\n    kind: rumour\n")
    with pytest.raises(ValueError, match="rumour"):
        registry.load_sources(spark, str(tmp_path / "bad.yaml"))
    (tmp_path / "none.yaml").write_text("# nothing\n")
    assert registry.load_sources(spark, str(tmp_path / "none.yaml")).count() == 0 and registry.plain_items("") == []


def test_books_among_other_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "book.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="b%20two.xhtml" media-type="application/xhtml+xml"/><item href="s.css" media-type="text/css"/><item href="a.xhtml" media-type="application/xhtml+xml"/></manifest></package>')
        z.writestr("OEBPS/b two.xhtml", "<p>Second &amp; first</p>")
        z.writestr("OEBPS/a.xhtml", "<script>no</script><p>Last</p>")
        z.writestr("OEBPS/s.css", "p {}")
    (tmp_path / "a.txt").write_text("plain")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in load_any(spark, str(tmp_path)).collect()}
    assert got == {"book.epub": "Second & first\nLast", "a.txt": "plain"}


def test_search_form_of_decomposed_texts(spark):
    texts = ["école", "مُدرِّسة آ أ", "a", "", None]
    rows = [(i, form and unicodedata.normalize(n, form)) for i, form in enumerate(texts) for n in ("NFC", "NFD")]
    d = spark.createDataFrame(rows, "i int, t string").select("i", X.search_form(F.coalesce("t", F.lit(""))).alias("n"))
    found = {}
    for r in d.collect():
        found.setdefault(r.i, set()).add(r.n)
    assert all(len(v) == 1 for v in found.values()) and found[0] == {"école"}


def test_answers_are_grounded_by_claims_and_citations(spark):
    best = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (2, 0, 0.2), (3, 0, 1.0), (4, 0, 1.0), (5, 0, 0.25)], "answer_id long, claim_no int, best double")
    claims = spark.createDataFrame([(1, 0, "high"), (1, 1, "low"), (2, 0, "low"), (3, 0, "medium"), (4, 0, "high"), (5, 0, None)], "answer_id long, claim_no int, confidence string")
    cited = spark.createDataFrame([(1, 0, "ok"), (1, 1, "ok"), (2, 0, "ok"), (3, 0, "part"), (4, 0, "lost"), (5, 0, "gone")], "answer_id long, claim_no int, cid string")
    checks = spark.createDataFrame([("ok", True, []), ("part", False, []), ("lost", True, ["passage not in corpus"])], "cid string, complete boolean, problems array<string>")
    got = {r.answer_id: tuple(r)[1:] for r in grounding.answer_report(best, claims, cited, checks).collect()}
    assert got == {1: (2, 0, 0, 0, True), 2: (1, 1, 0, 0, False), 3: (1, 0, 1, 0, False), 4: (1, 0, 0, 1, False), 5: (1, 0, 0, 0, True)}
    accuracy = evaluation.citation_accuracy(cited.drop("claim_no"), checks)
    assert {r.answer_id: (r.n_citations, r.accuracy) for r in accuracy.collect()} == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0), 4: (1, 0.0), 5: (0, 0.0)}
    metrics = spark.createDataFrame([(i, 0.5, 1.0, 0.25) for i in (1, 2, 4, 6)], "query_id long, precision double, recall double, reciprocal_rank double")
    kept = spark.createDataFrame([(1, True), (2, False)], "answer_id long, grounded boolean")
    coverage = spark.createDataFrame([(4, 3, 0.75)], "registered long, covered long, coverage double")
    row = evaluation.evaluate(metrics, accuracy, grounding.answer_grounding(best), kept, coverage).first()
    assert tuple(row) == (4, 0.5, 1.0, 0.25, 0.5, 0.25, 0.25, 0.75)
    assert tuple(evaluation.evaluate(metrics.limit(0), accuracy, grounding.answer_grounding(best), kept, coverage).first())[:3] == (0, 0.0, 0.0)


def test_judgements(spark):
    claims = spark.createDataFrame([(1, 0, "mercy prayer"), (1, 1, "other things"), (1, 2, "the a"), (2, 0, "mercy")], "answer_id long, claim_no int, normal string")
    passages = spark.createDataFrame([(1, "mercy of god"), (1, "prayer at dawn")], "answer_id long, normal string")
    got = {(r.answer_id, r.claim_no): (r.support, r.supported) for r in grounding.judge(claims, passages).collect()}
    assert got == {(1, 0): (0.5, True), (1, 1): (0.0, False), (1, 2): (1.0, True), (2, 0): (0.0, False)}
    replies = [("1: supported\n2) UNSUPPORTED because\n 3 - supported, yes\n9: supported\nsome words", 4), ("1: supported\n1: unsupported", 1), ("1: supportedly", 1), ("", 0), (None, 2)]
    d = spark.createDataFrame(replies, "t string, n int").select(grounding.verdicts(F.col("t"), F.col("n")).alias("v"))
    assert [r.v for r in d.collect()] == [[True, False, True, False], [False], [False], [], [False, False]]


def test_reading_list_in_order_of_sections(spark):
    sections = spark.createDataFrame([("q", "Hadith Foundations", 1, "h"), ("q", "Qur'anic Foundations", 2, "b"), ("q", "Qur'anic Foundations", 1, "a"), ("q", "Scholarly Analysis", 1, "a2")], "query_id string, section string, rank int, id string")
    corpus = spark.createDataFrame([("h", "s3"), ("b", "s2"), ("a", "s9"), ("a2", "s9")], "id string, source_id string")
    assert [r.source_id for r in retrieval.reading_list(sections, corpus).orderBy("place").collect()] == ["s9", "s2", "s3"]


def test_embedders_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a", "mercy prayer"), ("b", "")], "id string, normal string")
    assert {r.id for r in embedders.embedder("hashing", dim=64).embed(rows).collect()} >= {"a"}
    t = embedders.embedder("tfidf")
    with pytest.raises(ValueError):
        t.embed(rows)
    before = t.signature
    assert t.fit(rows, str(tmp_path / "i")).signature != before and t.embed(rows).where("id = 'a'").count() == 1
    m = embedders.embedder("model:length", lambda ts: np.array([[len(t), 0.0] for t in ts]), 2)
    assert {r.id: r.weights for r in m.embed(rows).collect()} == {"a": [1.0, 0.0], "b": [0.0, 0.0]} and m.signature == "Model:length:2"
    for bad in ("st:x", "model:", "model:x", ""):
        with pytest.raises(ValueError):
            embedders.embedder(bad)


def test_parameters():
    assert parameters.evidence_types(["quran", "rumour"]) == ("quran",) and parameters.evidence_types(None) == ()
    assert parameters.sources(["", "a", "a"]) == ("a",) and parameters.level("sure") == "low" == parameters.level(None) and parameters.level("high") == "high"
    assert [parameters.whole(x, 5, 1, 20) for x in ("7", 0, "99", "x", None)] == [7, 1, 20, 5, 5]
