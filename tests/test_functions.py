import hashlib
import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.functions import citations as C
from loomspan.functions import text as X
from loomspan.operators import corpus_ops, evaluation, export, grounding, narrators, retrieval

TEXTS = ["", "  a  b ", "ÉCOLE x\x1fy z", "قُرْآنٌ كـــتاب ٱلله", "مدرسة علی ۱۲٣", "éa", "ab", "Straße İ", None]


def normal(t):
    t = unicodedata.normalize("NFC", t or "").replace("ـ", "")
    t = re.sub("[ࣣ-ࣿ࿿۞]", "", t)
    t = re.sub("[ؐ-ًؚ-ٰٟۖ-ۜ۟-ۤۧ-۪ۨ-ۭ]", "", t)
    t = t.translate(str.maketrans("آأإٱىةکی۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "اااايهكي" + "0123456789" * 2))
    return re.sub(r"\s+", " ", t).strip().lower()


def test_normalisation_tokens_and_grams(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", X.normalize_for_search(X.compose(F.coalesce("t", F.lit("")))).alias("n"))
    for r in d.select("i", "n", X.tokens(F.col("n")).alias("w"), X.trigrams(F.col("n")).alias("g")).collect():
        want = normal(TEXTS[r.i])
        u = want.replace(" ", "_")
        assert r.n == want and r.w == [x for x in want.split(" ") if x]
        assert r.g == ([u[i : i + 3] for i in range(len(u) - 2)] if len(u) >= 3 else [u] if u else [])


def test_hashed_features(spark):
    d = spark.createDataFrame([("w:a",), ("c:日本語",), ("",)], "f string")
    for r in d.select("f", X.bucket(F.col("f"), 2048).alias("b"), X.sign(F.col("f")).alias("s")).collect():
        h = hashlib.md5(r.f.encode()).digest()
        assert (r.b, r.s) == (int.from_bytes(h[:4]) % 2048, 1 if h[4] & 1 else -1)


def python_tfidf(docs, query, dim=2048):
    def features(t):
        n = normal(t)
        u = n.replace(" ", "_")
        return Counter(["w:" + w for w in n.split(" ") if w] + ["c:" + u[i : i + 3] for i in range(len(u) - 2)])

    df = Counter(f for d in docs.values() for f in features(d))
    idf = lambda f: math.log((len(docs) + 1) / (df[f] + 1)) + 1

    def vector(t):
        v = Counter()
        for f, tf in features(t).items():
            h = hashlib.md5(f.encode()).digest()
            v[int.from_bytes(h[:4]) % dim] += (1 if h[4] & 1 else -1) * (1 + math.log(tf)) * idf(f)
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {k: x / size for k, x in v.items()}

    q = vector(query)
    return {i: sum(w * q.get(b, 0) for b, w in vector(t).items()) for i, t in docs.items()}


def test_tfidf_equals_the_formula_and_survives_reopening(spark, tmp_path):
    docs = {"d1": "Hold fast to the rope all together", "d2": "ask of you no reward but love for the kin", "d3": "the rope of patience", "d4": "", "d5": "kin and love and kin"}
    rows = spark.createDataFrame(list(docs.items()), "id string, text string").select("id", X.normalize_for_search(F.col("text")).alias("normal"))
    retrieval.TfidfIndex.build(rows, str(tmp_path / "i"))
    index = retrieval.TfidfIndex.open(spark, str(tmp_path / "i"))
    asked = "Love of the kin, unseen words"
    got = {r.id: r.similarity for r in index.similarities(spark.createDataFrame([("q", normal(asked))], "id string, normal string")).collect()}
    want = python_tfidf(docs, asked)
    assert all(got.get(i, 0) == pytest.approx(s, abs=1e-8) for i, s in want.items()) and max(got, key=got.get) == "d2"


def test_retrieval_modes(spark):
    sims = spark.createDataFrame([("q", f"d{i:03}", 0.9 - i / 1000) for i in range(300)], "query_id string, id string, similarity double")
    corpus = spark.createDataFrame([(f"d{i:03}", "s" if i < 290 else "t", "hadith" if i % 2 else "tafsir", "high" if i >= 250 else "unverified") for i in range(300)], "id string, source_id string, evidence_type string, confidence string")
    ids = lambda **k: [r.id for r in retrieval.retrieve(sims, corpus, **k).orderBy("rank").collect()]
    assert ids(k=3, compat=True) == ["d000", "d001", "d002"]
    assert ids(k=3, sources=("t",), compat=True) == [] and ids(k=3, sources=("t",)) == ["d290", "d291", "d292"]
    assert ids(k=2, types=("hadith",), least="high") == ["d251", "d253"]
    c = retrieval.consensus(retrieval.retrieve(sims, corpus, k=4)).collect()
    assert [(r.source_id, r.n) for r in c] == [("s", 4)]


def test_cosine_and_overlaps(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.7071, abs=1e-4), 0.0]
    with pytest.raises(PySparkException):
        d.select(X.cosine(F.col("a"), F.array(F.lit(1.0)))).collect()
    t = spark.createDataFrame([("the of in", "x"), ("the rope holds", "rope"), ("", "x")], "a string, b string")
    got = t.select(X.content_overlap(X.content_tokens(F.col("a")), X.content_tokens(F.col("b"))), X.token_overlap(X.tokens(F.col("a")), X.tokens(F.col("b")))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.5, pytest.approx(1 / 3)), (1.0, 0.0)]


def test_languages(spark):
    rows = [("hello", "en"), ("سلام عليكم", "ar"), ("پدر من", "fa"), ("لڑکا ہے", "ur"), ("123", "unknown"), ("", "unknown"), (None, "unknown"), ("abc سلا", "en")]
    d = spark.createDataFrame(rows, "t string, want string").withColumn("got", X.detect_language(F.col("t")))
    assert all(r.got == r.want for r in d.collect())
    assert {r.want: r[1] for r in d.select("want", X.cross_lingual(F.col("want"))).collect()}["ur"] is True


def test_citations_levels_and_scores(spark):
    cols = "evidence_type string, source_id string, surah int, ayah int, volume string, page string, hadith_number string, chapter string, confidence string"
    rows = [("quran", "quran", 1, 2, None, None, None, None, "high"), ("quran", "quran", 1, None, None, None, None, None, "high"), ("hadith", "k", None, None, "1", "", "7", None, "medium"), ("hadith", "k", None, None, None, "", None, "c", "low"), ("tafsir", "t", None, None, None, None, None, "c", "low"), ("tafsir", "", None, None, None, "3", None, None, None)]
    got = spark.createDataFrame(rows, cols).select(C.is_complete(F.col), C.reference(F.col), C.as_fact(F.col)).collect()
    assert [r[0] for r in got] == [True, False, True, False, True, False]
    assert [r[1] for r in got][:3] == ["Qur'an 1:2", "quran", "k, v1, h.7"] and got[4][1] == "t, ch.c"
    assert [bool(r[2]) for r in got] == [True, False, True, False, False, False]
    one = {k: F.lit(None).cast("double") for k in C.WEIGHTS}
    score = lambda **v: spark.range(1).select(C.source_score(one | {k: F.lit(x) for k, x in v.items()})).first()[0]
    assert score() == 0.0 and score(chain_availability=2.0) == 1.0 and score(scholarly_acceptance=1.0, translation_quality=0.0) == pytest.approx(0.22 / 0.37)
    bands = spark.createDataFrame([(0.8,), (0.79,), (0.6,), (0.35,), (0.34,)], "s double").select(C.band(F.col("s"))).collect()
    assert [r[0] for r in bands] == ["high", "medium", "medium", "low", "unverified"]
    with pytest.raises(PySparkException):
        spark.range(1).select(C.strict(F.lit("odd"), ("a",), "kind")).collect()


def test_claim_and_answer_problems(spark):
    d = spark.sql("select array(named_struct('complete', false)) as c")
    p = C.claim_problems(F.lit(""), F.col("c"), F.lit("high"))
    assert d.select(p).first()[0] == ["empty statement", "fact-level confidence without a complete citation"]
    out = d.select(C.answer_problems(F.array(F.struct(F.array().cast("array<string>").alias("problems")), F.struct(p.alias("problems"))))).first()[0]
    assert out[0] == "claim[1]: empty statement"


def test_chains_and_grades(spark):
    text = "Muhammad Bin Yahya<sup>asws</sup> narrated to us, from Ahmad (the elder), from his father, from Al-Hasan who has said: 'Be kind'"
    d = spark.createDataFrame([("a", 1, text), ("b", 2, "no chain here"), ("c", 3, "Ahmad from ibn Yahya who said x")], "id string, seen int, text string")
    got = {r.id: r for r in d.select("id", C.narrators(F.col("text")).alias("n"), C.matn(F.col("text")).alias("m")).collect()}
    assert got["a"].n == ["Muhammad Bin Yahya", "Ahmad", "his father", "Al-Hasan"] and got["a"].m == "Be kind'" and got["b"].n == [] and got["b"].m == ""
    found = narrators.mentions(d)
    top = narrators.top_narrators(found, 1).collect()
    assert [(r.key, r.mentions) for r in top] == [("ahmad", 2)] and found.where("name = 'his father'").count() == 0
    assert {r.key for r in narrators.lookup(found, "Yahya ibn Muhammad").collect()} == {"muhammad bin yahya"} and narrators.lookup(found, "hasa").count() == 1
    grades = spark.createDataFrame([("a", "sahih"), ("c", "daif")], "id string, grade string")
    assert {(r.key, r.grade): r.n for r in narrators.profile(found, grades).collect()}["ahmad", "daif"] == 1
    s = spark.createDataFrame([("Majlisi: ضعيف - Work; Other: good; free text",), (None,), ("A: x - y - z",)], "grade_source string")
    assert [[tuple(x) for x in r[0]] for r in s.select(C.grade_attributions(F.col("grade_source"))).collect()] == [[("Majlisi", "ضعيف", "Work"), ("Other", "good", ""), ("", "free text", "")], [], [("A", "x", "y - z")]]
    g = spark.createDataFrame([("كالصحيح",), ("غير معتبر",), ("ضعیف",), ("reliable",), ("?",)], "g string").select(C.classify_grade(F.col("g"))).collect()
    assert [r[0] for r in g] == ["sahih", "daif", "daif", "muwaththaq", "ungraded"]
    assert [spark.range(1).select(C.grade_confidence(F.array(*map(F.lit, x)).cast("array<string>"))).first()[0] for x in (["sahih", "daif"], ["sahih"], [])] == ["low", "high", "medium"]


def test_keys_of_names(spark):
    names = [("Muhammad Ibn Yahya", "muhammad bin yahya"), ("Ahmad b.Ali b. Zayd", "ahmad binali b zayd"), ("Al-Hasan,  al  Rida", "al hasan al rida"), ("Ja‘far<sup>as</sup> `Abd", "ja'far 'abd"), ("Ibn'Umar 7_x ab.c", "bin'umar x ab c"), ("", ""), (None, ""), ("ibnibn thibn", "ibnibn thibn")]
    d = spark.createDataFrame(names, "name string, key string").select("key", C.name_key(F.col("name")).alias("got"))
    assert all(r.got == r.key for r in d.collect())


def test_grounding_of_marked_sentences(spark):
    passages = ["the rope holds firm against storms", "rivers carry silt towards deltas"]
    text = "According to the evidence all is well. The rope holds firm. [1] Rivers carry silt [2]. Dragons guard golden mountains nearby. Rope storms firm [2]. See [3]."
    d = spark.createDataFrame([("a", text, passages), ("b", "", [])], "answer_id string, text string, passages array<string>")
    got = {r.answer_id: r for r in grounding.verify_synthesis(d).collect()}
    assert (got["a"].invented, got["a"].n_ungrounded, got["a"].n_uncited, got["a"].grounded) == ([3], 1, 1, False)
    assert got["b"].grounded and got["b"].invented == []


def test_evaluation(spark):
    found = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "z")], "query_id string, rank int, id string")
    gold = spark.createDataFrame([("q1", ["b", "c"]), ("q2", []), ("q3", ["x"]), ("q4", [])], "query_id string, relevant array<string>")
    got = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in evaluation.gold_metrics(found, gold, 5).collect()}
    assert got == {"q1": (0.5, 0.5, 0.5), "q2": (0.0, 1.0, 0.0), "q3": (0.0, 0.0, 0.0), "q4": (0.0, 1.0, 0.0)}
    assert evaluation.summary(evaluation.gold_metrics(found, gold.limit(0), 5)).first().mrr == 0.0
    call = lambda *v: spark.range(1).select(evaluation.recommendations(*map(F.lit, v))).first()[0]
    assert call(1.0, 1.0, 0.0, 1.0, 0, 5) == ["expand the gold set"] and len(call(0.1, 0.1, 0.5, 0.5, 3, 5)) == 5


def brute_chunks(text, most, overlap):
    out, buf = [], ""
    for p in (p.strip() for p in text.split("\n\n")):
        if not p:
            continue
        if len(p) > most:
            out += [buf, *(p[i : i + most] for i in range(0, len(p), most - overlap))]
            buf = ""
        elif len(buf) + len(p) + 2 <= most:
            buf = buf + "\n\n" + p if buf else p
        else:
            out.append(buf)
            buf = p
    return [c for c in [*out, buf] if c]


@pytest.mark.parametrize("text", ["", "a\n\nb", "x" * 99, "x" * 100, "x" * 101, "a" * 40 + "\n\n" + "b" * 57 + "\n\n" + "c" * 98 + "\n\n \n\n" + "d" * 250])
def test_chunks(spark, text):
    assert corpus_ops.chunk_text(text, 100, 20) == brute_chunks(text, 100, 20)
    d = spark.createDataFrame([("a", text), ("b", None)], "id string, text string")
    assert [r.chunk for r in corpus_ops.chunks(d, 100, 20).where("id = 'a'").orderBy("chunk_no").collect()] == brute_chunks(text, 100, 20)


def test_ordering_rules(spark):
    d = spark.createDataFrame([("v", i, n, p) for i, (n, p) in enumerate([(1, None), (5, "3"), (4, None), (6, None), (7, "9"), (2, None)])], "v string, o int, n int, page string")
    assert [r.n for r in corpus_ops.increasing(d, "v", "o", "n").orderBy("o").collect()] == [1, 5, 6, 7]
    assert [r.page for r in corpus_ops.fill_pages(d, "v", "o", "page").orderBy("o").collect()] == ["3", "3", "9", "9", "9", "9"]
    assert {r.n for r in corpus_ops.drop_isolated(d.where("n <> 2"), "v", "n").collect()} == {4, 5, 6, 7}
    f = spark.createDataFrame([("1", "b.pdf"), ("1", "aa_eng.pdf"), ("2", "long.pdf"), ("2", "x.pdf")], "volume string, name string")
    assert {(r.volume, r.name) for r in corpus_ops.preferred_files(f).collect()} == {("1", "aa_eng.pdf"), ("2", "x.pdf")}
    new = corpus_ops.only_new(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "id string, o int"), spark.createDataFrame([("a",)], "id string"), ["o"])
    assert [(r.id, r.o) for r in new.collect()] == [("b", 1)]
    parts = export.export_parts(spark.createDataFrame([("s", "x" * 6, None, None, c) for c in "abc"] + [("t", "y" * 30, 1, 1, "d")], "source_id string, text string, surah int, ayah int, id string"), 13)
    assert sorted(tuple(r) for r in parts.collect()) == [("s", 0, 2, 12), ("s", 1, 1, 6), ("t", 0, 1, 30)]
    assert spark.range(1).select(corpus_ops.id_numbers(F.lit("a-v10-h2"))).first()[0] == [10, 2]


def test_shortcuts_of_normalisation_and_languages_equal_the_whole_rules(spark):
    import random

    r = random.Random(3)
    signs = "ab Z \t\n\x1c\x85\u00a0\u2003\u00e9\u0301\u0640\u064b\u06d6\u08e5\u0fff\u0622\u0629\u06a9\u06f3\u0663\u0679\u067e\ufb51\u0000-9"
    texts = [None, "", " ", "  ", "a", " a  b ", "\u0660", "\u0fff", *("".join(r.choices(signs[: r.choice((6, 9, 14, 99))], k=r.randint(0, 25))) for _ in range(400))]
    t = F.col("t")
    old = F.translate(X.strip_tashkeel(F.regexp_replace(X.strip_tatweel(X.recompose(t, "NFC")), X.ANNOTATION, "")), X.FOLD_FROM, X.FOLD_TO)
    old = F.lower(F.regexp_replace(F.regexp_replace(old, f"{X.SPACE}+", " "), "^ | $", ""))
    latin, arabic = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit(X.ARABIC_SCRIPT))
    lang = F.when(t.isNull() | (latin + arabic == 0), "unknown").when(latin >= arabic, "en").when(t.rlike(f"[{X.URDU}]"), "ur").when(t.rlike(f"[{X.PERSIANATE}]"), "fa").otherwise("ar")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(X.search_form(t), old, X.detect_language(t), lang).collect()
    assert all(a == b and c == d for a, b, c, d in rows) and len({r[2] for r in rows}) == 5
    assert spark.range(1).select(F.lit(X.FOLD_FROM + X.TATWEEL).rlike(f"^{X.FOLDED}+$")).first()[0]


def test_feature_hash_buckets_makes_no_row_an_occurrence(spark):
    from loomspan.plans.queries import QUERIES

    plan = QUERIES["feature_hash_buckets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
