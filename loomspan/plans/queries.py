"""The query catalogue over the driver's tables. Each query reads its whole tables; see oracles.py for the SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as X
from ..functions.citations import bonus
from ..operators import answers, corpus_ops, evaluation, export, features, grounding, lectures, narrators, retrieval
from ..sources import records
from ..sources.corpus import bind, registry, source_number, table
from ..sources.files import html_text
from ..storage import checkpoint, shared_folder

_INDEXES: dict[tuple, str] = {}


def _normal(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(F.col(key).alias("id"), X.search_form(F.coalesce("text", F.lit(""))).alias("normal"))


def _index(spark: SparkSession, sf_dir: str) -> retrieval.TfidfIndex:
    """The corpus's index, built once a session and state of its files, then read."""
    at = F.struct("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time"))
    files = table(spark, sf_dir, "documents").select(F.xxhash64(at).alias("h")).distinct().agg(F.count("*"), F.sum(F.pmod("h", F.lit(1 << 40)))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *files)
    if key not in _INDEXES:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        retrieval.TfidfIndex.build(_normal(bind(spark, sf_dir)), path)
        _INDEXES[key] = path
    return retrieval.TfidfIndex.open(spark, _INDEXES[key])


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(table(spark, sf_dir, "benchmark").withColumn("id", F.concat(F.lit("q"), F.col("item_id").cast("string"))))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir).select("id", "source_id", "evidence_type", "confidence")


def _sims(spark: SparkSession, sf_dir: str, k: int, docs: DataFrame | None = None, floor: float | None = None) -> DataFrame:
    """What can be among the k best of each benchmark text (and part of docs)."""
    return _index(spark, sf_dir).nearest(_asks(spark, sf_dir), k, docs, floor)


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def normalize_text(spark, sf_dir):
    n = _normal(bind(spark, sf_dir))
    return n.select("id", F.length("normal").cast("long").alias("n_chars"), F.md5("normal").alias("digest"))


def token_counts(spark, sf_dir):
    t = _normal(bind(spark, sf_dir)).select("id", X.tokens(F.col("normal")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def char_trigram_counts(spark, sf_dir):
    t = _normal(bind(spark, sf_dir)).select(F.explode(X.trigrams(F.col("normal"))).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n"))


def feature_hash_buckets(spark, sf_dir):
    f = features.document_frequencies(_normal(bind(spark, sf_dir)))
    return f.groupBy(X.bucket(F.col("f"), retrieval.DIM).alias("bucket")).agg(F.count("*").alias("n"), F.sum(X.sign(F.col("f")).cast("long")).alias("signs"))


def idf_table(spark, sf_dir):
    return _six(_index(spark, sf_dir).idf.select(F.col("f").alias("feature"), "df", "idf"))


def tfidf_topk(spark, sf_dir):
    return _six(retrieval.top(_sims(spark, sf_dir, 10), 10, F.col("similarity")).select("query_id", "id", "similarity", "rank"))


def hashing_topk(spark, sf_dir):
    v, q = (features.hashing_vectors(x) for x in (_normal(bind(spark, sf_dir)), _asks(spark, sf_dir)))
    return _six(retrieval.top(features.nearest(v, q, 512, 10), 10, F.col("similarity")).select("query_id", "id", "similarity", "rank"))


def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    x = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("m"))
    q = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q")).select(F.col("label").alias("query_id"), "q")
    return _six(retrieval.dense_top(v, q))


def confidence_rerank(spark, sf_dir):
    return _six(retrieval.retrieve(_sims(spark, sf_dir, retrieval.candidates(5, False)), bind(spark, sf_dir), compat=True))


def retrieve_filtered_compat(spark, sf_dir):
    return _six(retrieval.retrieve(_sims(spark, sf_dir, retrieval.candidates(5, True)), bind(spark, sf_dir), types=("tafsir", "hadith"), least="low", compat=True))


def retrieve_filtered_exact(spark, sf_dir):
    kept = retrieval.filtered(_meta(spark, sf_dir), types=("tafsir", "hadith"), least="low").select("id")
    return _six(retrieval.retrieve(_sims(spark, sf_dir, retrieval.candidates(5, True), kept), bind(spark, sf_dir), types=("tafsir", "hadith"), least="low"))


def consensus_by_source(spark, sf_dir):
    return _six(retrieval.consensus(retrieval.retrieve(_sims(spark, sf_dir, retrieval.candidates(8, False)), bind(spark, sf_dir), k=8, compat=True)))


def compare_sources(spark, sf_dir):
    docs = retrieval.filtered(_meta(spark, sf_dir), least="low").select("id", F.col("source_id").alias("part"), bonus(F.col("confidence")).alias("bonus"))
    return _six(retrieval.compare(_sims(spark, sf_dir, 4, docs, 0.15), bind(spark, sf_dir)))


def multi_part_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.floor(F.col("item_id") / 3).alias("question_id"))
    found = retrieval.retrieve(_sims(spark, sf_dir, retrieval.candidates(6, True)), bind(spark, sf_dir), k=6, least="low", compat=True)
    return _six(retrieval.merge_parts(found, parts))


def extractive_answers(spark, sf_dir):
    """Three benchmark texts make a question of three parts."""
    b = table(spark, sf_dir, "benchmark").withColumn("question_id", F.floor(F.col("item_id") / 3))
    parts = b.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "question_id")
    asked = b.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), " ").alias("question"))
    corpus = bind(spark, sf_dir)
    found = retrieval.retrieve(_sims(spark, sf_dir, retrieval.candidates(6, True)), corpus, k=6, least="low", compat=True)
    out = answers.answers(found, parts, corpus.withColumn("reference", C.reference(F.col)), asked)
    return out.select("question_id", "language", F.size("claims").cast("long").alias("n_claims"), F.get("claims", F.lit(0))["reference"].alias("first"), F.md5("summary").alias("summary"), F.size("caveats").cast("long").alias("n_caveats"))


def question_parts(spark, sf_dir):
    """What the users of the conversations ask, in parts."""
    t = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(answers.decomposer()(F.coalesce("text", F.lit("")))).alias("part", "question"))
    return t.select("conv_id", "turn", "part", F.md5("question").alias("digest"))


def _by_type(spark, sf_dir):
    return _meta(spark, sf_dir).select("id", F.col("evidence_type").alias("part"))


def lecture_sections(spark, sf_dir):
    return _six(retrieval.lecture_sections(_sims(spark, sf_dir, 200, _by_type(spark, sf_dir)), bind(spark, sf_dir)))


def lecture_outline(spark, sf_dir):
    """The twelve sections of a lecture on each benchmark text."""
    corpus = bind(spark, sf_dir)
    found = retrieval.lecture_sections(_sims(spark, sf_dir, 200, _by_type(spark, sf_dir)), corpus)
    rows = lectures.outline(_asks(spark, sf_dir).select(F.col("id").alias("query_id")), found, corpus.withColumn("reference", C.reference(F.col)))
    cited = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["id"], e["reference"], e["confidence"])), "\n")
    return rows.select("query_id", "no", "title", "body", cited.alias("evidence"), F.md5("note").alias("note"), F.length(lectures.section_markdown()).alias("n_markdown"))


def lecture_pool(spark, sf_dir):
    return _six(retrieval.lecture_pool(retrieval.lecture_sections(_sims(spark, sf_dir, 200, _by_type(spark, sf_dir)), bind(spark, sf_dir))))


def crossref_links_all(spark, sf_dir):
    """Of every verse of the corpus."""
    corpus = bind(spark, sf_dir)
    with_normal = corpus.withColumn("normal", X.search_form(F.coalesce("text", F.lit(""))))
    ref = F.concat_ws(":", "surah", "ayah")
    verses = with_normal.where(F.col("surah").isNotNull()).select(F.concat(F.lit("v"), ref).alias("query_id"), "id", "normal", ref.alias("ref"))
    docs = _meta(spark, sf_dir).select("id", F.col("evidence_type").alias("part"), bonus(F.col("confidence")).alias("bonus")).where(F.col("part").isin("tafsir", "hadith", "quran"))
    sims = _index(spark, sf_dir).nearest(verses.select(F.col("query_id").alias("id"), F.col("id").alias("of")), 375, docs, then=15)
    return _six(retrieval.cross_references(sims, verses, with_normal))


def citation_completeness(spark, sf_dir):
    return bind(spark, sf_dir).select("id", "evidence_type", C.is_complete(F.col).alias("complete"), C.as_fact(F.col).alias("as_fact"))


def reference_string(spark, sf_dir):
    return bind(spark, sf_dir).select("id", C.reference(F.col).alias("reference"))


def unknown_sources(spark, sf_dir):
    return grounding.unknown_sources(bind(spark, sf_dir), registry(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("n"))


def _cited(spark, sf_dir):
    """Citations made up from passages: some with another page or number, some of absent sources, some by chapter alone."""
    d = bind(spark, sf_dir)
    third = F.col("doc_id") % 5
    return d.select(
        F.col("id").alias("cid"), F.when(third == 4, F.concat(F.lit("no_"), F.col("source_id"))).otherwise(F.col("source_id")).alias("source_id"), "evidence_type", "surah",
        F.when(third == 1, F.col("ayah") + 100000000).otherwise(F.col("ayah")).alias("ayah"), F.when(third == 1, F.concat(F.col("hadith_number"), F.lit("x"))).otherwise(F.col("hadith_number")).alias("hadith_number"),
        F.when(third == 2, F.lit(None).cast("string")).otherwise(F.col("page")).alias("page"), "volume", "chapter")


def passage_exists(spark, sf_dir):
    return grounding.passage_found(_cited(spark, sf_dir), bind(spark, sf_dir)).select("cid", "found")


def validate_citations(spark, sf_dir):
    v = grounding.validate_citations(_cited(spark, sf_dir), registry(spark, sf_dir), bind(spark, sf_dir))
    return v.select("cid", "complete", "source_known", "found", F.size("problems").cast("long").alias("n_problems"))


def source_coverage(spark, sf_dir):
    return _six(evaluation.source_coverage(bind(spark, sf_dir), registry(spark, sf_dir)))


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    claims = t.where("role = 'assistant'").select("answer_id", F.col("turn").alias("claim_no"), X.search_form(F.col("text")).alias("normal"))
    passages = t.where("role <> 'assistant'").select("answer_id", X.search_form(F.col("text")).alias("normal"))
    return claims, passages


def claim_overlap(spark, sf_dir):
    return _six(grounding.best_overlaps(*_turns(spark, sf_dir)))


def content_overlap(spark, sf_dir):
    claims, passages = _turns(spark, sf_dir)
    both = passages.groupBy("answer_id").agg(F.collect_list(X.content_tokens(F.col("normal"))).alias("p"))
    own = claims.join(both, "answer_id").select("answer_id", "claim_no", X.content_tokens(F.col("normal")).alias("c"), F.array_distinct(F.flatten("p")).alias("p"))
    return _six(own.select("answer_id", "claim_no", F.size("c").cast("long").alias("n"), X.content_overlap(F.col("c"), F.col("p")).alias("overlap")))


def answer_grounding(spark, sf_dir):
    return _six(grounding.answer_grounding(grounding.best_overlaps(*_turns(spark, sf_dir))))


def judge_claims(spark, sf_dir):
    return _six(grounding.judge(*_turns(spark, sf_dir)))


def _claim_citations(spark, sf_dir):
    """Each assistant turn cites one passage by number, with that passage's level as its own; some cite passages that aren't there."""
    claims = _turns(spark, sf_dir)[0].select("answer_id", "claim_no").distinct()
    cited = claims.withColumn("cid", F.concat(F.lit("doc_"), (F.col("answer_id") * 7 + F.col("claim_no")).cast("string")))
    levels = bind(spark, sf_dir).select(F.col("id").alias("cid"), "confidence")
    return cited.join(levels, "cid", "left")


def _checks(spark, sf_dir):
    return grounding.validate_citations(_cited(spark, sf_dir), registry(spark, sf_dir), bind(spark, sf_dir))


def answer_report(spark, sf_dir):
    cited = _claim_citations(spark, sf_dir)
    return grounding.answer_report(grounding.best_overlaps(*_turns(spark, sf_dir)), cited.select("answer_id", "claim_no", "confidence"), cited.select("answer_id", "claim_no", "cid"), _checks(spark, sf_dir))


def answer_records(spark, sf_dir):
    """Conversations as answers in JSON: what was asked first, each assistant's turn as a claim with the passage it cites. The record is read again."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    cid = F.concat(F.lit("doc_"), (F.col("conv_id") * 7 + F.col("turn")).cast("string"))
    corpus = bind(spark, sf_dir)
    fields = [c for c in records.CITATION.names if c in corpus.columns]
    cited = corpus.select(F.col("id").alias("cid"), "confidence", "evidence_type", F.struct(*fields).alias("citation"), C.as_fact(F.col).alias("fact"))
    none = F.array().cast(f"array<{dict(cited.dtypes)['citation']}>")
    claims = turns.where("role = 'assistant'").withColumn("cid", cid).join(cited, "cid", "left").select("conv_id", "turn", F.struct(
        F.col("text").alias("statement"), "evidence_type", F.coalesce("confidence", F.lit("unverified")).alias("confidence"), F.lit(None).cast("string").alias("view_status"),
        F.when(F.col("citation").isNotNull(), F.array("citation")).otherwise(none).alias("citations"), F.coalesce("fact", F.lit(False)).alias("asserted_as_fact")).alias("claim"))
    held = claims.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "claim"))), lambda x: x["claim"]).alias("claims"))
    text, no_list = F.lit(None).cast("string"), F.array().cast("array<string>")
    whole = asked.join(held, "conv_id").select("conv_id", records.to_json(F.struct(
        "question", no_list.alias("sub_questions"), X.detect_language(F.col("question")).alias("query_language"), text.alias("answer_language"), text.alias("refined_query"), text.alias("summary"), text.alias("generated_on"),
        claims_as(F.col("claims")).alias("claims"), no_list.alias("caveats"))).alias("value"))
    again = records.read_answers(whole.withColumn("digest", F.md5("value")), place="conv_id")
    return again.select("conv_id", "digest", F.size("claims").cast("long").alias("n_claims"), F.size(F.filter("claims", lambda c: c["asserted_as_fact"])).cast("long").alias("n_facts"))


def claims_as(claims):
    """Claims whose citations have some fields, as claims whose citations have all."""
    full = lambda c: F.struct(*[(c[f.name] if f.name in _CITED else F.lit(None)).cast(f.dataType).alias(f.name) for f in records.CITATION])
    return F.transform(claims, lambda x: x.withField("citations", F.transform(x["citations"], full)))


_CITED = ("source_id", "evidence_type", "surah", "ayah", "volume", "page", "hadith_number", "chapter")


def citation_accuracy(spark, sf_dir):
    return _six(evaluation.citation_accuracy(_claim_citations(spark, sf_dir).select("answer_id", "cid"), _checks(spark, sf_dir)))


def evaluate(spark, sf_dir):
    """All measures over the gold queries: passages found without filters, and answers made of those of low confidence or more."""
    corpus, k = bind(spark, sf_dir), 6
    texts = corpus.select("id", "text", X.search_form(F.coalesce("text", F.lit(""))).alias("normal"))
    breadth = retrieval.candidates(k, True)
    sims = checkpoint(retrieval.top(_sims(spark, sf_dir, breadth), breadth, F.col("similarity")).drop("rank"))  # read by all that follows: the products are made once
    found = checkpoint(retrieval.retrieve(sims, corpus, k=k, compat=True))
    said = retrieval.retrieve(sims, corpus, k=k, least="low", compat=True).where("similarity >= 0.15")
    few = F.broadcast(found.select("id").union(said.select("id")).distinct())  # k a gold query and measure at most
    texts = checkpoint(texts.join(few, "id", "left_semi"))
    claims = checkpoint(said.select(F.col("query_id").alias("answer_id"), F.col("rank").alias("claim_no"), "id").join(texts, "id"))
    passages = found.select(F.col("query_id").alias("answer_id"), "rank", "id").join(texts, "id")
    grounded = grounding.answer_grounding(grounding.best_overlaps(claims, passages))
    accuracy = evaluation.citation_accuracy(claims.select("answer_id", F.col("id").alias("cid")), _checks(spark, sf_dir))
    held = claims.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "text"))).alias("p"))
    written = held.select("answer_id", answers.extract(F.col("p")).alias("text"), F.transform("p", lambda x: x["text"]).alias("passages"))
    kept = grounding.verify_synthesis(written).select("answer_id", "grounded")
    return evaluation.evaluate(evaluation.gold_metrics(found, _gold(spark, sf_dir), k), accuracy, grounded, kept, evaluation.source_coverage(corpus, registry(spark, sf_dir)))


def reading_list(spark, sf_dir):
    sections = lecture_sections(spark, sf_dir)
    return retrieval.reading_list(sections, bind(spark, sf_dir).select("id", "source_id"))


def hallucination_rate(spark, sf_dir):
    g = grounding.answer_grounding(grounding.best_overlaps(*_turns(spark, sf_dir)))
    return g.agg(F.count("*").alias("answers"), F.sum("n_weak").alias("weak"), F.round(F.avg("hallucination"), 6).alias("rate"))


def _synthesised(spark, sf_dir):
    """Answers: a conversation's assistant turns, each followed by a marker; passages: its other turns."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), "turn", "role", X.compose(F.coalesce("text", F.lit(""))).alias("text"))
    said = t.where("role = 'assistant'").groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(x["text"], F.lit(" ["), x["turn"].cast("string"), F.lit("]."))), " ").alias("text"))
    rest = t.where("role <> 'assistant'").groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("passages"))
    return said.join(rest, "answer_id", "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))


def verify_markers(spark, sf_dir):
    s = _synthesised(spark, sf_dir)
    bad, good = grounding.marker_check(F.col("text"), F.size("passages"))
    joined = lambda a: F.array_join(F.transform(a, lambda m: m.cast("string")), ",")
    return s.select("answer_id", joined(bad).alias("invented"), joined(good).alias("valid"))


def verify_synthesis(spark, sf_dir):
    v = grounding.verify_synthesis(_synthesised(spark, sf_dir))
    return v.select("answer_id", F.array_join(F.transform("invented", lambda m: m.cast("string")), ",").alias("invented"), "n_ungrounded", "n_uncited", "grounded")


def detect_language(spark, sf_dir):
    lang = X.detect_language(F.col("text"))
    return bind(spark, sf_dir).select("id", lang.alias("language"), X.language_name(lang).alias("name"), X.cross_lingual(lang).alias("cross_lingual"))


def language_mix(spark, sf_dir):
    return bind(spark, sf_dir).groupBy("source_id", X.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


def dedupe_documents(spark, sf_dir):
    return corpus_ops.dedupe_documents(bind(spark, sf_dir), ["doc_id"]).select("id")


def near_duplicate_keys(spark, sf_dir):
    n = _normal(bind(spark, sf_dir)).groupBy(F.sha2("normal", 256).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return n.where("n > 1")


def chunk_text(spark, sf_dir):
    c = corpus_ops.chunks(bind(spark, sf_dir).select("id", "text"))
    return c.select("id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def facets(spark, sf_dir):
    return corpus_ops.facets(bind(spark, sf_dir))


def source_types(spark, sf_dir):
    own = corpus_ops.source_types(bind(spark, sf_dir))
    return own.join(F.broadcast(registry(spark, sf_dir)), "source_id", "left").select("source_id", "n", "types", F.coalesce("title", "source_id").alias("title"))


def _narrations(spark, sf_dir):
    """Chains made up from a passage's first words, and a grading by its source."""
    d = bind(spark, sf_dir)
    w = F.split(F.col("text"), r"[^A-Za-z]+")
    name = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    chain = F.concat(name(0), F.lit(" narrated to us ibn "), name(1), F.lit(", from his father, from Al-"), name(2), F.lit(" (a note) who said: "), name(3))
    grade = F.concat(F.lit("Reviewer "), F.col("language"), F.lit(": "), F.col("confidence"), F.lit(" - work "), F.col("source_id"), F.lit("; noted"))
    return d.select("id", F.col("doc_id").alias("seen"), chain.alias("text"), "confidence", grade.alias("grade_source"))


def top_narrators(spark, sf_dir):
    return narrators.top_narrators(narrators.mentions(_narrations(spark, sf_dir)))


def narrator_lookup(spark, sf_dir):
    return narrators.lookup(narrators.mentions(_narrations(spark, sf_dir)), "bin the").select("id", "position", "key")


def narrator_profile(spark, sf_dir):
    t = _narrations(spark, sf_dir)
    return narrators.profile(narrators.mentions(t), t.select("id", F.col("confidence").alias("grade")))


def grade_summary(spark, sf_dir):
    return narrators.grade_summary(_narrations(spark, sf_dir))


def _assessed(spark, sf_dir):
    d = bind(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), *[F.avg((F.col("confidence") == c).cast("double")).alias(c) for c in C.RANK])
    n = source_number(F.col("source_id"))
    values = {"scholarly_acceptance": F.col("high") * 2, "chain_availability": F.when(n % 3 != 0, F.lit(0.9)), "publisher_credibility": F.lit(1.0) - F.col("low"), "academic_references": F.when(n % 2 == 0, F.lit(0.25)), "community_acceptance": F.lit(None).cast("double"), "original_language": F.col("medium") * 10, "translation_quality": F.col("unverified")}
    return d.withColumns(values)


def source_score(spark, sf_dir):
    s = _assessed(spark, sf_dir).withColumn("score", C.source_score({k: F.col(k) for k in C.WEIGHTS}))
    return _six(s.select("source_id", "score", C.band(F.round("score", 9)).alias("confidence")))


def review_queue(spark, sf_dir):
    return _six(corpus_ops.review_queue(source_score(spark, sf_dir)))


def manifest_status(spark, sf_dir):
    even = bind(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))
    expected = even.select("source_id", (F.col("n") + source_number(F.col("source_id")) % 2).alias("expected")).union(spark.range(1).select(F.lit("src_absent"), F.lit(5).cast("long")))
    return corpus_ops.manifest_status(expected, bind(spark, sf_dir))


def iteration_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("iteration")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").cast("double").alias("events"))
    return _six(evaluation.deltas(e, ["mean_value", "events"]))


def _gold(spark, sf_dir):
    """A benchmark item's relevant documents are those that contain its text. The items are a stated query set of bounded size."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("t"))
    held = bind(spark, sf_dir).select("id", "text").join(F.broadcast(items), F.col("text").contains(F.col("t")))
    own = held.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("relevant"))
    return items.select("query_id").join(own, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<string>")))


def gold_metrics(spark, sf_dir):
    found = retrieval.retrieve(_sims(spark, sf_dir, retrieval.candidates(10, False)), bind(spark, sf_dir), k=10, compat=True)
    return _six(evaluation.gold_metrics(found, _gold(spark, sf_dir), 10))


def mrr(spark, sf_dir):
    return evaluation.summary(gold_metrics(spark, sf_dir))


def export_parts(spark, sf_dir):
    return export.export_parts(bind(spark, sf_dir), 50_000)


def export_index(spark, sf_dir):
    """The files that an export of at most 100 kB a file would write."""
    docs = bind(spark, sf_dir)
    sizes = docs.select("source_id", "surah", "ayah", "id", (F.octet_length(export.passage(docs)) + 2).alias("size"))  # an index needs no texts
    return export.index(export.in_parts(sizes, F.col("size"), 100_000), registry(spark, sf_dir))


def page_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def isolated_numbers(spark, sf_dir):
    rows = bind(spark, sf_dir).select(F.col("source_id").alias("volume"), F.length("text").alias("number"))
    return corpus_ops.drop_isolated(rows, "volume", "number").groupBy("volume").agg(F.count("*").alias("n"))


def increasing_refs(spark, sf_dir):
    rows = bind(spark, sf_dir).select("id", F.col("source_id").alias("volume"), "doc_id", F.length("text").alias("number"))
    return corpus_ops.increasing(rows, "volume", "doc_id", "number").select("id", "volume", "number")


def page_fill(spark, sf_dir):
    return corpus_ops.fill_pages(bind(spark, sf_dir).select("id", "source_id", "doc_id", "page"), "source_id", "doc_id", "page").select("id", "page")


def trusted_volumes(spark, sf_dir):
    rows = bind(spark, sf_dir).select(F.col("source_id").alias("volume"), "doc_id", F.when(source_number(F.col("source_id")) % 2 == 0, F.col("doc_id")).otherwise(F.length("text")).cast("long").alias("number"))
    return corpus_ops.trusted_volumes(rows, "volume", "doc_id", "number", spread=200).groupBy("volume").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    normalize_text, token_counts, char_trigram_counts, feature_hash_buckets, idf_table, tfidf_topk, hashing_topk, dense_topk, confidence_rerank, retrieve_filtered_compat, retrieve_filtered_exact,
    consensus_by_source, compare_sources, multi_part_merge, extractive_answers, question_parts, lecture_sections, lecture_outline, lecture_pool, crossref_links_all, citation_completeness, reference_string, unknown_sources, passage_exists, validate_citations,
    source_coverage, claim_overlap, content_overlap, answer_grounding, judge_claims, answer_report, answer_records, citation_accuracy, evaluate, reading_list, hallucination_rate, verify_markers, verify_synthesis, detect_language, language_mix, dedupe_documents, near_duplicate_keys,
    chunk_text, facets, source_types, top_narrators, narrator_lookup, narrator_profile, grade_summary, source_score, review_queue, manifest_status, iteration_deltas, gold_metrics, mrr, export_parts, export_index,
    page_text, isolated_numbers, increasing_refs, page_fill, trusted_volumes)}
