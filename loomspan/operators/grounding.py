"""Grounding: do claims follow from passages, do citations resolve, are marked sentences entailed by what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.citations import given, is_complete, rank, reference


def unknown_sources(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """Citations of sources that aren't registered (left anti join)."""
    return citations.join(registry.select("source_id"), "source_id", "left_anti")


def passage_found(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """citations and found: true or false, or null if the corpus has no passage of the source.

    citations(cid, source_id, evidence_type, surah, ayah, hadith_number, page, volume). A verse is found by its two numbers, others by the
    locators given (number, page, volume), of which there must be one; a chapter alone finds nothing. Each kind of
    citation is an equi-join on what it gives, so no source's passages meet all of its citations.
    """
    passages = corpus.select("source_id", "surah", "ayah", "hadith_number", "page", "volume")
    present = passages.select("source_id").distinct().withColumn("_present", F.lit(True))
    verses = passages.select("source_id", "surah", "ayah").where(F.col("surah").isNotNull() & F.col("ayah").isNotNull()).distinct()
    hits = citations.where(F.col("evidence_type") == "quran").join(verses, ["source_id", "surah", "ayah"], "left_semi").select("cid")
    locators = ("hadith_number", "page", "volume")
    other = citations.where(F.col("evidence_type") != "quran")
    for mask in range(1, 8):
        own = [c for i, c in enumerate(locators) if mask >> i & 1]
        cond = F.lit(True)
        for c in locators:
            cond = cond & (given(F.col(c)) if c in own else F.col(c).isNull())
        hits = hits.union(other.where(cond).join(passages.select("source_id", *own).distinct(), ["source_id", *own], "left_semi").select("cid"))
    found = hits.distinct().withColumn("_hit", F.lit(True))
    out = citations.join(found, "cid", "left").join(present, "source_id", "left")
    return out.withColumn("found", F.when(F.col("_present").isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce("_hit", F.lit(False)))).drop("_hit", "_present")


def validate_citations(citations: DataFrame, registry: DataFrame, corpus: DataFrame) -> DataFrame:
    """(cid, complete, source_known, found, problems)."""
    known = registry.select("source_id").distinct().withColumn("_known", F.lit(True))
    out = passage_found(citations, corpus).join(known, "source_id", "left")
    c = F.col
    where = reference(c)
    checks = F.array(F.when(~is_complete(c), F.concat(F.lit("incomplete locators for "), where)), F.when(c("_known").isNull(), F.concat(F.lit("unregistered source "), c("source_id"))), F.when(~c("found"), F.concat(F.lit("passage not in corpus: "), where)))
    return out.select("cid", is_complete(c).alias("complete"), c("_known").isNotNull().alias("source_known"), "found", F.filter(checks, lambda x: x.isNotNull()).alias("problems"))


def best_overlaps(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, claim_no, best): each claim's largest share of tokens in one passage of its answer; 0 without passages.

    claims(answer_id, claim_no, normal), passages(answer_id, normal); an answer's passages are gathered to its claims as one array."""
    held = passages.groupBy("answer_id").agg(F.collect_list(X.tokens(F.col("normal"))).alias("_p"))
    own = claims.select("answer_id", "claim_no", X.tokens(F.col("normal")).alias("_t")).join(held, "answer_id", "left")
    best = F.aggregate(F.coalesce("_p", F.array().cast("array<array<string>>")), F.lit(0.0), lambda m, p: F.greatest(m, X.token_overlap(F.col("_t"), p)))
    return own.select("answer_id", "claim_no", best.alias("best"))


def answer_grounding(best: DataFrame, least: float = 0.25) -> DataFrame:
    """(answer_id, n_claims, n_weak, weakest, grounded, hallucination)."""
    weak = F.sum((F.col("best") < least).cast("long"))
    out = best.groupBy("answer_id").agg(F.count("*").alias("n_claims"), weak.alias("n_weak"), F.round(F.min("best"), 9).alias("weakest"))
    return out.withColumn("grounded", F.col("n_weak") == 0).withColumn("hallucination", F.round(F.col("n_weak") / F.col("n_claims"), 9))


def judge(claims: DataFrame, passages: DataFrame, least: float = 0.2) -> DataFrame:
    """(answer_id, claim_no, support, supported): each claim's largest share of content words in one passage of its answer; 0 without passages.

    claims(answer_id, claim_no, normal), passages(answer_id, normal), as for best_overlaps(). A model's judgement has the same columns."""
    held = passages.groupBy("answer_id").agg(F.collect_list(X.content_tokens(F.col("normal"))).alias("_p"))
    own = claims.select("answer_id", "claim_no", X.content_tokens(F.col("normal")).alias("_t")).join(held, "answer_id", "left")
    best = F.aggregate(F.coalesce("_p", F.array().cast("array<array<string>>")), F.lit(0.0), lambda m, p: F.greatest(m, X.content_overlap(F.col("_t"), p)))
    return own.select("answer_id", "claim_no", best.alias("support")).withColumn("supported", F.col("support") >= least)


def verdicts(reply: Column, n: Column) -> Column:
    """Array of n booleans out of a model's lines such as `2: supported`; what no line names isn't supported, the last line on a claim holds."""
    lines = F.split(reply, r"\r?\n")
    line = r"(?i)^\s*(\d{1,9})\s*[:.)-]\s*(supported|unsupported)\b.*$"
    said = F.transform(F.filter(lines, lambda x: x.rlike(line)), lambda x: F.struct(F.regexp_extract(x, line, 1).cast("int").alias("no"), (F.lower(F.regexp_extract(x, line, 2)) == "supported").alias("yes")))
    last = lambda i: F.element_at(F.filter(said, lambda s: s["no"] == i), -1)["yes"]
    one = lambda i: F.when(F.exists(said, lambda s: s["no"] == i), last(i)).otherwise(F.lit(False))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(one(i), F.lit(False)))).otherwise(F.array().cast("array<boolean>"))


def answer_report(best: DataFrame, claims: DataFrame, citations: DataFrame, checks: DataFrame, least: float = 0.25) -> DataFrame:
    """(answer_id, n_claims, n_weak, n_overstated, n_citation_problems, grounded) of answers with claims.

    An answer is grounded if no claim's overlap is under `least`, none of medium or high confidence lacks a complete citation, and no citation
    has a problem. best is best_overlaps(), claims(answer_id, claim_no, confidence), citations(answer_id, claim_no, cid), checks
    validate_citations() of the cids; a cid without a check is no citation. An answer without claims isn't in best, and so not grounded."""
    keys = ["answer_id", "claim_no"]
    judged = checks.select("cid", "complete", F.size("problems").cast("long").alias("n"))
    cited = citations.join(judged, "cid").groupBy(*keys).agg(F.max("complete").alias("complete"), F.sum("n").alias("problems"))
    rows = best.join(claims, keys, "left").join(cited, keys, "left")
    overstated = F.coalesce((rank(F.col("confidence")) >= 2) & ~F.coalesce("complete", F.lit(False)), F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy("answer_id").agg(F.count("*").alias("n_claims"), count(F.col("best") < least).alias("n_weak"), count(overstated).alias("n_overstated"), F.sum(F.coalesce("problems", F.lit(0).cast("long"))).alias("n_citation_problems"))
    return out.withColumn("grounded", F.col("n_weak") + F.col("n_overstated") + F.col("n_citation_problems") == 0)


def marker_check(text: Column, n: Column) -> tuple[Column, Column]:
    """(invented, valid) distinct sorted markers of a text, given how many passages it may cite."""
    own = F.array_sort(F.array_distinct(X.markers(text)))
    fits = lambda m: (m >= 1) & (m <= n)
    return F.filter(own, lambda m: ~fits(m)), F.filter(own, fits)


def verify_synthesis(answers: DataFrame, least: float = 0.2, words: int = 4) -> DataFrame:
    """(answer_id, invented, n_ungrounded, n_uncited, grounded) of answers(answer_id, text, passages array<string>).

    A sentence with valid markers must share `least` of its content words with a passage it cites; one without, of `words` content words
    or more and not a framing phrase, with any passage that the text cites."""
    n = F.size("passages")
    invented, valid = marker_check(F.col("text"), n)
    content = lambda t: X.content_tokens(X.normalize_for_search(t))
    base = answers.select("answer_id", "text", F.transform("passages", content).alias("_p"), invented.alias("invented"), valid.alias("_cited"))
    rows = base.select("answer_id", "invented", "_p", "_cited", F.explode_outer(X.sentences(F.col("text"))).alias("s"))
    bare = F.regexp_replace("s", r"\[(\d+)\]", "")
    rows = rows.withColumn("_own", F.filter(X.markers(F.col("s")), lambda m: (m >= 1) & (m <= F.size("_p")))).withColumn("_c", content(F.col("s"))).withColumn("_n", F.size(content(bare)))
    best = lambda ms: F.aggregate(ms, F.lit(0.0), lambda a, m: F.greatest(a, X.content_overlap(F.col("_c"), F.element_at(F.col("_p"), m.cast("int")))))
    marked = F.size("_own") > 0
    rows = rows.withColumn("_ungrounded", marked & (best(F.col("_own")) < least)).withColumn("_uncited", ~marked & (F.col("_n") >= words) & ~X.boilerplate(F.col("s")) & (best(F.col("_cited")) < least))
    out = rows.groupBy("answer_id").agg(F.first("invented").alias("invented"), F.sum(F.coalesce(F.col("_ungrounded").cast("long"), F.lit(0))).alias("n_ungrounded"), F.sum(F.coalesce(F.col("_uncited").cast("long"), F.lit(0))).alias("n_uncited"))
    return out.withColumn("grounded", (F.size("invented") == 0) & (F.col("n_ungrounded") == 0) & (F.col("n_uncited") == 0))
