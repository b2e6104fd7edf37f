"""DuckDB SQL that must give the rows of the query of the same name (queries.py)."""

from __future__ import annotations

from ..functions import citations as C
from ..functions import text as X
from ..operators.lectures import OUTLINE
from ..sources.corpus import CITATION

STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def norm(x: str) -> str:
    """Search normalisation of a text expression."""
    out = f"regexp_replace(replace(nfc_normalize(coalesce({x}, '')), '{X.TATWEEL}', ''), '{X.ANNOTATION}', '', 'g')"
    out = f"translate(regexp_replace({out}, '{X.TASHKEEL}', '', 'g'), '{X.FOLD_FROM}', '{X.FOLD_TO}')"
    return f"lower(regexp_replace(regexp_replace({out}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g'))"


def content(n: str) -> str:
    return f"list_distinct(list_filter(string_split({n}, ' '), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t)))"


def common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


TYPES = "[" + ", ".join(f"'{t}'" for t in C.EVIDENCE_TYPES) + "]"
CORPUS = f"""corpus AS (
  SELECT doc_id, 'doc_' || doc_id AS id, text, source AS source_id, et AS evidence_type, confidence, lang AS language,
    CASE WHEN et = 'quran' THEN sn + 1 END AS surah, CASE WHEN et = 'quran' THEN doc_id::INT END AS ayah, NULL::VARCHAR AS volume,
    CASE WHEN lang <> 'es' THEN (doc_id // 10)::VARCHAR END AS page, CASE WHEN et = 'hadith' THEN doc_id::VARCHAR END AS hadith_number, CASE WHEN lang <> 'de' THEN lang END AS chapter
  FROM (SELECT d.*, regexp_extract(source, '(\\d+)', 1)::INT AS sn, {TYPES}[regexp_extract(source, '(\\d+)', 1)::INT % 7 + 1] AS et,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 AND toxic = 1 THEN 'medium' WHEN quality = 0 AND toxic = 0 THEN 'low' ELSE 'unverified' END AS confidence
    FROM documents d LEFT JOIN labels USING (doc_id)))"""
REGISTRY = """own AS (SELECT DISTINCT source AS source_id, regexp_extract(source, '(\\d+)', 1)::INT AS n FROM documents),
registry AS (SELECT source_id, 'Title of ' || source_id AS title FROM (SELECT source_id FROM own WHERE n < (SELECT max(n) FROM own) UNION ALL SELECT 'src_absent'))"""
NORMAL = f"normal AS (SELECT id, {norm('text')} AS n FROM corpus)"


def grams(table: str, name: str, prefixed: bool = True) -> str:
    """CTEs name(id, f, tf) of table(id, n)."""
    w, c = ("'w:' || ", "'c:' || ") if prefixed else ("", "")
    return f"""{name}_c AS (SELECT id, n, string_split(replace(n, ' ', '_'), '') AS c FROM {table} WHERE n <> ''),
{name} AS (SELECT id, f, count(*) AS tf FROM (
  SELECT id, {w}t AS f FROM (SELECT id, unnest(string_split(n, ' ')) AS t FROM {table}) WHERE t <> '' UNION ALL
  SELECT id, {c}g FROM (SELECT id, unnest(CASE WHEN len(c) < 3 THEN [array_to_string(c, '')] ELSE list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) END) AS g FROM {name}_c)) GROUP BY id, f)"""


BUCKET = "(('0x' || substr(md5(f), 1, 8))::UBIGINT % {dim})::INT"
SIGN = "(CASE WHEN substr(md5(f), 10, 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END)"


def vectors(weighted: str, name: str, dim: int = 2048) -> str:
    """CTE name(id, bucket, w) of weighted(id, f, w)."""
    return f"""{name}_h AS (SELECT f, {BUCKET.format(dim=dim)} AS bucket, {SIGN} AS sg FROM (SELECT DISTINCT f FROM {weighted})),
{name}_s AS (SELECT id, bucket, sum(w * sg) AS w FROM {weighted} JOIN {name}_h USING (f) GROUP BY id, bucket),
{name} AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_s WHERE w <> 0)"""


ASKS = f"asks AS (SELECT 'q' || item_id AS id, {norm('text')} AS n FROM benchmark)"
IDF = f"""{NORMAL}, {grams('normal', 'tf')},
idf AS (SELECT f, count(*) AS df, ln(((SELECT count(*) FROM corpus) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tf GROUP BY f)"""


def sims(asks: str = ASKS) -> str:
    return f"""{CORPUS}, {IDF}, dw AS (SELECT id, f, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (f)), {vectors('dw', 'dv')},
{asks}, {grams('asks', 'qf')},
qw AS (SELECT id, f, (1 + ln(tf)) * coalesce(idf, ln((SELECT count(*) FROM corpus) + 1.0) + 1.0) AS w FROM qf LEFT JOIN idf USING (f)), {vectors('qw', 'qv')},
sims AS (SELECT q.id AS query_id, d.id, round(sum(q.w * d.w), 9) AS similarity FROM dv d JOIN qv q USING (bucket) GROUP BY 1, 2)"""


BONUS = "CASE confidence " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.BONUS.items()) + " ELSE 0 END"
RANK = "CASE confidence " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.RANK.items()) + " END"


def retrieve(k: int, cond: str = "TRUE", breadth: int | None = None, compat: bool = False) -> str:
    """CTE found(query_id, rank, id, source_id, evidence_type, confidence, similarity, score)."""
    b = breadth or max(25 * k, 200)
    src, where = ("sims JOIN corpus USING (id)", "TRUE") if compat else (f"sims JOIN (SELECT * FROM corpus WHERE {cond}) USING (id)", "TRUE")
    return f"""cand AS (SELECT query_id, id, source_id, evidence_type, confidence, similarity, round(similarity + {BONUS}, 9) AS score FROM {src} WHERE {where} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= {b}),
found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, * EXCLUDE (query_id) FROM cand WHERE {cond if compat else 'TRUE'} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


FOUND = "SELECT query_id, rank, id, source_id, evidence_type, confidence, round(similarity, 6) AS similarity, round(score, 6) AS score FROM found"
FILTER = f"evidence_type IN ('tafsir', 'hadith') AND {RANK} >= 1"
GIVEN = "(coalesce({0}::VARCHAR, '') <> '')"
g = GIVEN.format
COMPLETE = f"CASE WHEN evidence_type = 'quran' THEN surah IS NOT NULL AND ayah IS NOT NULL WHEN evidence_type = 'hadith' THEN {g('source_id')} AND ({g('hadith_number')} OR {g('page')} OR {g('volume')}) ELSE {g('source_id')} AND ({g('page')} OR {g('volume')} OR {g('chapter')}) END"
CITED = """cited AS (SELECT id AS cid, CASE WHEN doc_id % 5 = 4 THEN 'no_' || source_id ELSE source_id END AS source_id, evidence_type, surah, CASE WHEN doc_id % 5 = 1 THEN ayah + 100000000 ELSE ayah END AS ayah,
  CASE WHEN doc_id % 5 = 1 THEN hadith_number || 'x' ELSE hadith_number END AS hadith_number, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE page END AS page, volume, chapter FROM corpus)"""
EXISTS = f"""pe AS (SELECT c.*, CASE WHEN c.source_id NOT IN (SELECT source_id FROM corpus) THEN NULL WHEN evidence_type = 'quran' THEN EXISTS (SELECT 1 FROM corpus d WHERE d.source_id = c.source_id AND d.surah = c.surah AND d.ayah = c.ayah)
  ELSE ({g('hadith_number')} OR {g('page')} OR {g('volume')}) AND EXISTS (SELECT 1 FROM corpus d WHERE d.source_id = c.source_id AND coalesce(d.hadith_number = c.hadith_number, c.hadith_number IS NULL) AND coalesce(d.page = c.page, c.page IS NULL) AND coalesce(d.volume = c.volume, c.volume IS NULL)) END AS found FROM cited c)"""
TURNS = f"""t AS (SELECT conv_id AS answer_id, turn, role, coalesce(text, '') AS text, {norm('text')} AS n FROM conversations),
cl AS (SELECT answer_id, turn AS claim_no, list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '')) AS t, n FROM t WHERE role = 'assistant'),
pa AS (SELECT answer_id, string_split(n, ' ') AS p, n FROM t WHERE role <> 'assistant'),
best AS (SELECT cl.answer_id, claim_no, max(CASE WHEN len(t) = 0 OR p IS NULL THEN 0.0 ELSE {common('t', 'p')}::DOUBLE / len(t) END) AS best FROM cl LEFT JOIN pa USING (answer_id) GROUP BY 1, 2)"""
GROUNDED = "SELECT answer_id, count(*) AS n_claims, sum(CASE WHEN best < 0.25 THEN 1 ELSE 0 END)::BIGINT AS n_weak, round(min(best), 6) AS weakest FROM best GROUP BY 1"
SYN = """sy AS (SELECT answer_id, string_agg(text || ' [' || turn || '].', ' ' ORDER BY turn, text) AS text FROM (SELECT conv_id AS answer_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant') GROUP BY 1),
ps AS (SELECT answer_id, list(text ORDER BY turn, text) AS p FROM (SELECT conv_id AS answer_id, turn, coalesce(text, '') AS text FROM conversations WHERE role <> 'assistant') GROUP BY 1),
sp AS (SELECT answer_id, text, coalesce(p, []) AS p, list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT) AS m FROM sy LEFT JOIN ps USING (answer_id))"""
VALID = "list_filter(list_sort(list_distinct(m)), lambda x: x >= 1 AND x <= len(p))"
INVALID = "list_filter(list_sort(list_distinct(m)), lambda x: NOT (x >= 1 AND x <= len(p)))"
LANG = f"""CASE WHEN text IS NULL OR a + l = 0 THEN 'unknown' WHEN l >= a THEN 'en' WHEN regexp_matches(text, '[{X.URDU}]') THEN 'ur' WHEN regexp_matches(text, '[{X.PERSIANATE}]') THEN 'fa' ELSE 'ar' END"""
LANGS = f"lg AS (SELECT *, {LANG} AS lang_ FROM (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, length(text) - length(regexp_replace(text, '{X.ARABIC_SCRIPT}', '', 'g')) AS a FROM corpus))"


def name_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\b(?:ibn|b\\.)\\b', 'bin', 'g'), '\\bal[-\\s]+', 'al ', 'g'), '[^a-z'' ]', ' ', 'g'), ' +', ' ', 'g'))"


MENTIONS = f"""nw AS (SELECT id, doc_id AS seen, confidence, regexp_split_to_array(text, '[^A-Za-z]+') AS w FROM corpus),
nt AS (SELECT id, seen, confidence, coalesce(w[1], '') || ' narrated to us ibn ' || coalesce(w[2], '') || ', from his father, from Al-' || coalesce(w[3], '') || ' ' AS head FROM nw),
np AS (SELECT id, seen, string_split(regexp_replace(head, '(?i)\\s*,?\\s*(?:narrated\\s+to\\s+(?:me|us)|informed\\s+(?:us|me)(?:\\s+saying)?|reported\\s+to\\s+(?:us|me)|it\\s+has\\s+been\\s+narrated|or\\s+from|from)\\s*,?\\s*', chr(1), 'g'), chr(1)) AS p FROM nt),
nl AS (SELECT id, seen, list_filter(list_transform(p, lambda x: trim(regexp_replace(trim(x), '^[’‘''".,;:]+|[’‘''".,;:]+$', '', 'g'))), lambda x: x <> '') AS p FROM np),
ne AS (SELECT id, seen, unnest(range(len(p)))::INT AS position, unnest(p) AS name FROM nl),
mentions AS (SELECT *, {name_key('name')} AS key FROM ne WHERE length(name) >= 3 AND NOT regexp_matches(name, '(?i)^(his\\s+(father|grandfather|uncle|brother|companions?)|a\\s+(number|group|man)\\b|some\\s+of|certain|our\\s+companions|a\\s+servant)') AND regexp_matches(name, '\\p{{L}}') AND {name_key('name')} <> '')"""
CRITERIA = {"scholarly_acceptance": "high * 2", "chain_availability": "CASE WHEN sn % 3 <> 0 THEN 0.9 END", "publisher_credibility": "1.0 - low", "academic_references": "CASE WHEN sn % 2 = 0 THEN 0.25 END", "community_acceptance": "NULL::DOUBLE", "original_language": "medium * 10", "translation_quality": "unverified"}
_NUM = " + ".join(f"coalesce(least(1.0, greatest(0.0, {e})) * CASE WHEN ({e}) IS NULL THEN 0 ELSE {C.WEIGHTS[k]} END, 0)" for k, e in CRITERIA.items())
_DEN = " + ".join(f"CASE WHEN ({e}) IS NULL THEN 0 ELSE {C.WEIGHTS[k]} END" for k, e in CRITERIA.items())
SCORES = f"""ag AS (SELECT source_id, regexp_extract(source_id, '(\\d+)', 1)::INT AS sn, {', '.join(f"avg((confidence = '{c}')::INT::DOUBLE) AS {c}" for c in C.RANK)} FROM corpus GROUP BY 1),
sc AS (SELECT source_id, ({_NUM})::DOUBLE / ({_DEN})::DOUBLE AS score FROM ag),
sb AS (SELECT source_id, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.8 THEN 'high' WHEN round(score, 9) >= 0.6 THEN 'medium' WHEN round(score, 9) >= 0.35 THEN 'low' ELSE 'unverified' END AS confidence FROM sc)"""
GOLD = """gold AS (SELECT 'q' || item_id AS query_id, list_sort(coalesce(list(DISTINCT d.id) FILTER (d.id IS NOT NULL), [])) AS rel FROM benchmark b LEFT JOIN corpus d ON contains(d.text, b.text) GROUP BY item_id)"""
METRICS = """gm AS (SELECT query_id, CASE WHEN count(f.id) = 0 THEN 0.0 ELSE round(count(f.id) FILTER (list_contains(rel, f.id))::DOUBLE / count(f.id), 6) END AS precision,
  CASE WHEN len(any_value(rel)) = 0 THEN 1.0 WHEN count(f.id) = 0 THEN 0.0 ELSE round(count(f.id) FILTER (list_contains(rel, f.id))::DOUBLE / len(any_value(rel)), 6) END AS recall,
  coalesce(round(1.0 / min(f.rank) FILTER (list_contains(rel, f.id)), 6), 0.0) AS reciprocal_rank FROM gold LEFT JOIN found f USING (query_id) GROUP BY query_id)"""
SECTIONS = {"quran": "Qur''anic Foundations", "tafsir": "Tafsir & Commentary", "hadith": "Hadith Foundations", "historical": "Historical Context", "scholarly_opinion": "Scholarly Analysis"}
LECTURE = f"""lc AS (SELECT query_id, evidence_type, id, similarity, round(similarity + {BONUS}, 9) AS score FROM sims JOIN corpus USING (id) WHERE evidence_type IN ({', '.join(f"'{k}'" for k in SECTIONS)}) QUALIFY row_number() OVER (PARTITION BY query_id, evidence_type ORDER BY similarity DESC, id) <= 200),
ls AS (SELECT query_id, CASE evidence_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTIONS.items())} END AS section, row_number() OVER (PARTITION BY query_id, evidence_type ORDER BY score DESC, id)::INT AS rank, id, score FROM lc QUALIFY rank <= 4)"""
VERSES = f"""asks AS (SELECT 'v' || surah AS id, n, own, ref FROM (SELECT surah, ayah, id AS own, {norm('text')} AS n, surah || ':' || ayah AS ref FROM corpus WHERE surah IS NOT NULL QUALIFY row_number() OVER (PARTITION BY surah ORDER BY ayah) = 1))"""
VOLUMES = "vol AS (SELECT source_id AS volume, doc_id, id, CASE WHEN regexp_extract(source_id, '(\\d+)', 1)::INT % 2 = 0 THEN doc_id ELSE length(text) END AS number FROM corpus)"

REFERENCE = f"""CASE WHEN evidence_type = 'quran' AND surah IS NOT NULL AND ayah IS NOT NULL THEN 'Qur''an ' || surah || ':' || ayah
  ELSE concat_ws(', ', source_id, CASE WHEN {g('volume')} THEN 'v' || volume END, CASE WHEN {g('page')} THEN 'p.' || page END, CASE WHEN {g('hadith_number')} THEN 'h.' || hadith_number END, CASE WHEN {g('chapter')} THEN 'ch.' || chapter END) END"""
MERGED = f"""parts AS (SELECT 'q' || item_id AS query_id, item_id // 3 AS question_id FROM benchmark), many AS (SELECT question_id, count(*) AS k FROM parts GROUP BY 1),
b AS (SELECT question_id, id, max(score) AS score FROM found JOIN parts USING (query_id) WHERE similarity >= 0.15 GROUP BY 1, 2),
mp AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INT AS rank, id, score FROM b JOIN many USING (question_id) QUALIFY rank <= CASE WHEN k = 1 THEN 6 ELSE greatest(6, 3 * k) END)"""

ORACLES: dict[str, str] = {
    "normalize_text": f"WITH {CORPUS}, {NORMAL} SELECT id, length(n)::BIGINT AS n_chars, md5(n) AS digest FROM normal",
    "token_counts": f"WITH {CORPUS}, {NORMAL}, t AS (SELECT id, list_filter(string_split(n, ' '), lambda x: x <> '') AS t FROM normal) SELECT id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct FROM t",
    "char_trigram_counts": f"WITH {CORPUS}, {NORMAL}, {grams('normal', 'tf')} SELECT substr(f, 3) AS gram, sum(tf)::BIGINT AS n FROM tf WHERE f[1] = 'c' GROUP BY 1",
    "feature_hash_buckets": f"WITH {CORPUS}, {NORMAL}, {grams('normal', 'tf')}, d AS (SELECT DISTINCT f FROM tf) SELECT {BUCKET.format(dim=2048)} AS bucket, count(*) AS n, sum({SIGN})::BIGINT AS signs FROM d GROUP BY 1",
    "idf_table": f"WITH {CORPUS}, {IDF} SELECT f AS feature, df, round(idf, 6) AS idf FROM idf",
    "tfidf_topk": f"WITH {sims()} SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sims QUALIFY rank <= 10",
    "hashing_topk": f"""WITH {CORPUS}, {NORMAL}, {grams('normal', 'tf', False)}, dw AS (SELECT id, f, tf::DOUBLE AS w FROM tf), {vectors('dw', 'dv', 512)}, {ASKS}, {grams('asks', 'qf', False)}, qw AS (SELECT id, f, tf::DOUBLE AS w FROM qf), {vectors('qw', 'qv', 512)},
sims AS (SELECT q.id AS query_id, d.id, round(sum(q.w * d.w), 9) AS similarity FROM dv d JOIN qv q USING (bucket) GROUP BY 1, 2)
SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sims QUALIFY rank <= 10""",
    "dense_topk": """WITH x AS (SELECT label, vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label AS query_id, i, round(avg(x), 6) AS m FROM x GROUP BY 1, 2),
s AS (SELECT query_id, vec_id AS id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 9) AS similarity FROM x JOIN m USING (i) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank, id, round(similarity, 6) AS similarity FROM s QUALIFY rank <= 10""",
    "confidence_rerank": f"WITH {sims()}, {retrieve(5, breadth=20, compat=True)} {FOUND}",
    "retrieve_filtered_compat": f"WITH {sims()}, {retrieve(5, FILTER, compat=True)} {FOUND}",
    "retrieve_filtered_exact": f"WITH {sims()}, {retrieve(5, FILTER)} {FOUND}",
    "consensus_by_source": f"WITH {sims()}, {retrieve(8, breadth=32, compat=True)} SELECT query_id, source_id, count(*) AS n, round(max(similarity), 6) AS best FROM found WHERE similarity >= 0.15 GROUP BY 1, 2",
    "compare_sources": f"WITH {sims()}, s AS (SELECT query_id, source_id, id, round(similarity + {BONUS}, 9) AS score FROM sims JOIN corpus USING (id) WHERE similarity >= 0.15 AND {RANK} >= 1) SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, id)::INT AS rank, id, round(score, 6) AS score FROM s QUALIFY rank <= 4",
    "multi_part_merge": f"""WITH {sims()}, {retrieve(6, f"{RANK} >= 1", compat=True)}, {MERGED} SELECT question_id, rank, id, round(score, 6) AS score FROM mp""",
    "extractive_answers": f"""WITH {sims()}, {retrieve(6, f"{RANK} >= 1", compat=True)}, {MERGED},
qs AS (SELECT item_id // 3 AS question_id, string_agg(text, ' ' ORDER BY item_id) AS text FROM benchmark GROUP BY 1),
ql AS (SELECT question_id, {LANG} AS lang_ FROM (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, length(text) - length(regexp_replace(text, '{X.ARABIC_SCRIPT}', '', 'g')) AS a FROM qs)),
ac AS (SELECT question_id, rank, id, confidence, {REFERENCE} AS ref, CASE WHEN length(text) > 240 THEN rtrim(substr(text, 1, 240)) || '…' ELSE text END || ' [' || rank || ']' AS said FROM mp JOIN corpus USING (id))
SELECT question_id, any_value(lang_) AS language, count(id) AS n_claims, arg_min(ref, rank) AS first, md5(coalesce(string_agg(said, ' ' ORDER BY rank) FILTER (rank <= 3), '')) AS summary,
  ((count(id) = 0)::INT + coalesce(bool_or(confidence IN ('low', 'unverified')), FALSE)::INT + (any_value(lang_) IN ('fa', 'ur'))::INT)::BIGINT AS n_caveats FROM ql LEFT JOIN ac USING (question_id) GROUP BY question_id""",
    "lecture_sections": f"WITH {sims()}, {LECTURE} SELECT query_id, section, rank, id, round(score, 6) AS score FROM ls",
    "lecture_pool": f"WITH {sims()}, {LECTURE}, o AS (SELECT query_id, id, max(score) AS score FROM ls GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, round(score, 6) AS score FROM o QUALIFY rank <= 8",
    "crossref_links": f"""WITH {sims(VERSES)}, c1 AS (SELECT query_id, evidence_type, id, text, similarity, round(similarity + {BONUS}, 9) AS score FROM sims JOIN corpus USING (id) WHERE evidence_type IN ('tafsir', 'hadith', 'quran') QUALIFY row_number() OVER (PARTITION BY query_id, evidence_type ORDER BY similarity DESC, id) <= 375),
c2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, evidence_type ORDER BY score DESC, id) AS s FROM c1 QUALIFY s <= 15),
c3 AS (SELECT c2.*, asks.n, asks.ref FROM c2 JOIN asks ON asks.id = query_id WHERE c2.id <> own AND similarity >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id, evidence_type ORDER BY s, c2.id) <= 5),
c4 AS (SELECT *, {content('n')} AS vc, {content(norm('text'))} AS tc FROM c3),
c5 AS (SELECT *, CASE WHEN contains(text, ref) OR CASE WHEN len(vc) = 0 THEN 1.0 ELSE {common('vc', 'tc')}::DOUBLE / len(vc) END >= 0.5 THEN 'explicit' ELSE 'thematic' END AS link_type FROM c4)
SELECT query_id, evidence_type AS section, row_number() OVER (PARTITION BY query_id, evidence_type ORDER BY link_type, similarity DESC, id)::INT AS rank, id, link_type, round(similarity, 6) AS similarity FROM c5""",
    "citation_completeness": f"WITH {CORPUS}, x AS (SELECT *, {COMPLETE} AS complete FROM corpus) SELECT id, evidence_type, complete, complete AND {RANK} >= 2 AS as_fact FROM x",
    "reference_string": f"WITH {CORPUS} SELECT id, {REFERENCE} AS reference FROM corpus",
    "unknown_sources": f"WITH {CORPUS}, {REGISTRY} SELECT source_id, count(*) AS n FROM corpus WHERE source_id NOT IN (SELECT source_id FROM registry) GROUP BY 1",
    "passage_exists": f"WITH {CORPUS}, {CITED}, {EXISTS} SELECT cid, found FROM pe",
    "validate_citations": f"WITH {CORPUS}, {CITED}, {EXISTS}, {REGISTRY}, v AS (SELECT *, {COMPLETE} AS complete, source_id IN (SELECT source_id FROM registry) AS source_known FROM pe) SELECT cid, complete, source_known, found, ((NOT complete)::INT + (NOT source_known)::INT + coalesce((NOT found)::INT, 0))::BIGINT AS n_problems FROM v",
    "source_coverage": f"WITH {CORPUS}, {REGISTRY} SELECT count(*) AS registered, count(*) FILTER (source_id IN (SELECT source_id FROM corpus)) AS covered, round(count(*) FILTER (source_id IN (SELECT source_id FROM corpus))::DOUBLE / count(*), 6) AS coverage FROM registry",
    "claim_overlap": f"WITH {TURNS} SELECT answer_id, claim_no, round(best, 6) AS best FROM best",
    "content_overlap": f"""WITH {TURNS}, pc AS (SELECT answer_id, list_distinct(flatten(list({content('n')}))) AS p FROM pa GROUP BY 1), o AS (SELECT answer_id, claim_no, {content('cl.n')} AS c, p FROM cl JOIN pc USING (answer_id))
SELECT answer_id, claim_no, len(c)::BIGINT AS n, round(CASE WHEN len(c) = 0 THEN 1.0 ELSE {common('c', 'p')}::DOUBLE / len(c) END, 6) AS overlap FROM o""",
    "answer_grounding": f"WITH {TURNS}, gr AS ({GROUNDED}) SELECT *, n_weak = 0 AS grounded, round(n_weak::DOUBLE / n_claims, 6) AS hallucination FROM gr",
    "hallucination_rate": f"WITH {TURNS}, gr AS ({GROUNDED}) SELECT count(*) AS answers, sum(n_weak)::BIGINT AS weak, round(avg(round(n_weak::DOUBLE / n_claims, 9)), 6) AS rate FROM gr",
    "verify_markers": f"WITH {SYN} SELECT answer_id, array_to_string({INVALID}, ',') AS invented, array_to_string({VALID}, ',') AS valid FROM sp",
    "verify_synthesis": f"""WITH {SYN}, x AS (SELECT *, list_transform(p, lambda q: {content(norm('q'))}) AS pc, {VALID} AS cited, {INVALID} AS bad FROM sp),
s AS (SELECT answer_id, bad, pc, cited, p, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda y: y <> '')) AS s FROM x),
y AS (SELECT *, {content(norm('s'))} AS c, {content(norm("regexp_replace(s, '\\[(\\d+)\\]', '', 'g')"))} AS bare, list_filter(list_transform(regexp_extract_all(s, '\\[(\\d+)\\]', 1), lambda z: z::BIGINT), lambda z: z >= 1 AND z <= len(p)) AS own FROM s),
z AS (SELECT *, coalesce(list_max(list_transform(own, lambda i: CASE WHEN len(c) = 0 THEN 1.0 ELSE {common('c', 'pc[i]')}::DOUBLE / len(c) END)), 0.0) AS bo, coalesce(list_max(list_transform(cited, lambda i: CASE WHEN len(c) = 0 THEN 1.0 ELSE {common('c', 'pc[i]')}::DOUBLE / len(c) END)), 0.0) AS bc FROM y),
u AS (SELECT answer_id, any_value(bad) AS bad, sum((len(own) > 0 AND bo < 0.2)::INT)::BIGINT AS n_ungrounded, sum((len(own) = 0 AND len(bare) >= 4 AND NOT regexp_matches(s, '(?i)^(according to|based on|the (retrieved |available )?evidence|in (summary|conclusion)|the evidence (does not|is insufficient))') AND bc < 0.2)::INT)::BIGINT AS n_uncited FROM z GROUP BY 1)
SELECT answer_id, array_to_string(bad, ',') AS invented, n_ungrounded, n_uncited, len(bad) = 0 AND n_ungrounded = 0 AND n_uncited = 0 AS grounded FROM u""",
    "detect_language": f"WITH {CORPUS}, {LANGS} SELECT id, lang_ AS language, CASE lang_ WHEN 'en' THEN 'English' WHEN 'ar' THEN 'Arabic' WHEN 'fa' THEN 'Persian' WHEN 'ur' THEN 'Urdu' ELSE 'Unknown' END AS name, lang_ IN ('fa', 'ur') AS cross_lingual FROM lg",
    "language_mix": f"WITH {CORPUS}, {LANGS} SELECT source_id, lang_ AS detected, count(*) AS n FROM lg GROUP BY 1, 2",
    "dedupe_documents": f"WITH {CORPUS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) AS r FROM corpus) WHERE r = 1",
    "near_duplicate_keys": f"WITH {CORPUS}, {NORMAL} SELECT sha256(n) AS key, count(*) AS n, min(id) AS first FROM normal GROUP BY normal.n HAVING count(*) > 1",
    "facets": f"WITH {CORPUS} SELECT source_id, evidence_type, count(*) AS n FROM corpus GROUP BY GROUPING SETS ((source_id), (evidence_type), ())",
    "source_types": f"WITH {CORPUS}, {REGISTRY}, s AS (SELECT source_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT evidence_type)), ',') AS types FROM corpus GROUP BY 1) SELECT source_id, n, types, coalesce(title, source_id) AS title FROM s LEFT JOIN registry USING (source_id)",
    "top_narrators": f"WITH {CORPUS}, {MENTIONS}, f AS (SELECT key, name, count(*) AS c, min((seen, position)) AS first FROM mentions GROUP BY 1, 2) SELECT key, arg_min(name, (-c, first)) AS name, sum(c)::BIGINT AS mentions FROM f GROUP BY 1",
    "narrator_lookup": f"WITH {CORPUS}, {MENTIONS}, w AS (SELECT * FROM mentions WHERE list_contains(string_split(key, ' '), 'bin') AND list_contains(string_split(key, ' '), 'the')) SELECT id, position, key FROM w UNION ALL SELECT id, position, key FROM mentions WHERE NOT EXISTS (SELECT 1 FROM w) AND contains(key, 'bin the')",
    "narrator_profile": f"WITH {CORPUS}, {MENTIONS} SELECT key, confidence AS grade, count(DISTINCT id) AS n FROM mentions JOIN corpus USING (id) GROUP BY 1, 2",
    "grade_summary": f"WITH {CORPUS} SELECT 'Reviewer ' || language AS attributor, confidence AS grade, count(*) AS n FROM corpus GROUP BY 1, 2 UNION ALL SELECT '', 'noted', count(*) FROM corpus HAVING count(*) > 0",
    "source_score": f"WITH {CORPUS}, {SCORES} SELECT * FROM sb",
    "review_queue": f"WITH {CORPUS}, {SCORES} SELECT * FROM sb WHERE confidence IN ('unverified', 'low')",
    "manifest_status": f"""WITH {CORPUS}, e AS (SELECT source_id, count(*) AS n FROM corpus GROUP BY 1), m AS (SELECT source_id, n + regexp_extract(source_id, '(\\d+)', 1)::INT % 2 AS expected FROM e UNION ALL SELECT 'src_absent', 5)
SELECT source_id, expected, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING' WHEN n <> expected THEN 'DRIFT' ELSE 'ok' END AS status FROM m LEFT JOIN e USING (source_id)""",
    "iteration_deltas": """WITH e AS (SELECT ts::DATE::VARCHAR AS iteration, round(avg(value), 6) AS mean_value, count(*)::DOUBLE AS events FROM events GROUP BY 1)
SELECT iteration, mean_value, events, round(mean_value - lag(mean_value) OVER (ORDER BY iteration), 6) AS mean_value_delta, round(events - lag(events) OVER (ORDER BY iteration), 6) AS events_delta FROM e""",
    "gold_metrics": f"WITH {sims()}, {retrieve(10, breadth=40, compat=True)}, {GOLD}, {METRICS} SELECT * FROM gm",
    "mrr": f"WITH {sims()}, {retrieve(10, breadth=40, compat=True)}, {GOLD}, {METRICS} SELECT count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, count(*) FILTER (reciprocal_rank > 0) AS hits FROM gm",
    "isolated_numbers": f"WITH {CORPUS}, v AS (SELECT source_id AS volume, length(text) AS number FROM corpus) SELECT volume, count(*) AS n FROM v WHERE EXISTS (SELECT 1 FROM v x WHERE x.volume = v.volume AND (x.number = v.number - 1 OR x.number = v.number + 1)) GROUP BY 1",
    "increasing_refs": f"WITH {CORPUS}, v AS (SELECT id, source_id AS volume, doc_id, length(text)::INT AS number FROM corpus), m AS (SELECT *, max(number) OVER (PARTITION BY volume ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v) SELECT id, volume, number FROM m WHERE b IS NULL OR number > b",
    "page_fill": f"WITH {CORPUS} SELECT id, coalesce(first(page IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last(page IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS page FROM corpus",
    "trusted_volumes": f"""WITH {CORPUS}, {VOLUMES}, m AS (SELECT volume, median(number) AS mid FROM vol GROUP BY 1), n AS (SELECT vol.* FROM vol JOIN m USING (volume) WHERE abs(number - mid) <= 200),
s AS (SELECT volume, number, lag(number) OVER (PARTITION BY volume ORDER BY doc_id) AS p FROM n), k AS (SELECT volume FROM s GROUP BY 1 HAVING coalesce(avg(CASE WHEN p IS NOT NULL THEN (number > p)::INT END), 1.0) >= 0.95) SELECT volume, count(*) AS n FROM n WHERE volume IN (SELECT volume FROM k) GROUP BY 1""",
}

ALL_VERSES = f"asks AS (SELECT 'v' || surah || ':' || ayah AS id, {norm('text')} AS n, id AS own, surah || ':' || ayah AS ref FROM corpus WHERE surah IS NOT NULL)"
ORACLES["crossref_links_all"] = ORACLES.pop("crossref_links").replace(VERSES, ALL_VERSES)

CLAIM_CITED = f"""cc AS (SELECT DISTINCT answer_id, claim_no, 'doc_' || (answer_id * 7 + claim_no) AS cid FROM cl),
v AS (SELECT cid, complete, (NOT complete)::INT + (NOT source_known)::INT + coalesce((NOT found)::INT, 0) AS n FROM (SELECT *, {COMPLETE} AS complete, source_id IN (SELECT source_id FROM registry) AS source_known FROM pe)),
ck AS (SELECT cc.*, v.complete, v.n, {RANK} AS level FROM cc LEFT JOIN v USING (cid) LEFT JOIN corpus ON corpus.id = cc.cid)"""
CHECKED = f"{TURNS}, {CORPUS}, {CITED}, {EXISTS}, {REGISTRY}, {CLAIM_CITED}"
_WEAK, _OVER, _CITED = "sum((best < 0.25)::INT)", "sum(coalesce((level >= 2 AND NOT coalesce(complete, FALSE))::INT, 0))", "sum(coalesce(n, 0))"
ORACLES["answer_report"] = f"""WITH {CHECKED} SELECT answer_id, count(*) AS n_claims, {_WEAK}::BIGINT AS n_weak, {_OVER}::BIGINT AS n_overstated, {_CITED}::BIGINT AS n_citation_problems,
  {_WEAK} + {_OVER} + {_CITED} = 0 AS grounded FROM best LEFT JOIN ck USING (answer_id, claim_no) GROUP BY 1"""
ORACLES["citation_accuracy"] = f"WITH {CHECKED} SELECT answer_id, count(n) AS n_citations, coalesce(round(sum((n = 0)::INT)::DOUBLE / nullif(count(n), 0), 6), 0.0) AS accuracy FROM ck GROUP BY 1"
ORACLES["judge_claims"] = f"""WITH {TURNS}, j AS (SELECT cl.answer_id, claim_no, {content('cl.n')} AS c, CASE WHEN pa.n IS NOT NULL THEN {content('pa.n')} END AS p FROM cl LEFT JOIN pa USING (answer_id)),
b AS (SELECT answer_id, claim_no, max(CASE WHEN p IS NULL THEN 0.0 WHEN len(c) = 0 THEN 1.0 ELSE {common('c', 'p')}::DOUBLE / len(c) END) AS support FROM j GROUP BY 1, 2)
SELECT answer_id, claim_no, round(support, 6) AS support, support >= 0.2 AS supported FROM b"""
_ORDER = "CASE section " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(SECTIONS.values())) + " END"
ORACLES["reading_list"] = f"""WITH {sims()}, {LECTURE}, fs AS (SELECT query_id, source_id, {_ORDER} AS o, rank, ls.id FROM ls JOIN corpus USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY o, rank, ls.id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o, rank, id, source_id)::INT AS place, source_id FROM fs"""


def parts_by_size(most: int, sized: str) -> str:
    """CTEs sized(source_id, id, b, i) and walk(source_id, i, part, held): a greedy fold over each source's rows in order."""
    return f"""sized AS (SELECT source_id, id, {sized} AS b, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(surah, 0), coalesce(ayah, 0), id) AS i FROM corpus),
walk AS (
  SELECT source_id, i, 0 AS part, b AS held, b FROM sized WHERE i = 1 UNION ALL
  SELECT s.source_id, s.i, CASE WHEN held + s.b > {most} THEN part + 1 ELSE part END, CASE WHEN held + s.b > {most} THEN s.b ELSE held + s.b END, s.b
  FROM walk w JOIN sized s ON s.source_id = w.source_id AND s.i = w.i + 1)"""


_EDGES = f"regexp_replace(coalesce(text, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"
_HEADING = "CASE WHEN evidence_type = 'quran' AND surah IS NOT NULL AND ayah IS NOT NULL THEN 'English: ' ELSE '' END"
_PASSAGE = f"strlen('### ' || {REFERENCE} || chr(10) || {_HEADING} || {_EDGES} || chr(10) || chr(10))"
ORACLES["export_parts"] = f"""WITH RECURSIVE {CORPUS}, {parts_by_size(50_000, "strlen(coalesce(text, ''))")}
SELECT source_id, part, count(*) AS n, sum(b)::BIGINT AS bytes FROM walk GROUP BY source_id, part"""
ORACLES["export_index"] = f"""WITH RECURSIVE {CORPUS}, {REGISTRY}, {parts_by_size(100_000, _PASSAGE)},
each AS (SELECT source_id, part, count(*) AS n, sum(b)::BIGINT AS bytes FROM walk GROUP BY source_id, part),
every AS (SELECT *, count(*) OVER w AS parts, sum(n) OVER w AS passages FROM each WINDOW w AS (PARTITION BY source_id))
SELECT source_id, part, parts::INT AS parts, source_id || CASE WHEN parts > 1 THEN printf('.part%02d', part + 1) ELSE '' END AS file,
  coalesce(title, source_id) || CASE WHEN parts > 1 THEN printf(' (part %d/%d)', part + 1, parts) ELSE '' END AS label, n, bytes, passages::BIGINT AS passages
FROM every LEFT JOIN registry USING (source_id)"""

_quote = lambda t: "'" + t.replace("'", "''") + "'"
_PLAN = ", ".join(f"({i}, {', '.join(map(_quote, x))})" for i, x in enumerate(OUTLINE, 1))
_MARK = f"length('> ' || trim(text) || E'\\n>\\n> — **' || {REFERENCE} || '** (' || confidence || ')' || E'\\n')"
ORACLES["lecture_outline"] = f"""WITH {sims()}, {LECTURE}, plan(no, title, kind, note_with, note_without) AS (VALUES {_PLAN}),
e AS (SELECT query_id, section AS title, string_agg(id || '|' || {REFERENCE} || '|' || confidence, chr(10) ORDER BY rank) AS evidence, sum({_MARK} + 1)::BIGINT - 1 AS chars
  FROM ls JOIN corpus USING (id) GROUP BY 1, 2),
fs AS (SELECT query_id, source_id, {_ORDER} AS o, rank, ls.id FROM ls JOIN corpus USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY o, rank, ls.id) = 1),
r AS (SELECT query_id, string_agg('- ' || source_id, chr(10) ORDER BY o, rank, id, source_id) AS sources FROM fs GROUP BY 1),
s AS (SELECT asks.id AS query_id, no, plan.title, CASE WHEN kind = 'reading' THEN coalesce(sources, '') ELSE '' END AS body, coalesce(evidence, '') AS evidence, chars,
    CASE WHEN kind = 'reading' AND sources IS NOT NULL THEN '' WHEN evidence IS NOT NULL THEN note_with ELSE note_without END AS note
  FROM asks CROSS JOIN plan LEFT JOIN e ON e.query_id = asks.id AND e.title = plan.title LEFT JOIN r ON r.query_id = asks.id)
SELECT query_id, no::INT AS no, title, body, evidence, md5(note) AS note,
  (length(title) + 4 + CASE WHEN body <> '' THEN length(body) + 2 ELSE 0 END + coalesce(chars + 1, 0) + CASE WHEN note <> '' THEN length('_[Lecturer note: ]_') + length(note) + 2 ELSE 0 END)::INT AS n_markdown
FROM s"""
_HAS = {"source_id": "source_id", "evidence_type": "evidence_type", "surah": "surah", "ayah": "ayah", "volume": "volume", "page": "page", "hadith_number": "hadith_number", "chapter": "chapter"}
_CITE = "{" + ", ".join(f"'{n}': {_HAS.get(n, 'NULL')}" for n in CITATION.names) + "}"
ORACLES["answer_records"] = f"""WITH {CORPUS}, t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
asked AS (SELECT conv_id, arg_min(text, turn) AS question FROM t WHERE role = 'user' GROUP BY 1),
cl AS (SELECT t.conv_id, t.turn, c.id IS NOT NULL AND ({COMPLETE}) AND {RANK} >= 2 AS fact,
    {{'statement': t.text, 'evidence_type': evidence_type, 'confidence': coalesce(confidence, 'unverified'), 'view_status': NULL::VARCHAR,
      'citations': CASE WHEN c.id IS NULL THEN [] ELSE [{_CITE}] END, 'asserted_as_fact': coalesce(c.id IS NOT NULL AND ({COMPLETE}) AND {RANK} >= 2, FALSE)}} AS claim
  FROM t LEFT JOIN corpus c ON c.id = 'doc_' || (t.conv_id * 7 + t.turn) WHERE t.role = 'assistant'),
held AS (SELECT conv_id, list(claim ORDER BY turn) AS claims, count(*) AS n_claims, count(*) FILTER (fact) AS n_facts FROM cl GROUP BY 1)
SELECT conv_id, md5(to_json({{'question': question, 'sub_questions': []::VARCHAR[], 'query_language': {LANG}, 'answer_language': NULL::VARCHAR, 'refined_query': NULL::VARCHAR, 'summary': NULL::VARCHAR,
  'generated_on': NULL::VARCHAR, 'claims': claims, 'caveats': []::VARCHAR[]}})::VARCHAR) AS digest, n_claims, n_facts
FROM (SELECT *, question AS text, length(regexp_replace(question, '[^A-Za-z]', '', 'g')) AS l, length(question) - length(regexp_replace(question, '{X.ARABIC_SCRIPT}', '', 'g')) AS a FROM asked) JOIN held USING (conv_id)"""
