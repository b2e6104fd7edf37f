"""DuckDB SQL that must give the rows of the query of the same name."""

ORACLES: dict[str, str] = {}

ORACLES["op8_url_filter"] = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS k FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h0),
h2 AS (SELECT *, regexp_extract(bare, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1) AS two FROM h1),
h3 AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]*$') THEN bare WHEN two <> '' THEN two ELSE split_part(bare, '.', -1) END AS suffix FROM h2),
h4 AS (SELECT *, CASE WHEN length(bare) > length(suffix) THEN substr(bare, 1, length(bare) - length(suffix) - 1) ELSE '' END AS rest FROM h3),
h AS (SELECT host, n, k, suffix, CASE WHEN rest = '' THEN suffix ELSE split_part(rest, '.', -1) || '.' || suffix END AS dom FROM h4),
d AS (SELECT suffix, dom, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix, dom),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
lv AS (SELECT 'h' AS l, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s),
st AS (SELECT l, count(*)::DOUBLE AS g, sum(n) AS n, sum(k) / sum(n) AS m, sum(n * n) AS nn, sum(k * k / n) AS kk FROM lv WHERE n > 0 GROUP BY l),
ph AS (SELECT l, m, least(0.999, greatest(0.001, CASE WHEN m * (1 - m) > 0 AND n - nn / n - (g - 1) > 0
    THEN (kk - n * m * m - (g - 1) * m * (1 - m)) / ((n - nn / n - (g - 1)) * m * (1 - m)) ELSE 0 END)) AS phi FROM st),
x AS (SELECT l, coalesce(m, 0.5) AS m, coalesce((1 - phi) / phi, 2.0) AS w FROM (VALUES ('h'), ('d'), ('s')) t(l) LEFT JOIN ph USING (l)),
ps AS (SELECT suffix, (k + w * m) / (n + w) AS mu FROM s, x WHERE l = 's'),
pd AS (SELECT dom, d.suffix, (k + w * mu) / (n + w) AS mu FROM d JOIN ps USING (suffix), x WHERE l = 'd'),
ab AS (SELECT host, k + w * mu AS a, n - k + w * (1 - mu) AS b FROM h JOIN pd USING (dom, suffix), x WHERE l = 'h'),
u AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM ab),
r(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hp AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hp USING (host, path) LEFT JOIN u USING (host)
"""

# Component by reachability over all links; pairs meet on shared shingles, so it is for small tables.
ORACLES["op7_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS m, count(*) AS n FROM g GROUP BY doc_id),
reps AS (SELECT m, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY m),
rg AS (SELECT g.doc_id, s FROM g JOIN reps ON g.doc_id = reps.rep),
often AS (SELECT s FROM rg GROUP BY s HAVING count(*) > 1),
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM rg a JOIN often USING (s) JOIN rg b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM sh JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, top) AS (SELECT rep, rep FROM reps UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.top, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN reps ON reps.m = s.m LEFT JOIN c ON c.node = reps.rep
"""

ORACLES["op3_decontaminate"] = r"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM d0, lens WHERE len(w) >= n),
m AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT rid, count(DISTINCT p) AS k FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(k, 0) > 0 AND 20 * coalesce(k, 0) >= len(w) AS contaminated
FROM d0 LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""

_VALUE = "[A-Za-z0-9+/_.=-]"
_SECRETS = (
    ("assign", rf"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?({_VALUE}+)", 12),
    ("access", r"(AKIA[A-Z0-9]+)", 18),
    ("hex", r"([0-9a-f]+)", 16),
    ("weak_id", r"((?:ASIA|AROA|AIDA)[A-Z0-9]{12,}|(?i:client_?id|access_?key_?id|account_?(?:id|name))[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9_.@-]{4,})", 4),
    ("weak_secret", r"([A-Za-z0-9+/]{32,}={0,2})", 32),
    ("endpoint", r"((?:https?|wss?|postgres(?:ql)?|mysql|redis|mongodb|amqps?)://[^\s\"''<>]+)", 8),
)
_FOUND = " UNION ALL ".join(
    rf"SELECT rid, {i} AS kind, unnest(range(1, len(g) + 1)) AS n, unnest(g) AS gap, unnest(m) AS m, unnest(v) AS v FROM (SELECT rid, regexp_extract_all(t, '{s}', 1) AS g, regexp_extract_all(t, '{s}', 2) AS m, regexp_extract_all(t, '{s}', 3) AS v FROM d)"
    for i, (_, p, _) in enumerate(_SECRETS) for s in [rf"(?s)(.*?)(?:({p})|\z)"])
ORACLES["op2_secret_scan"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
p AS (SELECT rid, kind, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY n) AS e FROM f),
c AS (SELECT rid, kind, e - length(m) AS s, e FROM p WHERE m <> '' AND length(v) >= ([{', '.join(str(n) for _, _, n in _SECRETS)}])[kind + 1]
  AND (kind <> 4 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))),
k AS (SELECT w.rid, w.kind, w.s, w.e, bool_or(x.kind < 3 AND x.s < w.e AND w.s < x.e) AS taken,
    bool_or(x.kind IN (1, 3) AND NOT (x.s < w.e AND w.s < x.e)) AS has_id, bool_or(x.kind IN (0, 2, 4) AND NOT (x.s < w.e AND w.s < x.e)) AS has_secret
  FROM c w JOIN c x ON x.rid = w.rid AND x.kind <> 5 AND x.s - 256 < w.e AND w.s < x.e + 256 WHERE w.kind >= 3 GROUP BY ALL),
r AS (SELECT rid, kind, s, e FROM c WHERE kind < 3 UNION ALL
  SELECT rid, kind, s, e FROM k WHERE NOT taken AND CASE kind WHEN 4 THEN has_id WHEN 3 THEN has_secret ELSE has_id AND has_secret END),
z AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind, e) AS spans
  FROM (SELECT *, (['{"', '".join(n for n, _, _ in _SECRETS)}'])[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM r) GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (rid)
"""

ORACLES["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part, len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E
  FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT part, A, B, C, D, E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
m AS (
  SELECT c.*, filter_order, step, substr(filter_order, step, 1) AS x,
    list_filter([1, 2, 3, 4, 5], lambda i: CASE substr(filter_order, i, 1) WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END)[1] AS gone,
    A::INT + B::INT + C::INT + D::INT + E::INT AS failures,
    CASE substr(filter_order, step, 1) WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END AS fails
  FROM c, o, (VALUES (1), (2), (3), (4), (5)) s(step)),
r AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r"""

# The cheapest edits are looked for from a conversation's last row to its first, each state holding the least (cost, audit, repaired text) behind it.
ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    (concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))) AS key, row_number() OVER () AS rid
  FROM conversations),
tab AS (
  SELECT b, list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS t
  FROM range(256) r(b)),
tabs AS (SELECT list(t ORDER BY b) AS ts FROM tab),
hashed AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::UBIGINT)),
    lambda c, x: xor(c >> 8, ts[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS dmg
  FROM raw, tabs),
damaged AS (
  SELECT conv_id, turn, CASE WHEN dmg = 4 THEN 'user' ELSE role END AS role, rid, copy,
    CASE dmg WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) c(copy) WHERE dmg <> 0 AND (copy = 0 OR dmg = 3)),
ordered AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) > 1 AS again
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), rid, copy)),
kinds AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN again THEN 3
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 1 END AS kind
  FROM ordered),
rows_ AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS c, list({'ini': ini, 'kind': kind, 'role': role, 'text': text} ORDER BY i) AS rs, count(*) AS n
  FROM kinds GROUP BY conv_id),
walk AS (
  SELECT c, rs, n AS i,
    {'cost': 0, 'audit': '', 'out': ''} AS q0, {'cost': 10, 'audit': 'II', 'out': E'user:\nassistant:\n'} AS q1,
    {'cost': 5, 'audit': 'I', 'out': E'assistant:\n'} AS q2, {'cost': 0, 'audit': '', 'out': ''} AS q3
  FROM rows_
  UNION ALL
  SELECT c, rs, i - 1,
    list_min([e0, {'cost': 5 + e2.cost, 'audit': 'I' || e2.audit, 'out': E'user:\n' || e2.out}, {'cost': 10 + e3.cost, 'audit': 'II' || e3.audit, 'out': E'user:\nassistant:\n' || e3.out}]),
    list_min([e1, {'cost': 5 + e2.cost, 'audit': 'I' || e2.audit, 'out': E'user:\n' || e2.out}, {'cost': 10 + e3.cost, 'audit': 'II' || e3.audit, 'out': E'user:\nassistant:\n' || e3.out}]),
    list_min([e2, {'cost': 5 + e3.cost, 'audit': 'I' || e3.audit, 'out': E'assistant:\n' || e3.out}]),
    list_min([e3, {'cost': 5 + e2.cost, 'audit': 'I' || e2.audit, 'out': E'user:\n' || e2.out}])
  FROM (
    SELECT c, rs, i,
      list_min(list_filter([
        {'cost': 2 + q0.cost, 'audit': 'D' || q0.audit, 'out': q0.out},
        CASE WHEN rs[i].kind < 2 AND rs[i].ini = 's' THEN {'cost': k + q1.cost, 'audit': 'K' || q1.audit, 'out': line || q1.out} END,
        CASE WHEN rs[i].kind < 2 AND rs[i].ini = 'u' THEN {'cost': k + q2.cost, 'audit': 'K' || q2.audit, 'out': line || q2.out} END,
        CASE WHEN rs[i].kind < 2 THEN {'cost': k + 1 + q2.cost, 'audit': 'R' || q2.audit, 'out': 'user:' || rs[i].text || E'\n' || q2.out} END], lambda x: x IS NOT NULL)) AS e0,
      list_min(list_filter([
        {'cost': 2 + q1.cost, 'audit': 'D' || q1.audit, 'out': q1.out},
        CASE WHEN rs[i].kind < 2 AND rs[i].ini = 'u' THEN {'cost': k + q2.cost, 'audit': 'K' || q2.audit, 'out': line || q2.out} END,
        CASE WHEN rs[i].kind < 2 THEN {'cost': k + 1 + q2.cost, 'audit': 'R' || q2.audit, 'out': 'user:' || rs[i].text || E'\n' || q2.out} END], lambda x: x IS NOT NULL)) AS e1,
      list_min(list_filter([
        {'cost': 2 + q2.cost, 'audit': 'D' || q2.audit, 'out': q2.out},
        CASE WHEN rs[i].kind < 2 AND rs[i].ini = 'a' THEN {'cost': k + q3.cost, 'audit': 'K' || q3.audit, 'out': line || q3.out} END,
        CASE WHEN rs[i].kind < 2 THEN {'cost': k + 1 + q3.cost, 'audit': 'R' || q3.audit, 'out': 'assistant:' || rs[i].text || E'\n' || q3.out} END], lambda x: x IS NOT NULL)) AS e2,
      list_min(list_filter([
        {'cost': 2 + q3.cost, 'audit': 'D' || q3.audit, 'out': q3.out},
        CASE WHEN rs[i].kind < 2 AND rs[i].ini = 'u' THEN {'cost': k + q2.cost, 'audit': 'K' || q2.audit, 'out': line || q2.out} END,
        CASE WHEN rs[i].kind < 2 THEN {'cost': k + 1 + q2.cost, 'audit': 'R' || q2.audit, 'out': 'user:' || rs[i].text || E'\n' || q2.out} END], lambda x: x IS NOT NULL)) AS e3
    FROM (SELECT *, CASE WHEN rs[i].kind = 1 THEN 5 ELSE 0 END AS k, rs[i].role || ':' || rs[i].text || E'\n' AS line FROM walk WHERE i > 0))),
counts AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (kind = 2) AS blank, count(*) FILTER (kind = 3) AS duplicate, count(*) FILTER (kind = 1) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(q0.cost, 0)::BIGINT AS cost, coalesce(q0.audit, '') AS audit,
  sha256(regexp_replace(coalesce(q0.out, ''), '\n$', '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.c = coalesce(o.conv_id, -9223372036854775808)
LEFT JOIN (SELECT c, q0 FROM walk WHERE i = 0) w ON w.c = coalesce(o.conv_id, -9223372036854775808)"""

# All pairs of a label; a label of at most a window's vectors is compared whole by the operator too.
ORACLES["op11_near_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
  coalesce(vec_id = least(vec_id, coalesce(least.b, vec_id)), false) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id"""
