"""The filter audit against filters applied one after another."""

import re
from itertools import permutations

from loomspan.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(210))
TEXTS = [LONG, LONG, None, "", " ", "A $ b", LONG + " #", "same " * 300, "Ä ÄÖ ABC", LONG.upper(), "x\u00a0y z", "\t\n\x0b", "", LONG, "same " * 300, "é" * 20000 + " " + LONG]
PARTS = ["en", "de", None, "", "en", "fr", "en", "fr", "de", "fr", "", "en", "de", "en", "en", "de"]
IDS = [4, 2, 7, 3, None, 5, 6, 8, 9, 10, 11, 12, 13, 4, 1, 15]
LABELS = [(4, 1, 0), (4, None, 1), (2, 1, 1), (None, 1, 1), (8, 0, 1), (9, None, None), (99, 1, 1), (6, 1, None), (6, 1, None)]


def plain(docs, labels):
    """Rows of the report, each order walked through document by document."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    fails = []
    for i, t, _ in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        fails.append({"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy})
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, shapley = {}, {}
    for part in {p for *_, p in docs}:
        own = [(i, f) for (i, _, p), f in zip(docs, fails, strict=True) if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone, stay = [x for x in left if x[1][c]], [x for x in left if not x[1][c]]
                n_fails = sum(f[c] for _, f in own)
                out[part, "".join(order), step] = [len(stay), len(gone), n_fails - len(gone), sum(f[c] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
                left = stay
    return sorted((*k, *v[:6], shapley[k[0], v[6]]) for k, v in out.items())


def run(spark, docs, labels, kinds="doc_id long, text string, lang string"):
    d = spark.createDataFrame(docs, kinds).repartition(3)
    names = list(d.columns)
    for c in ("part", "n", "id", "h", "first", "A", "good", "filter"):  # names that the operator uses itself
        d = d.withColumn(c, d[names[1]])
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "doc_id AS id", "quality AS good")
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.flagged(d), m).collect())


def test_equals_filters_applied_one_after_another(spark):
    docs = list(zip(IDS, TEXTS, PARTS, strict=True))
    got = run(spark, docs, LABELS)
    assert got == plain(docs, LABELS) and len(got) == 600 * 4


def test_without_labels_or_rows(spark):
    docs = list(zip(IDS, TEXTS, PARTS, strict=True))[:3]
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, [], LABELS) == []


def test_removed_counts_add_up(spark):
    """Over an order's steps, what is removed and what is kept last is the part; shapley values of a part add up to 120 times what any filter fails."""
    docs = list(zip(IDS, TEXTS, PARTS, strict=True))
    rows = run(spark, docs, LABELS)
    for part in {r[0] for r in rows}:
        total = sum((p or "") == part for *_, p in docs)
        for order in map("".join, permutations("ABCDE")):
            own = [r for r in rows if r[:2] == (part, order)]
            assert sum(r[4] for r in own) + own[-1][3] == total
        own = [r for r in rows if r[:2] == (part, "ABCDE")]
        assert sum(r[9] for r in own) == 120 * (total - own[-1][3])
