import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import ann, language_id, pii, quality

SYLLABLES = {"en": ["the", "ing", "th", "er", "wh", "ly"], "de": ["sch", "ung", "ein", "ü", "ß", "keit"], "fr": ["eau", "è", "que", "ai", "ç", "oi"]}


def made_up(rng, lang, words=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words))


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    m = language_id.BiGRU(["a", "b", "c"], hidden=3, seed=1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    data = rng.integers(97, 101, (4, 6)).astype(np.uint8)
    mask = np.ones((4, 6))
    mask[1, 3:] = 0
    label = np.array([0, 1, 2, 1])
    f = np.float32
    try:
        language_id.f32 = np.float64
        _, g = m.backward(data, mask, label)
    finally:
        language_id.f32 = f
    for name, at in (("u", (0, 1, 2)), ("u", (1, 2, 7)), ("b", (1, 0, 1)), ("v", (0, 1, 2)), ("c", (1,)), ("x", (0, 98, 4)), ("x", (1, 97, 7))):
        eps, both = 1e-2, []
        for s in (1, -1):
            m.p[name][at] += s * eps
            both.append(m.backward(data, mask, label)[0])
            m.p[name][at] -= s * eps
        assert (both[0] - both[1]) / (2 * eps) == pytest.approx(g[name][at], abs=2e-3), name


def test_language_of_held_out_rows_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, made_up(rng, lang), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 .. !!", None), (None, made_up(rng, "de", 4000), None), (1003, made_up(rng, "fr", 2), None), (1003, made_up(rng, "fr"), None)]
    d = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows + odd], "doc_id long, text string, lang string, score double")
    own = F.col("doc_id")
    model = language_id.train(d.where(own.isNotNull() & ~language_id.held_out(own)), steps=150)
    got = language_id.identify(d, model).withColumn("h", language_id.held_out(F.col("doc_id"))).collect()
    truth = {a: c for a, _, c in rows}
    held = [r for r in got if r.h and r.doc_id in truth]
    assert len(got) == len(rows) + len(odd) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[None].lang_pred == "de" and sum(by_id[None].label_bytes) == len(odd[3][1].encode()) and all(0 <= r.score <= 1 for r in got)
    assert language_id.train(d.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.identify(d, None).collect()} == {"und"}
    assert language_id.identify(d.limit(0), model).count() == 0


def test_windows_do_not_depend_on_neighbours():
    rng = random.Random(2)
    m = language_id.BiGRU(["a", "b"])
    texts = [made_up(rng, "de", n).encode() for n in (1, 5, 40, 3)] + [b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    together, _ = m.label(data, offsets)
    for i, t in enumerate(texts):
        if t:
            alone, _ = m.label(np.frombuffer(t, np.uint8), np.array([0, len(t)]), batch=3)
            assert np.allclose(alone[0], together[i], atol=1e-4)


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(ok):
        if i % every == 0:
            best = sorted(((-float(v @ w), j) for b, (j, w) in enumerate(ok) if b != at))[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in best])
    return out


def test_nearest_neighbours_recall_order_and_edges(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[rng.integers(12)] + 0.5 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(600)]  # a hot group of copies
    rows += [(5000, None), (5001, [0.0] * 8), (5020, [1.0] * 7), (5040, [None] + [1.0] * 7), (5060, [float("nan")] * 8), (5080, [float("inf")] * 8), (None, [1.0] * 8), (40, rows[7][1])]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(d, sample=1000).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    want = brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    hits = total = 0
    for q, lists in want.items():
        if len(lists) > 1:
            continue
        mine = got[q]
        assert [r for _, _, r in mine] == list(range(1, 21)) and [(-s, i) for i, s, _ in mine] == sorted((-s, i) for i, s, _ in mine)
        least = lists[0][-1][1]
        hits += sum(s >= least - 1e-9 for _, s, _ in mine)
        total += 20
    assert hits / total >= 0.9
    own = np.array(rows[0][1], np.float64)
    copies = [i for i, s, _ in got[2000] if abs(s - own @ own) < 1e-9]
    assert copies == [0, *range(2001, 2600)][: len(copies)]
    few = ann.search(d.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert ann.search(d.limit(0)).count() == 0 and ann.search(d.where("vec_id between 5000 and 5001")).count() == 0


def test_anisotropic_codes_lower_their_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 7)).astype(np.float32)
    q = ann.Quantiser(x, 4, threshold=0.6, rounds=0)
    p = q.padded(x)
    t, u = p - q.coarse[ann.nearest(p, q.coarse)], p / np.linalg.norm(p, axis=1, keepdims=True)

    def loss(codes):
        e = t - q.words[np.arange(len(q.words)), codes].reshape(len(t), -1)
        return float((e * e).sum() + (q.eta - 1) * ((e * u).sum(1) ** 2).sum())

    plain = np.stack([ann.nearest(t[:, 2 * i : 2 * i + 2], q.words[i]) for i in range(len(q.words))], 1)
    codes = q.assign(t, u)
    assert loss(codes) < loss(plain)
    before = loss(codes)
    q.refit(t, u, codes)
    assert loss(codes) < before
    table = q.tables(x[:5])
    own, packed = q.encode(x)
    recon = q.words[np.arange(len(q.words)), q.assign(t, u)].reshape(len(t), -1)
    assert np.allclose(sum(table[j][:, packed[:, j]] for j in range(packed.shape[1])), p[:5] @ recon.T, atol=1e-4)


def quality_rows(rng, n):
    out = []
    for i in range(n):
        good = rng.random() < 0.8
        toxic = good and rng.random() < 0.15
        words = made_up(rng, rng.choice(list(SYLLABLES)), rng.randrange(20, 200)).split()
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["fool", "scoundrel"]))
        out.append((i, " ".join(words), rng.choice("ab"), "en", None if i % 7 == 0 else sum(map(len, words)), int(good), int(toxic)))
    return out


def test_quality_on_held_out_rows_and_edges(spark):
    rows = quality_rows(random.Random(5), 900)
    odd = [(2000, None, None, None, None), (2001, "", "a", "en", -5), (None, rows[0][1], "a", "en", 3), (2002, "word " * 40000, "a", "en", 200000), (2002, "word", "zz", "xx", 4)]
    docs = spark.createDataFrame([r[:5] + ("x",) for r in rows] + [r + ("x",) for r in odd], "doc_id long, text string, source string, lang string, n_chars long, keep string")
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in rows if r[0] % 3] + [(None, 1, 0), (3, None, 1), (1, rows[1][5], rows[1][6]), (99999, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.good_labels(labels), most=500)
    got = quality.classify(docs, model, keep_text=True)
    assert got.columns == ["doc_id", "text", "source", "lang", "n_chars", "p_content", "p_metadata", "score", "keep"]
    out = {r.doc_id: r for r in got.collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    right = [out[r[0]].keep == bool(r[5] and not r[6]) for r in held]
    assert np.mean(right) > 0.93 and np.mean([out[r[0]].keep for r in held if r[5] and not r[6]]) > 0.97
    assert got.count() == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out.values())
    none = quality.train(docs, quality.good_labels(labels.limit(0)))
    assert {(r.score, r.keep) for r in quality.classify(docs, none).collect()} == {(1.0, True)}
    one = quality.train(docs, quality.good_labels(labels.where("quality = 1 and toxic = 0")))
    assert all(r.keep for r in quality.classify(docs.select("doc_id", "text"), one).collect())
    assert quality.classify(docs.limit(0), model).count() == 0


def test_co_training_moves_labels_between_views():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    a, b = y[:, None] + 0.3 * rng.normal(size=(400, 2)), y[:, None] + 0.3 * rng.normal(size=(400, 3))
    first = quality.Logistic.fit(a[:6], y[:6].astype(float))
    views = quality.co_train(a[:6], b[:6], y[:6] > 0, (a[6:], b[6:]))
    assert all(np.mean((v.logit(x) > 0) == (y > 0)) > 0.95 for v, x in zip(views, (a, b), strict=True))
    assert views[0].w.tolist() != first.w.tolist()


PRIVATE = [
    "Mail hein.19@mail5.example.com or HEIN.19@Mail5.example.com now", "call +1 (659) 555-3949, or 659-555-3949.", "cards 7536784127813050 4845168114407329 and 4539 1488 0343 6467.",
    "host 226.203.165.10. and 10.0.0.7", "ssn 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "Mrs. Mary Smith met Mr Smith and John Müller; Frau Anna Groß", "господин Иван Петров", "😀é 152.143.123.131### x",
]


def test_surrogates_keep_type_format_and_coreference(spark):
    d = spark.createDataFrame([(i, t, "e") for i, t in enumerate(PRIVATE * 2)] + [(100, None, "e"), (101, "", None), (None, "no data 12 3.14 2024-01-02", "e")], "doc_id long, text string, entities string")
    rows = pii.replace_pii(d, b"k").collect()
    got = {r.doc_id: r for r in rows}
    n = len(PRIVATE)
    assert got[100].text is None and got[101].text == "" and got[None].text == "no data 12 3.14 2024-01-02" and not got[None].entities
    for i, t in enumerate(PRIVATE):
        r = got[i]
        assert r.text == got[i + n].text and r.text != t and r.entities
        for e in r.entities:
            old = t[e.start : e.end]
            assert old not in r.text, (old, r.text)
            if e.kind not in ("person", "ipv4"):
                assert len(old) == len(e.surrogate) and re.sub(r"\w", "w", old) == re.sub(r"\w", "w", e.surrogate)
                assert [c.isdigit() for c in old] == [c.isdigit() for c in e.surrogate] and [c.isupper() for c in old] == [c.isupper() for c in e.surrogate]
    kinds = [[e.kind for e in got[i].entities] for i in range(n)]
    assert kinds == [["email"] * 2, ["phone"] * 2, ["account"] * 3, ["ipv4"] * 2, ["ssn"], ["iban"], ["person"] * 4, ["person"], ["ipv4"]]
    a, b = got[0].entities
    assert a.surrogate.lower() == b.surrogate.lower() and a.surrogate.endswith(".com")
    cards = [re.sub(r"\D", "", e.surrogate) for e in got[2].entities]
    assert [pii.luhn(c) for c in cards] == [pii.luhn(re.sub(r"\D", "", x)) for x in ("7536784127813050", "4845168114407329", "4539148803436467")]
    assert got[3].entities[1].surrogate.startswith("10.") and pii.mod97(got[5].entities[0].surrogate.replace(" ", "")) == 1
    mary, smith, john, anna = (e.surrogate.split(" ") for e in got[6].entities)
    assert mary[1] == smith[0] and ("f", "latin") == pii.NAME_OF[mary[0]][0] == pii.NAME_OF[anna[0]][0] and pii.NAME_OF[john[0]][0] == ("m", "latin")
    assert pii.NAME_OF[got[7].entities[0].surrogate.split(" ")[0]][0] == ("m", "cyrillic")
    assert pii.collisions(pii.replace_pii(d, b"k")).count() == 0 and pii.replace_pii(d.limit(0), b"k").count() == 0
    assert pii.replace_pii(d, b"other").where("doc_id = 0").first().text != got[0].text


@pytest.mark.parametrize("n", [2, 3, 24, 1000])
def test_permutations_have_no_fixed_points(n):
    key = pii.Key(b"x")
    out = [key.number(i, n, "t") for i in range(n)]
    assert sorted(out) == list(range(n)) and all(i != o for i, o in enumerate(out))


def test_neighbours_within_a_hot_group_of_noisy_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(9000, 32))
    x[::3] = x[0]
    noise = rng.normal(size=x.shape)
    x += 0.1 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(d, every=60, sample=4000).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, hits = x.astype(np.float32).astype(np.float64), []
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(found) & set(np.argsort(-s)[:20].tolist())))
    assert len(got) == 150 and sum(hits) >= 0.95 * 20 * len(got)


def test_names_after_a_capitalised_word():
    texts = ["Contact Alice Smith", "Yesterday Maria Garcia met", "Dear Mrs Jones", "Dear Mr. Smith, hello", "On Monday Frau Anna Groß", "Вчера господин Иван Петров", "Mr Smith Mrs Jones", "Alice Dr Brown", "Prof. Dr. Anna Groß", "Mrs Dr Jones", "Ask Mrs Dr"]
    got = [[(t[a:b], c) for a, b, kind, c in pii.find(t) if kind == "person"] for t in texts]
    assert got == [[("Alice Smith", "f Alice Smith")], [("Maria Garcia", "f Maria Garcia")], [("Jones", "f Jones")], [("Smith", "m Smith")], [("Anna Groß", "f Anna Groß")],
                   [("Иван Петров", "m Иван Петров")], [("Smith", "m Smith"), ("Jones", "f Jones")], [("Brown", " Brown")], [("Anna Groß", "f Anna Groß")], [("Jones", " Jones")], []]
    assert not pii.find("Contact Us At Once") and not pii.find("Dear Sir, The Alice")


def test_an_email_is_found_from_its_beginning():
    long = "x1" * 400 + ".y@mail.example.com"
    for text in (f"to {long} now", long, f"a@b.com{long}", f"é{long}"):
        assert [text[a:b] for a, b, kind, _ in pii.find(text) if kind == "email"][-1].endswith(long[1:])
    assert [(a, b) for a, b, *_ in pii.find(f"to {long} now")] == [(3, 3 + len(long))]
    made = pii.Key(b"k").surrogate("email", long)
    assert len(made) == len(long) and made != pii.Key(b"k").surrogate("email", "z" + long[1:])
    assert all(made[i : i + 200] != long[i : i + 200] for i in range(0, 800, 200)) and re.sub(r"\d", "0", made)[1:800:2] == "0" * 400


def test_names_beyond_lists_and_in_other_scripts():
    texts = ["Mr Øæ here", "Mrs Å", "Herr Łoś", "Mr Ωμέγα", "Xavier Dupont", "JOHN SMITH went", "Mr Þór", "王小明先生", "田中さん", "김철수 씨", "السيد محمد", "my name is Zorblax Quux.", "Jean\xa0Valjean"]
    key = pii.Key(b"x")
    for t, name in zip(texts, ["Øæ", "Å", "Łoś", "Ωμέγα", "Xavier Dupont", "JOHN SMITH", "Þór", "王小明", "田中", "김철수", "محمد", "Zorblax Quux", "Jean\xa0Valjean"], strict=True):
        ((a, b, kind, canonical),) = pii.find(t)
        new = pii.dressed(t[a:b], kind, canonical, key.surrogate(kind, canonical))
        assert t[a:b] == name and kind == "person" and not set(re.split(r"\s", name)) & set(re.split(r"\s", new))


def test_colliding_surrogates_are_told(spark):
    kind = "array<struct<start: long, end: long, kind: string, original: string, surrogate: string>>"
    e = lambda o, s, k="ssn": (0, 1, k, o, s)
    d = spark.createDataFrame([(1, "a", [e("111", "9-9 9"), e("222", "888")]), (2, "b", [e("333", "999")]), (3, "c", [e("222", "888"), e("m John", "Karl", "person"), e("f Ann", "karl", "person")]), (4, None, [])], f"doc_id long, text string, entities {kind}")
    assert {r.doc_id: r.n_collisions for r in pii.checked(d).collect()} == {1: 1, 2: 1, 3: 2, 4: 0}
    assert {r.n_collisions for r in pii.digest(d.where("doc_id = 4")).collect()} == {0}


def test_doubles_keep_their_products_and_their_order(spark):
    """Vectors that single precision can't tell apart, or can't hold, come in the order of their double products."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16))
    x[100:160] = x[100] * (1 + np.arange(60)[:, None] * 1e-11)
    for scale in (1.0, 1e150, 1e-150):
        y = x * scale
        d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(d).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in range(0, 300, 20):
            s = y @ y[q]
            best = sorted((i for i in range(300) if i != q), key=lambda i: (-sum(a * b for a, b in zip(y[i], y[q], strict=True)), i))[:20]
            mine = [i for _, i, _ in sorted(got[q])]
            assert all(p == pytest.approx(s[i], rel=1e-12) for _, i, p in got[q])
            assert [p for *_, p in sorted(got[q])] == sorted((p for *_, p in got[q]), reverse=True)
            assert len(set(mine) & set(best)) >= 18 and (q != 100 or mine[:19] == best[:19])
