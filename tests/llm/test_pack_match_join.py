import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest

from loomspan.llm import decontaminate, jaccard_join, packing
from loomspan.llm.wordhash import ALNUM, NOT_SPACE, utf8, words

import pyarrow as pa

WORD13 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_text(rng, n, vocabulary=40):
    return "".join(f"{rng.choice(['W', 'w', 'é', 'ß', '日本'])}{rng.randrange(vocabulary)}{rng.choice([' ', '  ', chr(10), ', ', chr(160), chr(9)])}" for _ in range(n))


@pytest.mark.parametrize("table,pattern", [(ALNUM, WORD13), (NOT_SPACE, re.compile(r"[^\x20\x09-\x0D]+"))])
def test_word_hashes_tell_words_apart_and_rows_end_words(table, pattern, monkeypatch):
    rng = random.Random(1)
    texts = [random_text(rng, rng.randrange(50)) for _ in range(60)] + [None, "", "ab", "c", "x" * 9000, "end"]
    for block in (1 << 20, 64):  # small blocks cut inside rows and words
        monkeypatch.setattr("loomspan.llm.wordhash.BLOCK", block)
        h, rows = words(*utf8(pa.array(texts)), table)
        want = [(w, i) for i, t in enumerate(texts) for w in pattern.findall((t or "").translate(LOW))]
        assert [r for _, r in want] == rows.tolist()
        by_word = {}
        for (w, _), x in zip(want, h.tolist(), strict=True):
            assert by_word.setdefault(w, x) == x
        assert len(set(by_word.values())) == len(by_word)


def brute_windows(docs, items):
    out = []
    for name, text in docs:
        w = WORD13.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for item, t in items:
            b = WORD13.findall((t or "").translate(LOW))
            n = min(13, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1) if b else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((name, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(2)
    items = [(i, random_text(rng, n)) for i, n in enumerate([0, 1, 3, 5, 12, 13, 14, 30, 60])] + [(7, "again w1 w2"), (10, None), (11, "\t"), (12, "w1 w1 w1 w1 w1 w1")]
    whole = [t for _, t in items if t]
    docs = [(i, random_text(rng, 200) + rng.choice(whole) + random_text(rng, 30)) for i in range(20)]
    docs += [(100, None), (101, ""), (102, whole[-2]), (None, whole[6]), (100, whole[7] * 2), (102, whole[-2]), (103, " ".join(["w1"] * 40)), (104, random_text(rng, 20000) + whole[8])]
    d = spark.createDataFrame([(a, b, "c", 1) for a, b in docs], "doc_id long, text string, items string, item_id int")
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = decontaminate.digest(decontaminate.match_benchmark(d, b, block_bytes=block_bytes)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_windows(docs, items)
    assert all(r.n_hit == 0 for r in decontaminate.digest(decontaminate.match_benchmark(d, b.limit(0))).collect())
    assert decontaminate.match_benchmark(d.limit(0), b).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets, top = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def test_jaccard_groups_equal_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for group in range(12):  # chains and stars around each text, with shared passages between groups
        words_ = [f"g{group}w{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 8, 40, 120, 400]))] + ["shared passage of some common words here"] * (group % 3)
        for _ in range(rng.choice([1, 2, 10, 25])):
            docs.append((len(docs), " ".join(words_)))
            words_ = list(words_)
            for _ in range(rng.choice([0, 1, 2])):
                words_[rng.randrange(len(words_))] = f"new{rng.randrange(1000)}"
    docs += [(None, docs[0][1]), (None, "only null"), (5, docs[0][1]), (5, docs[5][1]), (1000, None), (1001, ""), (1002, " \n "), (1003, "a B"), (1004, "A  b"), (1005, "x " * 30000)]
    d = spark.createDataFrame([(a, b, 7, "z") for a, b in docs], "doc_id long, text string, n long, c string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_join.join_ngrams(d).collect()), key=str)
    assert got == brute_components(docs)
    assert jaccard_join.join_ngrams(d.limit(0)).count() == 0


def test_frequent_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(4)
    often = jaccard_join.Frequent(2000)
    for _ in range(30):
        often.add(np.r_[np.arange(5, dtype=np.uint64), rng.integers(1000, 1 << 40, 500, dtype=np.uint64)])
    often.fold()
    assert len(often.keys) <= 2000 and set(range(5)) <= set(often.keys.tolist())


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_both_tokenizers_agree_on_plain_texts():
    rng = random.Random(5)
    plain = [chr(c) for c in range(0x500) if not packing.PLAIN.search(chr(c))] + list("‘’“”…–—€  \n\n\t'sdmtlvre19")
    texts = ["".join(rng.choices(plain, k=rng.randrange(300))) for _ in range(600)] + ["a<|endoftext|>b", "日本　語", "x" * 20000, " " * 3000, "ﬁ \u0085​", "I'll we've 'S 'LL"]
    got = [x.tolist() + [1] for x in packing.encode(texts, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)]
    assert got == ids_of(texts)


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "<|endoftext|>", "日本語 text", "word " * 2047, "word " * 2048, "word " * 9000] + [random_text(rng, rng.choice([3, 50, 300, 900])) for _ in range(300)]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(3)
    pieces = packing.pack(d, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).toPandas()
    want = dict(enumerate(ids_of(texts)))
    total = 0
    for name, own in pieces.sort_values("start").groupby("doc_id"):
        ids = [x for b in own.ids for x in np.frombuffer(b, "<u4").tolist()]
        assert ids == want.pop(name) and (own.doc_tokens == len(ids)).all() and own.start.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist()
        total += len(ids)
    assert not want
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist() and own.length.sum() <= 2048
    assert pieces.sequence_id.nunique() * 2048 <= 1.05 * total + 3 * 2048
    few = packing.digest(packing.pack(d.where("doc_id = 4"), public.path("byte_bpe_50k.json"))).collect()
    assert [r.ids_crc32 for r in few] == [zlib.crc32(np.array(ids_of(texts[4:5])[0], "<u4").tobytes())]
    assert packing.pack(d.limit(0), public.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 31, 341, 682, 683, 700, 1023, 1024, 1025, 2047, 2048, 2049, 6000])
def test_cuts_add_up(n):
    out = packing.cuts(n, 2048)
    assert sum(out) == n and all(0 < x <= 2048 for x in out)


def test_columns_named_like_the_operators_own_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, text, 7, 8), (2, text, 9, 10), (3, "other words here", 11, 12)], "doc_id long, text string, _rid long, comp long")
    assert sorted(tuple(r) for r in jaccard_join.one_of_each(d).collect()) == [(1, text, 7, 8), (3, "other words here", 11, 12)]
    bench = spark.createDataFrame([("b", " ".join(f"w{i}" for i in range(13)))], "item_id string, text string")
    kept = decontaminate.decontaminate(d, bench)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [(3, "other words here", 11, 12)]
