import re

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import decontaminate, jaccard_join, packing, pii, secret_scan
from loomspan.llm.wordhash import ALNUM, NOT_SPACE, grams, slices, utf8, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
few = settings(max_examples=150, deadline=None)


@few
@given(st.lists(st.text(max_size=40) | st.none(), min_size=1, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        h, rows = words(*utf8(pa.array(texts, pa.string())), table)
        want = [(w, i) for i, t in enumerate(texts) for w in re.findall(pattern, (t or "").translate(LOW))]
        assert rows.tolist() == [i for _, i in want]
        names: dict = {}
        assert all(names.setdefault(x, w) == w for (w, _), x in zip(want, h.tolist(), strict=True))


@few
@given(st.lists(st.integers(0, 50), min_size=1), st.integers(1, 60))
def test_slices_cover_rows_once_within_the_bound(sizes, most):
    offsets = np.r_[0, np.cumsum(sizes)]
    parts = list(slices(offsets, most))
    assert [i for i, _ in parts] == [0, *(j for _, j in parts[:-1])] and parts[-1][1] == len(sizes)
    assert all(offsets[j] - offsets[i] <= most or j == i + 1 for i, j in parts)


@few
@given(st.integers(1, 10_000), st.sampled_from([7, 64, 2048]))
def test_cuts_keep_every_token(n, capacity):
    out = packing.cuts(n, capacity)
    assert sum(out) == n and all(0 < x <= capacity for x in out) and len(out) <= n // capacity + 3


@few
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_are_whole_and_full_enough(lengths):
    bins, out = packing.Bins(64), []
    for i, n in enumerate(lengths):
        full = bins.put((i, 0, np.arange(n)))
        if full:
            out.append(full)
            assert len(full) == 64 // n and sum(len(x) for _, _, x in full) <= 64
    rest = list(bins.close())
    assert all(sum(len(x) for _, _, x in s) == 64 for s in rest[:-1])
    back: dict = {}
    for s in out + rest:
        for doc, start, ids in s:
            back.setdefault(doc, []).append((start, ids.tolist()))
    assert [[x for _, p in sorted(back.get(i, [])) for x in p] for i in range(len(lengths))] == [list(range(n)) for n in lengths]


@few
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)), st.integers(0, 4))
def test_the_suffix_bound_is_an_upper_bound(a, b, depth):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert len(a & b) <= jaccard_join.overlap_bound(x, y, depth) <= min(len(a), len(b))


@few
@given(st.lists(st.integers(0, 30), max_size=400), st.integers(1, 12))
def test_frequent_counts_are_low_by_a_bounded_amount(keys, most):
    f = jaccard_join.Frequent(most)
    for k in keys:
        f.add(np.array([k], np.uint64))
    f.fold()
    held = dict(zip(f.keys.tolist(), f.counts.tolist(), strict=True))
    assert len(held) <= most
    assert all(keys.count(k) - len(keys) / (most + 1) <= held.get(k, 0) <= keys.count(k) for k in set(keys))


@few
@given(st.text("abcdef0123456789g=:token AKIZ", max_size=200))
def test_long_runs_alone_give_the_same_spans(text):
    runs = lambda p, least: [m.span() for m in re.finditer(p, text) if len(m.group()) >= least]
    assert runs("[0-9a-f]+", 16) == runs(secret_scan.KINDS["hex"][0], 16) and runs("AKIA[A-Z0-9]+", 18) == runs(secret_scan.KINDS["access"][0], 18)


@few
@given(st.sampled_from(["email", "phone", "account", "ssn"]), st.data())
def test_surrogates_are_distinct_and_never_the_original(kind, data):
    shapes = {"email": r"[a-z]{1,4}[0-9]\.[a-z]{2}@[a-z]{3}[0-9]\.com", "phone": r"\+[0-9]{11}", "account": "[0-9]{16}", "ssn": "[0-9]{9}"}
    some = data.draw(st.lists(st.from_regex(shapes[kind], fullmatch=True), min_size=2, max_size=6, unique=True))
    some = [s for s in some if s.isascii()]
    key = pii.Key(b"k")
    made = [key.surrogate(kind, s) for s in some]
    assert len(set(made)) == len(some) and all(a != b and len(a) == len(b) for a, b in zip(some, made, strict=True))


WORD = st.one_of(*[st.text(st.characters(categories=c, min_codepoint=a, max_codepoint=b), min_size=1, max_size=12) for c, a, b in (
    (["Lu", "Ll"], 0x41, 0x24F), (["Lu", "Ll"], 0x370, 0x3FF), (["Lu", "Ll"], 0x400, 0x52F), (["Lo"], 0x5D0, 0x5EA), (["Lo"], 0x620, 0x64A), (["Lo"], 0x4E00, 0x9FFF), (["Lo"], 0xAC00, 0xD7A3), (["Lo"], 0x904, 0x939))])


@few
@given(st.lists(WORD, min_size=2, max_size=6, unique=True), st.sampled_from("fm"))
def test_names_of_any_script_change_and_stay_apart(names, gender):
    key = pii.Key(b"k")
    made = [key.surrogate("person", f"{gender} {n}") for n in names]
    assert len(set(made)) == len(names)
    for n, m in zip(names, made, strict=True):
        if n not in pii.NAME_OF:
            assert n != m and len(n) == len(m)
            assert [script(c) for c in n] == [script(c) for c in m]


def script(c):
    return next(s for s in ("Common", "Latin", "Greek", "Coptic", "Cyrillic", "Hebrew", "Arabic", "Han", "Hangul", "Devanagari") if regex.match(rf"\p{{Script={s}}}", c))


def test_a_letter_of_no_script_stays_one():
    key = pii.Key(b"k")
    made = key.surrogate("person", "f µ")
    assert made != "µ" and script(made) == "Common"


@few
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=20).map(" ".join), max_size=4), st.integers(2, 5))
def test_every_window_has_a_probe(items, size):
    block = decontaminate.windows_of([(str(i), t) for i, t in enumerate(items)], size)
    want = {tuple(w[i : i + min(size, len(w))]) for t in items for w in [t.split()] for i in range(max(1, len(w) - size + 1)) if w}
    assert len(block.length) == len(want)
    counts = {(s, x): 1 for s, (g, _, _) in decontaminate.shingles_of(block, 3).items() for x in g.view(np.int64).tolist()}
    probes = decontaminate.probes_of(block, 3, counts)
    assert sorted(w for p in probes for w in p.window.tolist()) == list(range(len(want)))
    for p in probes:
        for i, w in enumerate(p.window.tolist()):
            own = block.words[block.at[w] : block.at[w + 1]]
            assert grams(own, p.size)[p.place[i]] == p.keys[np.searchsorted(p.at, i, "right") - 1]
