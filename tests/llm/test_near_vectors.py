"""Sorted projection passes against all pairs."""

import math

import numpy as np
import pytest

from loomspan.llm import near_vectors

KINDS = "vec_id long, embedding array<double>, label int"


def plain(rows, threshold=0.93):
    """(n_links, component_id) by row, and the links."""
    x = [np.array(v, dtype=float) if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v) else None for _, v, label in rows]
    n = len(rows)
    links = {(i, j) for i in range(n) for j in range(n) if i != j and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j])
             and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= threshold}
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for k, j in links if k == i)]) for i in range(n)] if n < 80 else comp
        if new == comp:
            break
        comp = new
    ids = [min((rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None), default=None) for i in range(n)]
    return links, [(r[0], sum(a == i for a, _ in links), ids[i], r[0] is not None and r[0] == ids[i]) for i, r in enumerate(rows)]


def near(rng, v, cosine):
    """A vector at that cosine to v."""
    v = v / np.linalg.norm(v)
    w = rng.standard_normal(len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


def test_equals_all_pairs_on_edge_cases(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((4, 8))
    rows = [(10, base[0].tolist(), 1), (3, (base[0] * 2).tolist(), 1), (3, base[0].tolist(), 1), (5, base[0].tolist(), 2), (None, base[0].tolist(), 1), (None, base[1].tolist(), 3),
            (6, near(rng, base[2], 0.95).tolist(), 1), (7, base[2].tolist(), 1), (8, near(rng, base[2], 0.92).tolist(), 1), (9, [0.0] * 8, 1), (11, [-0.0] * 8, 1), (12, None, 1), (13, base[0].tolist(), None),
            (14, [float("nan")] * 8, 1), (15, [float("inf")] + [1.0] * 7, 1), (16, [None] * 8, 1), (17, [], 1), (18, [1.0, 2.0], 1), (19, [2.0, 4.0], 1), (20, (base[3] * 1e200).tolist(), 4), (21, (base[3] * 1e-200).tolist(), 4), (22, [0.0, 1.0, 0.0], 5), (23, [-0.0, 1.0, 0.0], 5)]
    d = spark.createDataFrame(rows, KINDS).repartition(3)
    for c in ("id", "v", "n", "h", "comp", "clique", "_rid", "rank"):
        d = d.withColumn(c, d["label"])
    got = sorted((tuple(r) for r in near_vectors.near_vectors(d).collect()), key=str)
    want = plain([r for r in rows if r[0] not in (20, 21)])[1] + [(20, 1, 20, True), (21, 1, 20, False)]  # plain squares overflow there
    assert got == sorted(want, key=str)
    assert near_vectors.near_vectors(d.limit(0)).count() == 0
    assert [tuple(r) for r in near_vectors.near_vectors(d.where("vec_id = 12")).collect()] == [(12, 0, 12, True)]


def crowd(seed, n, copies, d=32):
    """n vectors of one label, a third of them within a tight group, pairs at the threshold, and exact copies."""
    rng = np.random.default_rng(seed)
    x = list(rng.standard_normal((n, d)))
    centre = rng.standard_normal(d)
    x += [near(rng, centre, 0.995) for _ in range(n // 2)]
    x += [near(rng, x[i], 0.931 + 0.06 * i / n) for i in range(0, n, 3)]
    x += [x[0]] * copies
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


@pytest.mark.parametrize("window", (8, 32))
def test_a_crowd_keeps_its_links(spark, window):
    """Windows far smaller than the groups: links of the tight group and of copies are all counted, those of other pairs found as far as the recall asked for says."""
    rows = crowd(2, 400, 150)
    d = spark.createDataFrame(rows, KINDS).repartition(5)
    got = {r.vec_id: r for r in near_vectors.near_vectors(d, window=window, recall=0.99, at_once=3).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= true).all()
    group = range(400, 600)
    assert (found[group] >= 0.97 * true[group]).all() and (found[734:] == true[734:]).all()
    pairs = [i for i in range(400) if 0 < true[i] < 5]
    assert len(pairs) > 90 and found[pairs].sum() >= 0.97 * true[pairs].sum()
    assert {got[i].component_id for i in group} == {got[400].component_id}


def test_passes_grow_with_the_label():
    needed = [near_vectors.passes_needed(n, 128, 0.93, 0.99) for n in (1, 128, 10**4, 10**6, 10**9)]
    assert needed[:2] == [1, 1] and needed == sorted(needed) and needed[-1] < 120
