"""Scans by segments against windows over whole groups, with one group that holds most rows, in many ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomspan.operators import corpus_ops
from loomspan.operators.segments import Segments, medians


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def made(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "a", "b", "c", None])
        out.append((source, i, r.choice([None, r.randrange(60), i // 3]), r.choice([None, None, f"p{i}"])))
    return out + [("only", 1, 5, None)]


KINDS = "source string, place long, number long, page string"


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("source", "place", "number", "page").collect()), key=str)


@pytest.mark.parametrize("seed", (1, 2))
def test_scans_equal_windows_over_whole_groups(spark, many_ranges, seed):
    rows = made(seed)
    d = spark.createDataFrame(rows, KINDS).repartition(5)
    up, filled = [], []
    for own in groups(rows).values():
        for i, row in enumerate(own):
            before = [r[2] for r in own[:i] if r[2] is not None]
            if not before or row[2] is not None and row[2] > max(before):
                up.append(row)
            behind = [r[3] for r in own[i:] if r[3] is not None]
            front = [r[3] for r in own[:i] if r[3] is not None]
            filled.append((*row[:3], behind[0] if behind else front[-1] if front else None))
    assert got(corpus_ops.increasing(d, "source", "place", "number")) == sorted(up, key=str)
    assert got(corpus_ops.fill_pages(d, "source", "place", "page")) == sorted(filled, key=str)
    near = [r for own in groups(rows).values() for r in own if r[2] is not None and any(x[2] in (r[2] - 1, r[2] + 1) for x in own if x[2] is not None)]
    assert got(corpus_ops.drop_isolated(d, "source", "number")) == sorted(near, key=str)
    mid = {s: statistics.median(x) for s, own in groups(rows).items() if (x := [r[2] for r in own if r[2] is not None])}
    assert {r.source: r.median for r in medians(d, "source", "number").collect()} == mid
    trusted = []
    for s, own in groups(rows).items():
        own = [r for r in own if r[2] is not None and abs(r[2] - mid[s]) <= 40]
        steps = [b[2] > a[2] for a, b in zip(own, own[1:], strict=False)]
        if not steps or sum(steps) / len(steps) >= 0.5:
            trusted += own
    assert got(corpus_ops.trusted_volumes(d, "source", "place", "number", spread=40, least=0.5)) == sorted(trusted, key=str)
    assert 0 < len(trusted) < len(rows)


def test_numbers_and_sums_go_on_over_ranges(spark, many_ranges):
    rows = [("one", i, i % 7, None) for i in range(300)]
    s = Segments(spark.createDataFrame(rows, KINDS).repartition(4), "source", "place")
    assert s.rows.select("_range").distinct().count() > 4
    found = {r.place: (r.n, r.s) for r in s.number("n").sum_before(F.col("number"), "s").plain().collect()}
    assert found == {i: (i, sum(j % 7 for j in range(i))) for i in range(300)}


def test_no_rows(spark):
    d = spark.createDataFrame([], KINDS)
    assert corpus_ops.increasing(d, "source", "place", "number").count() == corpus_ops.fill_pages(d, "source", "place", "page").count() == 0
    assert corpus_ops.trusted_volumes(d, "source", "place", "number").count() == corpus_ops.drop_isolated(d, "source", "number").count() == 0


@pytest.mark.parametrize("most", (10, 37, 1000, 10**6))
def test_cuts_by_size_equal_a_fold_over_whole_groups(spark, many_ranges, most):
    r = random.Random(most)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([0, 1, 3, 9, 12, 50]), None) for i in range(700)]
    want = []
    for own in groups(rows).values():
        no, held = -1, None
        for row in own:
            if held is None or held + row[2] > most:
                no, held = no + 1, 0
            held += row[2]
            want.append((*row[:2], no))
    s = Segments(spark.createDataFrame(rows, KINDS).repartition(4), "source", "place")
    assert s.rows.groupBy("source").agg(F.countDistinct("_range").alias("n")).where("n > 1").count() > 0
    found = s.cut_by_size("number", most, "no").select("source", "place", "no").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert Segments(spark.createDataFrame([], KINDS), "source", "place").cut_by_size("number", most, "no").count() == 0
