"""Every query against its SQL, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomspan.plans.oracles import CORPUS, ORACLES
from loomspan.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, found.fetchall())


def test_every_verse_is_searched_for(spark, duck):
    asked = {r.query_id for r in QUERIES["crossref_links_all"](spark, DATA).select("query_id").distinct().collect()}
    verses = duck.execute(f"WITH {CORPUS} SELECT 'v' || surah || ':' || ayah FROM corpus WHERE surah IS NOT NULL AND length(text) > 200").fetchall()
    assert len(verses) > 20 and {v for v, in verses} <= asked
