from pathlib import Path

import duckdb
import pytest

from loomspan.llm import secret_scan
from loomspan.llm.oracles import ORACLES
from loomspan.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def run(c, name, columns):
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(x) for x in columns]
    return sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    assert sorted((tuple(r) for r in df.collect()), key=str) == run(c, name, df.columns)


def test_secret_links_equal_their_sql_on_made_up_credentials(spark, tmp_path):
    from test_secret_url import TEXTS

    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    d.coalesce(1).write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = secret_scan.digest(secret_scan.scan_secrets(d))
    assert sorted((tuple(r) for r in got.collect()), key=str) == run(c, "op2_secret_scan", got.columns)
