"""The SQL twins against the queries, on a small table each."""

import duckdb
import pytest

from lexforge.llm.oracles import ORACLES
from lexforge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """Rows as sorted strings, doubles to nine places."""
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) x").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)
