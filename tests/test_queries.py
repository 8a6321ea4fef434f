"""Every query against its SQL twin on the smallest tables, and the shapes of some plans."""

import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
NAMES = sorted(n for part in __spark_entry__.SLICES for n in part.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=names.__getitem__)
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_plan_shapes(spark):
    q = __spark_entry__.queries()
    for name in ("lexical_top5_lines", "lexical_scored", "expanded_search_lexical", "content_overlap_rank"):
        shape = plan(q[name](spark, FOLDER))
        assert "WindowGroupLimit" in shape or name in ("expanded_search_lexical",)
        assert "NestedLoop" not in shape and "Cartesian" not in shape
    assert "TakeOrderedAndProject" in plan(q["conversations_recent"](spark, FOLDER))
    assert "LeftSemi" in plan(q["batch_key_lookup_semi"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(q["dynasty_counts_all"](spark, FOLDER))
