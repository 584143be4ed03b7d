"""Every core query against its SQL on the smallest tables, where they are there."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sentline.plans import queries as core

SF = os.environ.get("SENTLINE_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def connection(sf=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(None if v is None or v is pd.NA or v != v else round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = connection().sql(core.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_rtf_round_trip(spark):
    got = {r.doc_id: r.text for r in core.QUERIES["q_rtf_text"](spark, SF).collect()}
    assert got and all(v is not None for v in got.values())


def test_row_wise_plan(spark):
    plan = core.QUERIES["q_sentences"](spark, SF)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "PushedFilters" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
