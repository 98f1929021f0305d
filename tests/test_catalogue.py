"""Every query that has an oracle, against DuckDB on the same tables."""

import glob

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans import catalogue, catalogue_flow, catalogue_text  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    return c


def rows(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False, name=None):
        one = []
        for v in r:
            if v is None or v is pd.NaT or v is pd.NA or v != v:
                one.append("")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                one.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "item"):
                one.append(f"{float(v):.6g}")
            else:
                one.append(str(v))
        out.append(tuple(one))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    want = con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalogue.FIXTURES))
def test_fixture_equals_its_oracle(spark, con, name):
    run, sql = catalogue.FIXTURES[name]
    got, want = run(spark, FOLDER).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert name not in entry.queries()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["verify_needed", "swapped_bounds", "risk_low_sources", "risk_only_side", "lang_coverage_gap"])
def test_reports_of_the_whole_table_have_rows(spark, name):
    assert catalogue.QUERIES[f"{name}_all"](spark, FOLDER).count() > 0
