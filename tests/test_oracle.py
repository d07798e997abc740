"""Registered queries against their DuckDB twins on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

from .conftest import SF_SMALL

KEYS = ["market_snapshot", "census_parse", "silver", "gold_property", "gold_lead", "forecast_all", "group_kfold", "irr",
        "investment_scores", "loan_balance", "motivated_label", "roc_auc", "stratified_split",
        "global_median_fill", "route_unknown", "request_dedupe", "write_partitioned", "table_exists_fallback", "records_to_json",
        "payload_explode", "lineage_cols", "holdout_by_group", "create_namespace", "scan_table", "write_overwrite", "join_rent_left"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_rows_only():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(sqls) >= 100
