import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from stockloom.plans import catalog, oracle  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("v11_live_inventory", "v12_history", "i10_action_result", "m5_backfill_rentals", "a17_assign_cause", "i13_ingest_stream")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(oracle.oracle_queries()) == set(catalog.registry())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    expected = compare.bag([c[0] for c in cur.description], cur.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    assert compare.bag(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_flagship(spark):
    assert entry.entry(spark).count() == 200
