"""Every registered query against its DuckDB oracle (the driver's gate),
at sf0.001 to keep the suite quick; scripts/check_parity.py runs sf0.01."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from chorus.plans import catalog, payload_catalog, write_catalog
from chorus.sources.tables import TEST_TABLES, table_path
from scripts.check_parity import rows_key

SF = "/root/testdata/sf0.001"
NAMES = sorted({**catalog.QUERIES, **payload_catalog.QUERIES, **write_catalog.QUERIES})  # the llm subpackage has its own tests


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TEST_TABLES:
        p = table_path(SF, t)
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    missing = set(NAMES) - set(E.oracle_sql())
    assert missing == set(), missing


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert rows_key(df.columns, srows) == rows_key(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["date", "category", "count", "channels"]
    assert df.count() >= 0


STORED_NAMES = [n for n in sorted(catalog.QUERIES) if n.startswith(
    ("q01", "q02", "q03", "q04", "q05", "q06", "q07", "q08", "q09", "q13_store", "q14", "q15", "q18", "q19",
     "q20", "q22", "q24", "q26", "q27"))]


@pytest.fixture(scope="module")
def store(spark):
    import tempfile

    from chorus.sources import stored
    root = tempfile.mkdtemp(prefix="chorus-store-")
    stored.write_feedback_tables(spark, SF, root)
    return root


@pytest.mark.parametrize("name", STORED_NAMES)
def test_parity_over_stored_tables(spark, con, store, name):
    """Same results when messages / alerts come from date-partitioned
    stored tables (with folder pruning) instead of per-query derivation."""
    catalog.STORE_ROOT = store
    try:
        df = E.queries()[name](spark, SF)
        srows = [tuple(r) for r in df.collect()]
    finally:
        catalog.STORE_ROOT = None
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_key(df.columns, srows) == rows_key(ocols, res.fetchall())
