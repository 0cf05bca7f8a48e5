"""Registry rules, and a sample of queries against their SQL twins on the smallest tables.

The full comparison is `python tools/check.py`.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["topk_missing_issuers", "stream_dedupe", "checked_join", "quarantined_prices", "partitioned_orders", "weight_sanity", "finite_signals", "invalid_prices", "prices_panel", "momentum_topk_monthly", "pit_universe", "asof_fundamentals", "split_factor", "drift_moments", "turnover"]


def test_registry():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 100
    # Iterative search and fitted models; the training-data operators keep their own list.
    assert set(QUERIES) - set(ORACLES) == {"basket_beam", "ensemble_predictions", "walk_forward_ic", "policy_grid"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in os.listdir(SF):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{table}')")
    df = entry_module.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    rel = db.execute(entry_module.oracle_sql()[name])
    order = [[d[0] for d in rel.description].index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
