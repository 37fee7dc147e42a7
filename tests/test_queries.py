"""Registry checks and a few queries against their SQL twins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    assert set(entry.BASE) <= set(entry.oracle_sql())
    assert len(entry.BASE) > 140


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="supplied tables are not here")
@pytest.mark.parametrize("name", ["quarter_snapshot", "ageing", "contractor_ranking", "update_gaps", "row_classes", "payment_matches",
                                  "bucket_merge", "landing_posts", "assignment_history", "claim_page", "batch_plan", "gated_panel", "shape_gate"])
def test_query_equals_its_twin(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    frame = entry.queries()[name](spark, SMALL)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, result.fetchall())
