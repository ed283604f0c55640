"""The contract: registered queries equal their DuckDB text on the smallest tables."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["k01_boq_roundtrip", "d03_content_key", "d04_prefer_fold", "d08_parent_completion", "e04_serial_fill", "e10_history_budget", "c01_best_pages", "c07_outside_spans", "c17_apply_changes", "h20_portal_datetime", "h12_norm_num", "k08_sweep", "k09_anchors", "g04_regions", "h25_model_rows"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in cols) for r in df.collect()) == key(tuple(r[k] for k in at) for r in cur.fetchall())


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
