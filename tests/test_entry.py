import duckdb
import pytest

from lakeprobe.oracles import oracle_sql
from lakeprobe.queries import queries

SF = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries()) <= set(e.queries())


def compared(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if v is None or v != v else f"{v:.8g}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["profile_events", "null_overview", "outlier_flags", "duplicate_rows", "cramers_v", "eta_squared", "word_counts", "value_freq_topk", "pii_iban", "welch_missing_vs_numeric"])
def test_query_equals_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries()[name](spark, SF).toPandas(), con.sql(oracle_sql()[name]).df()
    got, want = (x.astype(object).where(x.notna(), None) for x in (got, want))
    assert sorted(got.columns) == sorted(want.columns) and compared(got) == compared(want)
