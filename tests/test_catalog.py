"""Each query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidewave.plans import archive, events, exports, pixels, relations, statistics, traces, waves  # noqa: F401
from tidewave.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, (tuple(None if v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) or hasattr(v, "item") and not isinstance(v, str) else v for v in r) for r in frame.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
