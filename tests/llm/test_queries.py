"""Every query against its SQL, and the entry's rows where there is none."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from daytrace.llm import queries

SMALL = Path(entry.SMALL)
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="driver tables are not here")


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 1 + len(queries.QUERIES))]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_spark_and_sql_agree(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(SMALL))
    cursor = db.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(str(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.select(columns).collect()) == want
