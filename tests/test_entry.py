import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of

from daytrace.bindings import load

SMALL = Path(entry.SMALL)
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="driver tables are not here")


QUERIES, SQL = load()
#: Each of these makes the whole investigation anew, as `findings` does, which stands for them here.
INVESTIGATED = set(
    "hypotheses evidence evidence_passes finding_counts evidence_scores baseline_agreement review_queue priority_terms"
    " queue_figures evidence_matrix coverage_lines finding_audits safety_report".split()
)


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 80


def test_flagship_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(SQL) - INVESTIGATED))
def test_spark_and_sql_agree(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, str(SMALL))
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
