"""The entry module: queries against SQL on the same files, and the guard around the training-data subpackage."""

import subprocess
import sys

import duckdb
import pytest

from plumbline.plans import queries as Q


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    ours, theirs = Q.queries()[name](spark, small_dir).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    say = lambda d: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert say(ours) == say(theirs)


def test_without_the_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'double_ml' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
