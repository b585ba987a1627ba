import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyfold import queries as core

REPO = Path(entry.__file__).parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df, columns):
    return sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", core.ORACLE_SQL)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.sql(core.ORACLE_SQL[name]).df(), core.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["ord", "entity", "v", "present"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['tallyfold.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True).returncode == 0
