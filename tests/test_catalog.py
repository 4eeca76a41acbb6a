"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from loomworks import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    wanted = duck.execute("SELECT " + ",".join(f'"{c}"' for c in columns) + f" FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, wanted))


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    """A subpackage that is gone, or that lacks what it imports, leaves the other queries as they are."""
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # as if it were not there
    try:
        importlib.reload(entry)
        assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from loomworks.sources import scratch

    def session(master, folder):
        context = SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)

    assert scratch.shared_folder(session("spark://h:7077", "hdfs://x")) == "hdfs://x/loomworks/a"
    assert scratch.shared_folder(session("local[4]", None)).startswith("file://")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_folder(session(master, None))
