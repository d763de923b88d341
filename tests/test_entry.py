import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_and_sql_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["industry", "company_count"] and df.count() > 0


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    from vinculo.runtime import discard, durable

    df = durable(spark.range(3))
    files = df.inputFiles()
    assert files and all(f.startswith(spark.conf.get("spark.checkpoint.dir").replace("file://", "file://")) or "/tables/" in f for f in files)
    discard(df)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
