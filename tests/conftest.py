import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that compares and hashes alike whichever engine it came from."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return value


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """check(query, sql): the rows that a query and its SQL give on the smallest tables are the same."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")

    def check(query, sql):
        got = query(spark, folder)
        columns = sorted(got.columns)
        mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
        cursor = con.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
        assert mine == theirs

    return check
