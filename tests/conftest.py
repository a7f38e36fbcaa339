from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from loam.session import ship

    session = (
        SparkSession.builder.master("local[4]").appName("loam-tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs a query and its SQL over the same small tables and compares the rows."""
    import duckdb

    def compare(spark, query, sql, scale="sf0.001"):
        d = DATA / scale
        if not d.exists():
            pytest.skip("no test tables here")
        con = duckdb.connect()
        for p in d.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got = query(spark, str(d))
        names = sorted(got.columns)
        cur = con.execute(sql)
        have = [c[0] for c in cur.description]
        assert sorted(have) == names
        want = sorted(([tuple(r[have.index(n)] for n in names) for r in cur.fetchall()]), key=repr)
        assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == want

    return compare
