import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Compares a Spark result with SQL as multisets of rows."""

    def check(df, sql):
        want, got = duck.execute(sql).df(), df.toPandas()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        want, got = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
        assert len(want) == len(got)
        for c in cols:
            differs = (want[c] != got[c]) & ~(want[c].isna() & got[c].isna())
            assert not differs.any(), (c, want[differs].head(2).to_dict("records"), got[differs].head(2).to_dict("records"))

    return check
