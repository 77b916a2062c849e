import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.local.dir", str(tmp_path_factory.mktemp("local")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    return lambda df: sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="session")
def same_as_duckdb():
    """Compare a DataFrame with SQL over the same tables, rows in any order and columns by name."""
    import duckdb
    import pandas as pd

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    def normal(df):
        df = df[sorted(df.columns)].map(plain)
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    def check(df, sql, sf_dir):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        pd.testing.assert_frame_equal(normal(df.toPandas()), normal(con.execute(sql).fetchdf()), check_dtype=False)

    return check
