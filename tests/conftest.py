import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    """A value as text, doubles to nine digits, so that Spark's and DuckDB's rows can be compared."""
    if isinstance(value, float):
        return "None" if value != value else f"{value:.9g}"
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and not isinstance(value, str):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    out = []
    for row in df.itertuples(index=False):
        out.append(tuple(normal(float(v)) if isinstance(v, int) and not isinstance(v, bool) else normal(v) for v in row))
    return sorted(out)
