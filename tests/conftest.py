import math
import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same_rows():
    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        a = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
        b = sorted(tuple(map(plain, r)) for r in relation.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())
        assert len(a) == len(b)
        assert a == b

    return check


@pytest.fixture(scope="session")
def data_dir():
    return DATA
