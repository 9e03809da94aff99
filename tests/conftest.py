import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from crawlspark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def values(spark):
    """Evaluate a column expression of `v` over a list of values."""
    def run(items, build, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(items)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        got = df.select("i", build(F.col("v")).alias("out")).collect()
        return [r["out"] for r in sorted(got, key=lambda r: r["i"])]
    return run
