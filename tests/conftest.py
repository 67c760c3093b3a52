import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import local_session

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def empty_tables(spark, data, tmp_path_factory):
    """Every table of the data folder without rows."""
    folder = tmp_path_factory.mktemp("empty")
    for path in Path(data).iterdir():
        spark.createDataFrame([], spark.read.parquet(str(path)).schema).write.parquet(str(folder / path.name))
    return str(folder)


@pytest.fixture(scope="session")
def clashing_tables(spark, data, tmp_path_factory):
    """The tables with extra columns whose names are used inside the operators."""
    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("clashing")
    extra = "block kind t x n key token class tokens ids words word u m y a b entity day at span core hard timed order uses passes rest fits gap closing budget score flagged".split()
    for path in Path(data).iterdir():
        df = spark.read.parquet(str(path))
        df.withColumns({c: F.lit("clash") for c in extra if c not in df.columns}).write.parquet(str(folder / path.name))
    return str(folder)
