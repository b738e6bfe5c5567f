import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from annalist import History, session  # noqa: E402
from annalist.schema import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.build(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def table(spark):
    """A DataFrame of a history table from tuples in schema order; missing tail is NULL."""
    def make(name, rows):
        width = len(SCHEMAS[name])
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], SCHEMAS[name])

    return make


@pytest.fixture(scope="session")
def make_history(table):
    def make(**tables):
        return History(**{name: table(name, rows) for name, rows in tables.items()})

    return make


def dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
