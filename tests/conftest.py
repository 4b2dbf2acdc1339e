import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from patronage.session import local_session  # noqa: E402
from patronage.sources.tables import (  # noqa: E402
    NAMES_SCHEMA,
    SALES_SCHEMA,
    TOKEN_PRICES_SCHEMA,
    TRANSFERS_SCHEMA,
    Tables,
)

import __spark_entry__ as E  # noqa: E402

#: Queries of the library itself; those on training text have tests of their own.
CORE_KEYS = sorted(k for k in E.queries() if not k.startswith("op") and k != "pipeline")
SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="patronage-tests")
    yield s
    s.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def wallet(n: int) -> str:
    return "0x" + str(n).rjust(40, "0")


def contract(letter: str) -> str:
    return "0x" + letter * 40


@pytest.fixture
def make_tables(spark):
    """Build the four tables from small row lists (missing tables are empty)."""

    def build(transfers=(), sales=(), prices=(), names=()):
        return Tables(
            spark.createDataFrame(list(transfers), TRANSFERS_SCHEMA),
            spark.createDataFrame(list(sales), SALES_SCHEMA),
            spark.createDataFrame(list(prices), TOKEN_PRICES_SCHEMA),
            spark.createDataFrame(list(names), NAMES_SCHEMA),
        )

    return build
