import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spendlens.schema import CAMPAIGN_SCHEMA, SALES_SCHEMA  # noqa: E402
from spendlens.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text) if text else None


def money(value):
    return None if value is None else Decimal(str(value))


def campaign_row(date, campaign, place, sku, product, sales, impr, clicks, spend, cpc, cpm, ctr, roas):
    def real(x):
        return None if x is None else float(x)

    return (day(date), campaign, place, sku, sku, product, money(sales), impr, clicks, money(spend),
            real(cpc), real(cpm), real(ctr), real(roas))


T1 = [
    campaign_row("2024-01-01", "A", "PLA", "1", "red", 100, 1000, 10, 20, 2, 20, 1, 5),
    campaign_row("2024-01-01", "A", "Banner", "2", "blue", 0, 500, 5, 10, 2, 20, 1, 0),
    campaign_row("2024-01-02", "A", "PLA", "1", "red", 50, 1000, 20, 25, 1.25, 25, 2, 2),
    campaign_row("2024-01-01", "B", "PLA", "2", "blue", 150, 2000, 10, 30, 3, 15, 0.5, 5),
    campaign_row("2024-01-02", "B", "Banner", None, "brand", 0, 100, 0, 0, None, 0, 0, None),
    campaign_row("2024-01-02", "C", "PLA", "3", "r1", 40, 400, 4, 8, 2, 20, 1, 5),
    campaign_row("2024-01-03", "C", "PLA", "3", "r2", 20, 200, 2, 4, 2, 20, 1, 5),
    campaign_row("2024-01-03", None, "PLA", "4", "x", 999, 1, 1, 1, 1, 1, 1, 1),
]
T2 = [
    ("2024-01-01", "A", "1", 10),
    ("2024-01-01", "A", "9", 30),
    ("2024-01-02", "B", "2", 5),
    ("2024-01-05", "C", "3", 7),
    ("2024-01-01", "B", "2", 15),
]


@pytest.fixture(scope="session")
def t1(spark):
    return spark.createDataFrame(T1, CAMPAIGN_SCHEMA)


@pytest.fixture(scope="session")
def t2(spark):
    rows = [(day(d), dt.datetime.fromisoformat(d), c, s, money(v)) for d, c, s, v in T2]
    return spark.createDataFrame(rows, SALES_SCHEMA)


def rows(df, *columns):
    """Rows as tuples with decimals as floats and floats rounded, sorted."""

    def plain(v):
        if isinstance(v, Decimal):
            v = float(v)
        return round(v, 6) if isinstance(v, float) else v

    picked = df.select(*columns) if columns else df
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=lambda r: [(v is None, str(v)) for v in r])
