"""Every checked query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from workload.compare import connect, difference
from workload.oracle import ORACLE
from workload.queries import QUERIES
from workload.fixtures import campaign_summary, monthly_promotions, sales_report

COUNTS = {  # rows, campaigns, SKUs, rows without SKU, rows without return
    "0.001": (6_000, 10, 196, 128, 361),
    "0.01": (60_000, 100, 1_960, 1_217, 3_799),
}
MATCHES = {  # promotion rows, promoted, not promoted, unmatched sales rows
    "0.001": (6_000, 3_691, 2_264, 45),
    "0.01": (60_000, 35_537, 24_027, 436),
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert difference(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF_SMALL) is None


@pytest.mark.parametrize("sf", list(COUNTS))
def test_fixture_counts(spark, sf):
    df = campaign_summary(spark, f"/root/testdata/sf{sf}")
    found = df.selectExpr(
        "count(*)", "count(DISTINCT campaign_id)", "count(DISTINCT promoted_sku)",
        "count_if(promoted_sku IS NULL)", "count_if(roas IS NULL)",
    ).first()
    assert tuple(found) == COUNTS[sf]


@pytest.mark.parametrize("sf", list(MATCHES))
def test_match_counts(spark, sf):
    from spendlens.operators.attribution import flag_promoted

    folder = f"/root/testdata/sf{sf}"
    promotions = monthly_promotions(spark, folder)
    flagged = flag_promoted(sales_report(spark, folder), promotions)
    by_status = dict(flagged.groupBy("match_status").count().collect())
    found = (promotions.count(), by_status["promoted"], by_status["not_promoted"], by_status["unmatched"])
    assert found == MATCHES[sf]


@pytest.mark.parametrize("name", ["round_metrics", "campaign_overview"])
def test_rows_prove_the_rounding(spark, duck, monkeypatch, name):
    from spendlens.functions import values
    from spendlens.operators import metrics

    overview = metrics.campaign_overview
    monkeypatch.setattr(values, "round_metrics", lambda df, digits: df)
    monkeypatch.setattr(metrics, "campaign_overview", lambda df, digits: overview(df, None))
    assert difference(spark, duck, QUERIES[name], ORACLE[name], SF_SMALL) is not None


def test_one_campaign_is_picked_at_the_scan(spark, tmp_path):
    from spendlens.operators import flow

    campaign_summary(spark, SF_SMALL).write.parquet(str(tmp_path / "report"))
    rows = flow.chosen_rows(spark.read.parquet(str(tmp_path / "report")), "campaign_id", "7")
    plan = flow.flow_forward(rows, "campaign_id", "7", "clicks")._jdf.queryExecution().toString()
    assert "StringStartsWith(campaign_id,7)" in plan


def test_sales_travel_once_to_be_flagged(spark, tmp_path):
    """One exchange of sales rows and sets together, besides that of the distinct sets."""
    from spendlens.operators import attribution
    from workload.fixtures import monthly_promotions, sales_report

    sales_report(spark, SF_SMALL).write.parquet(str(tmp_path / "sales"))
    monthly_promotions(spark, SF_SMALL).write.parquet(str(tmp_path / "campaign"))
    sales, campaign = (spark.read.parquet(str(tmp_path / name)) for name in ("sales", "campaign"))
    flagged = attribution.flag_promoted(sales, campaign)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("+- Sort [") == 1
    assert "Join" not in plan and flagged.count() == sales.count()
