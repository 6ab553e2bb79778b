"""Analyses of tables without rows, and of keys that do not occur."""

import pytest

from spendlens.operators import attribution, ranking
from spendlens.plans import contribution, distribution, flows, placement, preview, score, trend
from spendlens.sources.tables import table


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, "campaign_summary"), table(spark, "sales_report")


def test_no_rows(none):
    campaign, sales = none
    assert trend.trend(campaign, "roas").series.count() == 0
    assert trend.compare(campaign, "A").cards.count() == 0
    assert ranking.metric_ranks(campaign).count() == 0
    shares = distribution.distribution(campaign)
    assert shares.shares.count() == 0 and shares.means.count() == 0
    assert score.score(campaign).count() == 0 and score.cumulative_score(campaign, {"spend": 1.0}).count() == 0
    assert placement.placement(campaign).share.count() == 0
    assert contribution.promoted_contribution(sales, campaign).contribution.count() == 0
    assert attribution.attach_promoted(sales, campaign).count() == 0


def test_preview_of_nothing(none):
    result = preview.preview(none[0])
    assert tuple(result.facts.first()) == (0, None, None)
    assert {tuple(r)[1:] for r in result.profile.collect()} == {(None, None, None)}
    assert result.heat.count() == 0


def test_unknown_keys(t1, t2):
    found = flows.flow(t1, "campaign_id", "nobody")
    assert found.links.count() == found.nodes.count() == found.detail.count() == 0
    own = contribution.campaign_sales(t2, t1, "nobody")
    assert own.daily.count() == own.detail.count() == 0
    assert trend.campaign_skus(t1, "nobody").products.count() == 0
