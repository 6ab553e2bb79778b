"""Random tables against a separate pandas restatement of the rules."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from spendlens.operators import attribution, metrics, ranking
from spendlens.plans import distribution, flows, placement, score, trend
from spendlens.schema import CAMPAIGN_SCHEMA, MEAN_METRICS, METRICS, SALES_SCHEMA

DAYS = [dt.date(2024, 1, d) for d in range(1, 6)]


def pick(rng, options):
    return options[rng.integers(len(options))]


def report(seed, n=120):
    """Rows with ties, missing keys and values, and ids shared by both sides."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        sku = pick(rng, ["1", "2", "3", "c1", "c2", None])
        money = [Decimal(int(rng.integers(0, 4))) for _ in range(2)]
        ratios = [pick(rng, [None, 0.0, 0.5, 1.0, 3.0]) for _ in range(4)]
        out.append((pick(rng, DAYS), pick(rng, ["c1", "c2", "c3", "c4", None]), pick(rng, ["PLA", "Banner"]), sku, sku,
                    pick(rng, ["red", "blue"]), money[0], int(rng.integers(0, 3)), int(rng.integers(0, 3)), money[1], *ratios))
    return out


def frame(data):
    pdf = pd.DataFrame(data, columns=[f.name for f in CAMPAIGN_SCHEMA])
    for m in METRICS:
        pdf[m] = pdf[m].map(lambda v: np.nan if v is None else float(v))
    return pdf


def by(pdf, keys, metric, force=None):
    kind = force or METRICS[metric].kind
    return pdf.dropna(subset=keys).groupby(keys)[metric].agg(kind)


def same(value, expected):
    if expected is None or expected != expected:
        return value is None
    return value == pytest.approx(float(expected), abs=1e-6)


@pytest.fixture(scope="module", params=[1, 2])
def tables(request, spark):
    data = report(request.param)
    return spark.createDataFrame(data, CAMPAIGN_SCHEMA), frame(data)


def test_totals_and_ranks(tables):
    df, pdf = tables
    ranked = {(r["campaign_id"], r["metric"]): r for r in ranking.metric_ranks(df).collect()}
    for m in METRICS:
        totals = by(pdf, ["campaign_id"], m)
        places = totals.rank(ascending=False, method="min")
        for key in totals.index:
            assert same(ranked[key, m]["value"], totals[key])
            assert same(ranked[key, m]["rank"], places[key])


def test_trend(tables):
    df, pdf = tables
    for m in ("clicks", "roas"):
        result = trend.trend(df, m, 1, 2, DAYS[1], DAYS[3])
        window = pdf[(pdf.date >= DAYS[1]) & (pdf.date <= DAYS[3])]
        totals = by(window, ["campaign_id"], m).reset_index().sort_values([m, "campaign_id"], ascending=[False, True])
        top = list(totals.campaign_id[:2])
        expected = by(window[window.campaign_id.isin(top)], ["date", "campaign_id", "placement_type"], m, "sum")
        found = {(r["date"], r["campaign_id"], r["placement_type"]): r for r in result.series.collect()}
        assert set(found) == set(expected.index)
        for key, value in expected.items():
            assert same(found[key]["value"], value) and found[key]["rank"] == top.index(key[1]) + 1


@pytest.mark.parametrize("by_bounds", [False, True])
@pytest.mark.parametrize("key", distribution.KEYS)
def test_distribution(tables, key, by_bounds):
    df, pdf = tables
    result = distribution.distribution(df, key, "clicks", 2, by_bounds=by_bounds)
    totals = by(pdf, [key], "clicks").reset_index().sort_values(["clicks", key], ascending=[False, True])
    top = list(totals[key][:2])
    shares = {(r["group"], r["is_others"], r["metric"]): r for r in result.shares.collect()}
    for m in [m for m in METRICS if m not in MEAN_METRICS]:
        sums = by(pdf, [key], m)
        others = sums[~sums.index.isin(top)].sum()
        whole = sums.sum()
        assert same(shares["others", True, m]["value"], others)
        assert same(shares[top[0], False, m]["pct"], sums[top[0]] / whole * 100 if whole else None)
        assert sum(r["pct"] for k, r in shares.items() if k[2] == m) == pytest.approx(100)
    means = {(r[key], r["metric"]): r["value"] for r in result.means.collect()}
    assert {k for k, _ in means} == set(top)
    for (k, m), value in means.items():
        assert same(value, by(pdf, [key], m)[k])


def test_score_bounds(tables):
    df, pdf = tables
    for r in score.score(df, "campaign_id", 40, 40, 20).collect():
        assert r["score"] is None or -0.2 - 1e-9 <= r["score"] <= 0.8 + 1e-9
    inputs = {m: by(pdf, ["campaign_id"], m) for m in ("total_sales", "spend", "roas")}
    norm = {m: (s - s.min()) / (s.max() - s.min()) for m, s in inputs.items()}
    expected = 0.4 * norm["total_sales"] + 0.4 * norm["roas"] - 0.2 * norm["spend"]
    for r in score.score(df, "campaign_id", 40, 40, 20).collect():
        assert same(r["score"], expected[r["campaign_id"]])


def test_placement(tables):
    df, pdf = tables
    result = placement.placement(df, DAYS[0], DAYS[2])
    window = pdf[pdf.date <= DAYS[2]]
    for r in result.share.collect():
        totals = by(window, ["placement_type"], r["metric"])
        assert same(r["value"], totals[r["placement_type"]])
        assert same(r["pct"], totals[r["placement_type"]] / totals.sum() * 100 if totals.sum() else None)
    assert result.daily.count() == len(window.groupby(["date", "placement_type"]))


@pytest.mark.parametrize("primary,chosen", [("campaign_id", "c1"), ("promoted_sku", "c2")])
def test_flow(tables, primary, chosen):
    df, pdf = tables
    secondary = "promoted_sku" if primary == "campaign_id" else "campaign_id"
    clean = pdf.dropna(subset=["campaign_id", "promoted_sku"])
    legs = []
    forward = by(clean[clean[primary] == chosen], [primary, secondary], "total_sales")
    reverse = by(clean[clean[secondary].isin(forward.index.get_level_values(1))], [secondary, primary], "total_sales")
    for name, leg in (("forward", forward), ("reverse", reverse)):
        legs += [(name, a, b, v or 1e-6) for (a, b), v in sorted(leg.items())]
    nodes = list(dict.fromkeys([a for _, a, _, _ in legs] + [b for _, _, b, _ in legs]))
    pairs = list(dict.fromkeys(tuple(sorted((a, b))) for _, a, b, _ in legs))
    result = flows.flow(df, primary, chosen, palette=3)
    assert dict(rows(result.nodes)) == {n: i for i, n in enumerate(nodes)}
    expected = sorted(
        (n, a, b, nodes.index(a), nodes.index(b), pairs.index(tuple(sorted((a, b)))) % 3, round(v, 6)) for n, a, b, v in legs
    )
    assert rows(result.links, "leg", "source", "target", "source_id", "target_id", "slot", "value") == expected
    twins = {(a, b) for n, a, b, _ in legs if n == "reverse"}
    assert all((b, a) in twins for n, a, b, _ in legs if n == "forward")


def test_contribution(tables, spark):
    df, pdf = tables
    rng = np.random.default_rng(9)
    sales = [
        (pick(rng, DAYS), None, pick(rng, ["c1", "c2", "c3", "c9", None]), pick(rng, ["1", "2", "9", None]), Decimal(int(v)))
        for v in rng.integers(0, 9, 80)
    ]
    sales_df = spark.createDataFrame(sales, SALES_SCHEMA)
    flagged = attribution.flag_promoted(sales_df, df)
    assert flagged.count() == len(sales)
    keyed = pdf.dropna(subset=["campaign_id"])
    sets = set(zip(keyed.campaign_id, keyed.date, keyed.promoted_sku))
    days = set(zip(keyed.campaign_id, keyed.date))

    def status(d, c, s):
        if s is not None and (c, d, s) in sets:
            return "promoted"
        return "not_promoted" if (c, d) in days else "unmatched"

    expected = sorted((str(c), str(s), float(v), status(d, c, s)) for d, _, c, s, v in sales)
    found = sorted((str(r["campaign_id"]), str(r["purchased_sku"]), float(r["total_sales"]), r["match_status"]) for r in flagged.collect())
    assert found == expected
    members = attribution.set_membership(sales_df, df)
    assert members.filter("is_promoted").count() == sum(1 for e in expected if e[3] == "promoted")
    shares = attribution.sales_contribution(attribution.promoted_sales(sales_df, df)).collect()
    for c in {r["campaign_id"] for r in shares}:
        pcts = [r["contribution_pct"] for r in shares if r["campaign_id"] == c]
        assert None in pcts or sum(pcts) == pytest.approx(100)
    levels = attribution.sales_hierarchy(attribution.promoted_sales(sales_df, df)).collect()
    top = [r for r in levels if r["level"] == 0]
    assert len(top) == 1
    assert sum(r["total_sales"] for r in levels if r["level"] == 1) == top[0]["total_sales"]
    assert sum(r["total_sales"] for r in levels if r["level"] == 2) == top[0]["total_sales"]


def test_metric_profile(tables):
    df, pdf = tables
    for r in metrics.metric_profile(df).collect():
        column = pdf[r["metric"]]
        assert same(r["max_value"], column.max()) and same(r["min_value"], column.min()) and same(r["mean_value"], column.mean())
