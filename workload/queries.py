"""Spark side of every checked query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions import ids, values
from spendlens.operators import attribution, bloom, filters, flow as links_of, metrics, ranking, scaling
from spendlens.plans import contribution, distribution, flows, placement, rollup, score, trend
from spendlens.sources import normalize, tables
from workload.fixtures import campaign_summary, monthly_promotions, read, sales_report

CAMPAIGN = "7"
SKU = "7"
START, END = "1996-03-01", "1999-06-30"
DAY_ONE = "1995-06-01"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


NUDGE = 1e-9  # lifts values that end in a 5 off the tie, where engines round differently


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Types and rounding on which both engines agree."""
    columns = []
    for field in df.schema:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + NUDGE, digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def exact(df: DataFrame) -> DataFrame:
    """Types alone on which both engines agree: the rounding is the operator's own."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema
    ])


# --- ingest and row expressions ---------------------------------------------


def as_cells(df: DataFrame, vary: Column, ids_: list[str], dates: list[str], quarter: float) -> DataFrame:
    """The report as its files have it: text, with ids like ``7.0`` and ``7.b``, days as text, ``yyyyMMdd`` or numbers, and NaN."""
    serial = F.datediff(F.col(dates[0]), F.lit("1899-12-30").cast("date"))
    day = (
        F.when(vary % 3 == 0, F.concat(serial.cast("string"), F.lit(str(quarter)[1:])))
        .when(vary % 3 == 1, F.date_format(dates[0], "yyyyMMdd"))
        .otherwise(F.date_format(dates[0], "yyyy-MM-dd"))
    )
    cells = {}
    for name, kind in df.dtypes:
        text = F.col(name).cast("string")
        if name in dates:
            cells[name] = day
        elif name in ids_:
            cells[name] = F.when(vary % 2 == 0, F.concat(text, F.lit(".0"))).when(vary % 4 == 1, F.concat(text, F.lit(".b"))).otherwise(text)
        elif kind == "double":
            cells[name] = F.coalesce(text, F.lit("NaN"))
        elif kind == "bigint":
            cells[name] = F.concat(text, F.lit(".0"))
        else:
            cells[name] = text
    return df.select(*[c.alias(n) for n, c in cells.items()])


@query
def normalize_campaign(spark, sf):
    report = campaign_summary(spark, sf, product=True)
    cells = as_cells(report, F.col("clicks"), ["campaign_id", "promoted_sku", "promoted_product_id"], ["date"], 0.0)
    return plain(normalize.normalize_campaign(cells))


@query
def normalize_sales(spark, sf):
    report = sales_report(spark, sf).drop("date")
    cells = as_cells(report, F.col("purchased_sku").cast("int"), ["campaign_id", "purchased_sku"], ["order_date"], 0.75)
    typed = normalize.normalize_sales(cells).withColumn("order_hour", F.hour("order_date"))
    return plain(typed.withColumn("order_date", F.col("order_date").cast("date")))


@query
def date_bounds(spark, sf):
    return filters.date_bounds(campaign_summary(spark, sf))


@query
def filter_date_range(spark, sf):
    rows = filters.between_dates(campaign_summary(spark, sf), START, END)
    return plain(rows.select("date", "campaign_id", "promoted_sku", "total_sales", "clicks"))


@query
def filter_campaign(spark, sf):
    rows = filters.for_key(campaign_summary(spark, sf), "campaign_id", CAMPAIGN)
    return plain(rows.select("date", "campaign_id", "placement_type", "spend", "impressions"))


@query
def drop_missing_keys(spark, sf):
    rows = filters.drop_missing(campaign_summary(spark, sf), ["campaign_id", "promoted_sku"])
    return plain(rows.select("date", "campaign_id", "promoted_sku", "total_sales"))


@query
def canonical_id_text(spark, sf):
    text = F.concat(F.col("l_partkey").cast("string"), F.lit(".0"))
    lines = read(spark, sf, "lineitem").select("l_orderkey", text.alias("raw_id"))
    return lines.withColumn("sku", ids.canonical_id("raw_id"))


@query
def numeric_id_text(spark, sf):
    key = F.col("l_partkey").cast("string")
    raw = (
        F.when(F.col("l_partkey") % 50 == 0, None)
        .when(F.col("l_partkey") % 7 == 0, F.concat(key, F.lit(".0")))
        .when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("x"), key))
        .otherwise(key)
    )
    lines = read(spark, sf, "lineitem").select("l_orderkey", raw.alias("raw_id"))
    return lines.withColumn("sku", ids.numeric_id_text("raw_id"))


@query
def parse_date_lenient(spark, sf):
    day = F.col("l_shipdate").cast("date").cast("string")
    raw = F.when(F.col("l_linenumber") == 1, "bad").when(F.col("l_linenumber") != 2, day)
    lines = read(spark, sf, "lineitem").select("l_orderkey", raw.alias("raw_date"))
    return lines.withColumn("date", ids.parse_date_lenient("raw_date"))


@query
def project_rename(spark, sf):
    names = {"campaign_id": "campaign", "promoted_sku": "sku", "total_sales": "sales"}
    return plain(filters.project(campaign_summary(spark, sf), list(names), names))


@query
def label_flag(spark, sf):
    sales = attribution.promoted_sales(sales_report(spark, sf), monthly_promotions(spark, sf))
    return plain(sales.select("campaign_id", "is_promoted", values.label_flag("is_promoted").alias("category")))


@query
def zero_to_epsilon(spark, sf):
    rows = campaign_summary(spark, sf).select("campaign_id", "date", "spend")
    return plain(rows.withColumn("weight", values.zero_to_epsilon("spend")), 8)


@query
def pair_key(spark, sf):
    rows = links_of.flow_rows(campaign_summary(spark, sf))
    return rows.select(ids.pair_key("campaign_id", "promoted_sku").alias("pair")).select("pair.*").distinct()


@query
def round_metrics(spark, sf):
    return exact(values.round_metrics(metrics.campaign_overview(campaign_summary(spark, sf), None), 2))


@query
def metric_text(spark, sf):
    overview = metrics.campaign_overview(campaign_summary(spark, sf), None)
    cents = overview.withColumns({m: F.round(m, 2) for m in ("total_sales", "spend")})
    long = metrics.long_metrics(cents, ["campaign_id"])
    return long.select(
        "campaign_id", "metric", values.metric_text("value", values.unit_of("metric")).alias("value_text")
    )


@query
def unit_lookup(spark, sf):
    profile = metrics.metric_profile(campaign_summary(spark, sf))
    return plain(profile.select("metric", "max_value", values.unit_of("metric").alias("unit")))


@query
def metric_class(spark, sf):
    return plain(metrics.metric_classes(campaign_summary(spark, sf)))


@query
def percent_of(spark, sf):
    rows = campaign_summary(spark, sf).select("campaign_id", "date", "spend", "total_sales")
    return plain(rows.withColumn("pct", values.percent_of("spend", "total_sales")))


# --- aggregations ------------------------------------------------------------


@query
def basic_facts(spark, sf):
    return metrics.basic_facts(campaign_summary(spark, sf))


@query
def metric_profile(spark, sf):
    return plain(metrics.metric_profile(campaign_summary(spark, sf)))


@query
def campaign_overview(spark, sf):
    return exact(metrics.campaign_overview(campaign_summary(spark, sf), 2))


@query
def metric_totals_sum(spark, sf):
    return plain(metrics.metric_totals(campaign_summary(spark, sf), "campaign_id", "total_sales"))


@query
def metric_totals_mean(spark, sf):
    return plain(metrics.metric_totals(campaign_summary(spark, sf), "promoted_sku", "roas"))


def two_loads(spark, sf):
    """States of the campaign report, loaded in two parts and a third that is empty, under a name of their own."""
    name, rows = f"campaign-{uuid.uuid4().hex}", campaign_summary(spark, sf)
    for part in (F.col("date") < "1998-01-01", F.col("date") >= "1998-01-01", F.lit(False)):
        rollup.add_load(spark, name, rows.filter(part))
    return name


@query
def rolled_overview(spark, sf):
    states = rollup.day_states(spark, two_loads(spark, sf))
    return plain(rollup.merged_metrics(states, ["campaign_id"], ["total_sales", "clicks", "ctr", "roas"]))


@query
def rolled_sku_totals(spark, sf):
    states = rollup.sku_states(spark, two_loads(spark, sf))
    return plain(rollup.merged_metrics(states, ["promoted_sku"], ["roas"]).withColumnRenamed("roas", "value"))


@query
def rolled_trend(spark, sf):
    states = rollup.day_states(spark, two_loads(spark, sf))
    return plain(rollup.merged_sums(states, ["date", "campaign_id", "placement_type"], ["roas"]).withColumnRenamed("roas", "value"))


@query
def rolled_placement(spark, sf):
    name = two_loads(spark, sf)
    rollup.compact(spark, name)
    return plain(rollup.merged_metrics(rollup.day_states(spark, name), ["placement_type"]))


@query
def rolled_facts(spark, sf):
    """Sketched basic facts of some years beside the exact ones."""
    states = rollup.campaign_states(spark, two_loads(spark, sf))
    found = rollup.merged_facts(states, START, END)
    exact_facts = metrics.basic_facts(filters.between_dates(campaign_summary(spark, sf), START, END))
    both = exact_facts.withColumn("found", found.select(F.struct("*")).scalar())
    within = F.abs(F.col("found.n_campaigns") - F.col("n_campaigns")) <= F.greatest(0.05 * F.col("n_campaigns"), F.lit(1))
    return both.select("n_campaigns", "min_date", "max_date", within.alias("within_bound"),
                       ((F.col("found.min_date") == F.col("min_date")) & (F.col("found.max_date") == F.col("max_date"))).alias("same_dates"))


@query
def footer_bounds(spark, sf):
    """First and last date of a durable table from its files' footers."""
    name = f"campaign_{uuid.uuid4().hex}"
    tables.register(campaign_summary(spark, sf), name, durable=True)
    found = tables.stored_bounds(spark, name)
    bounds = spark.createDataFrame([found.first()], found.schema)
    spark.sql(f"DROP TABLE `{name}`")
    return bounds


@query
def long_list_members(spark, sf):
    """Report rows of the SKUs that were bought, a list too long to broadcast: a Bloom filter, then the exact join."""
    bought = filters.distinct_values(filters.drop_missing(sales_report(spark, sf), ["purchased_sku"]), ["purchased_sku"])
    keys = bought.filter("purchased_sku LIKE '%7'").withColumnRenamed("purchased_sku", "promoted_sku")
    rows = campaign_summary(spark, sf).select("date", "campaign_id", "promoted_sku", "clicks")
    return filters.keep_members(rows.filter(bloom.may_be_in(keys, "promoted_sku", keys.count())), keys, "promoted_sku")


@query
def trend_series(spark, sf):
    return plain(metrics.trend_series(campaign_summary(spark, sf), "roas"))


@query
def comparison_series(spark, sf):
    return plain(trend.compare(campaign_summary(spark, sf), CAMPAIGN, ["total_sales", "ctr"], START, END).series)


@query
def sku_daily(spark, sf):
    return plain(trend.campaign_skus(campaign_summary(spark, sf, product=True), CAMPAIGN, START, END).daily)


@query
def placement_totals(spark, sf):
    return plain(metrics.placement_totals(campaign_summary(spark, sf)))


@query
def placement_daily(spark, sf):
    return plain(placement.placement(campaign_summary(spark, sf), START, END).daily)


@query
def others_total(spark, sf):
    grouped = metrics.metric_values(campaign_summary(spark, sf), "campaign_id")
    chosen = distribution.top_groups(grouped, "campaign_id", "clicks", 5)
    folded = distribution.fold_others(grouped.filter("metric = 'clicks'"), chosen, "campaign_id")
    return plain(folded)


@query
def top_group_means(spark, sf):
    return plain(distribution.distribution(campaign_summary(spark, sf), "campaign_id", "total_sales", 5).means)


@query
def promoted_sets(spark, sf):
    return attribution.promoted_sets(monthly_promotions(spark, sf))


@query
def promoted_lists(spark, sf):
    lists = attribution.promoted_lists(monthly_promotions(spark, sf), CAMPAIGN)
    return lists.withColumn("promoted_skus", F.array_join("promoted_skus", ","))


@query
def promoted_sales(spark, sf):
    return plain(attribution.promoted_sales(sales_report(spark, sf), monthly_promotions(spark, sf)))


@query
def promoted_daily(spark, sf):
    parts = contribution.campaign_sales(sales_report(spark, sf), monthly_promotions(spark, sf), CAMPAIGN)
    return plain(parts.daily)


@query
def flow_forward(spark, sf):
    rows = links_of.flow_rows(campaign_summary(spark, sf))
    return plain(links_of.flow_forward(rows, "campaign_id", CAMPAIGN, "roas"))


@query
def flow_reverse(spark, sf):
    rows = links_of.flow_rows(campaign_summary(spark, sf))
    forward = links_of.flow_forward(rows, "campaign_id", CAMPAIGN, "clicks")
    return plain(links_of.flow_reverse(rows, forward, "campaign_id", "clicks"))


@query
def score_inputs(spark, sf):
    return plain(metrics.score_inputs(campaign_summary(spark, sf), "promoted_sku"))


@query
def column_totals(spark, sf):
    return plain(metrics.column_totals(metrics.placement_totals(campaign_summary(spark, sf))))


@query
def sales_hierarchy(spark, sf):
    parts = contribution.promoted_contribution(sales_report(spark, sf), monthly_promotions(spark, sf))
    return plain(parts.hierarchy)


@query
def campaign_products(spark, sf):
    return trend.campaign_skus(campaign_summary(spark, sf, product=True), CAMPAIGN).products


# --- joins -------------------------------------------------------------------


@query
def attach_promoted(spark, sf):
    rows = attribution.attach_promoted(sales_report(spark, sf), monthly_promotions(spark, sf))
    return plain(rows.select("date", "campaign_id", "purchased_sku", "total_sales", "n_skus", "is_promoted"))


@query
def set_membership(spark, sf):
    rows = attribution.set_membership(sales_report(spark, sf), monthly_promotions(spark, sf))
    return plain(rows.select("date", "campaign_id", "purchased_sku", "total_sales", "is_promoted"))


@query
def semi_top_campaigns(spark, sf):
    rows = campaign_summary(spark, sf)
    totals = metrics.metric_totals(rows, "campaign_id", "total_sales")
    chosen = ranking.top_n(totals, "campaign_id").select("campaign_id")
    kept = filters.keep_members(rows, chosen, "campaign_id", rows=5)
    return plain(kept.select("date", "campaign_id", "promoted_sku", "total_sales"))


@query
def flag_promoted(spark, sf):
    rows = attribution.flag_promoted(sales_report(spark, sf), monthly_promotions(spark, sf))
    return plain(rows)


@query
def anti_top_campaigns(spark, sf):
    totals = metrics.metric_totals(campaign_summary(spark, sf), "campaign_id", "total_sales")
    chosen = ranking.top_n(totals, "campaign_id").select("campaign_id")
    return plain(filters.exclude_members(totals, chosen, "campaign_id", rows=5))


@query
def flow_products(spark, sf):
    return plain(flows.flow(campaign_summary(spark, sf, product=True), "campaign_id", CAMPAIGN).detail)


@query
def campaign_card(spark, sf):
    cards = trend.compare(campaign_summary(spark, sf), CAMPAIGN, ["clicks", "roas"], START, END).cards
    return plain(cards)


# --- ranking and windows -----------------------------------------------------


@query
def sales_contribution(spark, sf):
    by_flag = attribution.promoted_sales(sales_report(spark, sf), monthly_promotions(spark, sf))
    return plain(attribution.sales_contribution(by_flag))


@query
def metric_ranks(spark, sf):
    return plain(ranking.metric_ranks(campaign_summary(spark, sf), "promoted_sku", ["clicks", "spend", "roas"]))


@query
def rank_slice(spark, sf):
    totals = metrics.metric_totals(campaign_summary(spark, sf), "promoted_sku", "impressions")
    return plain(ranking.rank_slice(totals, "promoted_sku", 11, 30))


@query
def full_positions(spark, sf):
    totals = metrics.metric_totals(campaign_summary(spark, sf), "promoted_sku", "clicks")
    return plain(ranking.with_position(totals, ranking.descending("value", "promoted_sku")))


@query
def min_max(spark, sf):
    inputs = metrics.score_inputs(campaign_summary(spark, sf), "campaign_id")
    return plain(scaling.min_max(inputs, ["total_sales", "spend", "roas"]), 6)


@query
def flow_nodes(spark, sf):
    return flows.flow(campaign_summary(spark, sf), "campaign_id", CAMPAIGN, start=START, end=END).nodes


@query
def flow_pair_slots(spark, sf):
    return flows.flow(campaign_summary(spark, sf), "campaign_id", CAMPAIGN, start=DAY_ONE, end=START).slots


@query
def placement_share(spark, sf):
    return plain(placement.placement(campaign_summary(spark, sf), START, END).share)


@query
def heat_scale(spark, sf):
    overview = metrics.campaign_overview(campaign_summary(spark, sf), None)
    return plain(scaling.heat_scale(overview), 6)


# --- order, top-k, sets ------------------------------------------------------


@query
def sample_rows(spark, sf):
    order = ["date", "campaign_id", "promoted_product_id", "total_sales", "clicks", "spend"]
    return plain(filters.sample_rows(campaign_summary(spark, sf).select(*order), 5, order))


@query
def ranked_totals(spark, sf):
    totals = metrics.metric_totals(campaign_summary(spark, sf), "campaign_id", "spend")
    return plain(ranking.ranked_totals(totals, "campaign_id"))


@query
def top_n(spark, sf):
    totals = metrics.metric_totals(campaign_summary(spark, sf), "promoted_sku", "total_sales")
    return plain(ranking.top_n(totals, "promoted_sku", 10))


@query
def page_of(spark, sf):
    totals = metrics.metric_totals(campaign_summary(spark, sf), "promoted_sku", "total_sales")
    return plain(ranking.page_of(totals, "promoted_sku", 3))


@query
def sorted_ids(spark, sf):
    return ranking.sorted_ids(sales_report(spark, sf), "campaign_id")


@query
def distinct_in_order(spark, sf):
    order = ["date", "campaign_id", "promoted_product_id"]
    return ranking.distinct_in_order(campaign_summary(spark, sf), "promoted_sku", order)


# --- analyses ----------------------------------------------------------------


@query
def trend_top5_total_sales(spark, sf):
    return plain(trend.trend(campaign_summary(spark, sf), "total_sales").series)


@query
def trend_top5_roas(spark, sf):
    return plain(trend.trend(campaign_summary(spark, sf), "roas", start=START, end=END).series)


@query
def share_campaign_top5(spark, sf):
    return plain(distribution.distribution(campaign_summary(spark, sf), "campaign_id").shares)


@query
def share_sku_top5(spark, sf):
    rows = campaign_summary(spark, sf)
    return plain(distribution.distribution(rows, "promoted_sku", "roas", start=START, end=END).shares)


@query
def share_no_others(spark, sf):
    return plain(distribution.distribution(campaign_summary(spark, sf), n=8, combine_others=False).shares)


@query
def flow_links(spark, sf):
    return plain(flows.flow(campaign_summary(spark, sf), "campaign_id", CAMPAIGN, start=DAY_ONE, end=START).links)


@query
def flow_links_by_sku(spark, sf):
    return plain(flows.flow(campaign_summary(spark, sf), "promoted_sku", SKU, "roas").links)


@query
def score_campaign(spark, sf):
    return plain(score.score(campaign_summary(spark, sf), "campaign_id", 50, 30, 20), 6)


@query
def score_sku(spark, sf):
    return plain(score.score(campaign_summary(spark, sf), "promoted_sku", 33, 33, 34, START, END), 6)


@query
def cumulative_score(spark, sf):
    weights = {"total_sales": 0.4, "clicks": 0.3, "spend": 0.3}
    return plain(score.cumulative_score(campaign_summary(spark, sf), weights), 6)


# --- other arguments of the same operators ------------------------------------


@query
def trend_ranks_6_10(spark, sf):
    return plain(trend.trend(campaign_summary(spark, sf), "spend", 6, 10, start=START, mode="complete").series)


@query
def page_of_rank_range(spark, sf):
    totals = metrics.metric_totals(campaign_summary(spark, sf), "promoted_sku", "total_sales")
    return plain(ranking.page_of(totals, "promoted_sku", 3, value="value", low=6, high=33))


@query
def flow_products_by_sku(spark, sf):
    return plain(flows.flow(campaign_summary(spark, sf, product=True), "promoted_sku", SKU).detail)


@query
def flow_links_full(spark, sf):
    return plain(flows.flow(campaign_summary(spark, sf), "campaign_id", CAMPAIGN).links)


@query
def flow_pair_slots_full(spark, sf):
    return flows.flow(campaign_summary(spark, sf), "campaign_id", CAMPAIGN).slots


@query
def campaign_flagged_rows(spark, sf):
    return plain(contribution.campaign_sales(sales_report(spark, sf), monthly_promotions(spark, sf), CAMPAIGN).detail)


@query
def share_sku_spend(spark, sf):
    return plain(distribution.distribution(campaign_summary(spark, sf), "promoted_sku", "spend", 7).shares)


@query
def share_sku_spend_by_bounds(spark, sf):
    return plain(distribution.distribution(campaign_summary(spark, sf), "promoted_sku", "spend", 7, by_bounds=True).shares)


@query
def share_sku_cpc_by_bounds(spark, sf):
    rows = campaign_summary(spark, sf)
    return plain(distribution.distribution(rows, "promoted_sku", "cpc", 40, False, START, END, by_bounds=True).shares)
