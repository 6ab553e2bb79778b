"""Sales of promoted and other SKUs.

A sale counts as promoted when its campaign promoted the purchased SKU on the
same day.  The promoted SKUs of a campaign-day stay one row per SKU; summaries
first add sales up to one row per (campaign, day, SKU), so the join meets each
key once on either side.  Row detail brings sales and sets together by
campaign-day in one exchange and deals out frequent days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.checks import check_choice
from spendlens.functions.values import label_flag, percent_of, sum_or_zero
from spendlens.operators.filters import drop_missing, for_key
from spendlens.operators.skew import heavy_keys

DAY = ["campaign_id", "date"]


def promoted_days(campaign: DataFrame) -> DataFrame:
    """Campaign-days with any report row, one row each."""
    return drop_missing(campaign, DAY).select(*DAY).distinct()


def promoted_skus(campaign: DataFrame) -> DataFrame:
    """Distinct (campaign, date, promoted SKU)."""
    return drop_missing(campaign, [*DAY, "promoted_sku"]).select(*DAY, "promoted_sku").distinct()


def day_sizes(campaign: DataFrame) -> DataFrame:
    """(campaign, date, n_skus): distinct promoted SKUs of each campaign-day, 0 where all rows lack one."""
    skus = drop_missing(campaign, DAY).select(*DAY, "promoted_sku").distinct()
    return skus.groupBy(*DAY).agg(F.count("promoted_sku").alias("n_skus"))


def promoted_sets(campaign: DataFrame) -> DataFrame:
    """(campaign, date, promoted_sku, n_skus): the promoted SKUs of every
    campaign-day, one row each, with their number.  A day whose rows all lack
    an SKU has one row, without SKU and with 0."""
    sizes = day_sizes(campaign)
    skus = promoted_skus(campaign).join(sizes.filter("n_skus > 0"), DAY)
    empty = sizes.filter("n_skus = 0").select(*DAY, F.lit(None).cast("string").alias("promoted_sku"), "n_skus")
    return skus.unionByName(empty)


def promoted_lists(campaign: DataFrame, chosen: str) -> DataFrame:
    """(date, n_skus, promoted_skus) of one campaign, the SKUs as a sorted array, for display."""
    sets = promoted_sets(for_key(campaign, "campaign_id", chosen))
    return sets.groupBy("date", "n_skus").agg(F.array_sort(F.collect_list("promoted_sku")).alias("promoted_skus"))


def attach_promoted(sales: DataFrame, campaign: DataFrame) -> DataFrame:
    """Every sales row with ``n_skus``, the size of its campaign-day's promoted
    set (missing where there is no such day), and ``is_promoted``, whether the
    set has its SKU.

    Sales and sets travel once, together, to the task of their campaign-day, and
    both answers are read off the sorted rows there.  A day with more sales
    than one task's share is dealt out, its set repeated for each share.
    """
    [heavy] = heavy_keys(sales, DAY)
    shares = F.coalesce(F.try_element_at(heavy, F.xxhash64(*DAY)), F.lit(1))
    share = F.pmod(F.xxhash64(F.spark_partition_id(), *sales.columns), shares).cast("int")
    dealt = sales.withColumns({"_salt": F.when(shares > 1, share).otherwise(0), "_sku": F.col("purchased_sku"), "_set": F.lit(False)})
    skus = drop_missing(campaign, DAY).select(*DAY, F.col("promoted_sku").alias("_sku")).distinct()
    sets = skus.withColumns({"_salt": F.explode(F.sequence(F.lit(0), shares - 1)), "_set": F.lit(True)})
    placed = dealt.unionByName(sets, allowMissingColumns=True).repartition(*DAY, "_salt")
    member = F.col("_set") & F.col("_sku").isNotNull()
    sku = Window.partitionBy(*DAY, "_salt", "_sku")
    # in the order of the SKUs, though it needs none: the rows are then sorted once
    day = Window.partitionBy(*DAY, "_salt").orderBy("_sku").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = placed.withColumn("is_promoted", F.max(member).over(sku))
    met = met.withColumn("n_skus", F.when(F.max("_set").over(day), F.count_if(member).over(day)))
    return met.filter(~F.col("_set")).select(*sales.columns, "n_skus", "is_promoted")


def set_membership(sales: DataFrame, campaign: DataFrame) -> DataFrame:
    """Sales rows with ``is_promoted``."""
    return attach_promoted(sales, campaign).drop("n_skus")


def flag_promoted(sales: DataFrame, campaign: DataFrame, on_unmatched: str = "flag") -> DataFrame:
    """Every sales row with ``is_promoted`` and ``match_status``.

    ``unmatched`` marks rows whose campaign has no report row on that day; they
    count as not promoted.  ``on_unmatched="error"`` fails the job on them.
    """
    attached = attach_promoted(sales, campaign)
    status = F.when(F.col("is_promoted"), "promoted").when(F.col("n_skus").isNotNull(), "not_promoted")
    return attached.withColumn("match_status", status.otherwise(_unmatched(on_unmatched))).drop("n_skus")


def _unmatched(on_unmatched: str) -> Column:
    check_choice(on_unmatched, ("flag", "error"), "on_unmatched")
    if on_unmatched == "error":
        return F.raise_error(F.lit("sales row without a campaign report of its day")).cast("string")
    return F.lit("unmatched")


def _hits(campaign: DataFrame) -> DataFrame:
    named = promoted_skus(campaign).withColumnRenamed("promoted_sku", "purchased_sku")
    return named.withColumn("_hit", F.lit(True))


def _flagged_sums(sales: DataFrame, campaign: DataFrame, key: str, on_unmatched: str = "flag") -> DataFrame:
    """Sales by key and promoted flag, joined after adding up."""
    unmatched = _unmatched(on_unmatched)
    by_sku = drop_missing(sales, [key]).groupBy(*DAY, "purchased_sku").agg(F.sum("total_sales").alias("total_sales"))
    flagged = by_sku.join(_hits(campaign), [*DAY, "purchased_sku"], "left")
    promoted = F.col("_hit").isNotNull()
    if on_unmatched == "error":
        flagged = flagged.join(promoted_days(campaign).withColumn("_day", F.lit(True)), DAY, "left")
        promoted = F.when(F.col("_day").isNull(), unmatched.cast("boolean")).otherwise(promoted)
    flagged = flagged.withColumn("is_promoted", promoted)
    sums = flagged.groupBy(key, "is_promoted").agg(sum_or_zero("total_sales").alias("total_sales"))
    return sums.withColumn("category", label_flag("is_promoted"))


def promoted_sales(sales: DataFrame, campaign: DataFrame, on_unmatched: str = "flag") -> DataFrame:
    """Sales by (campaign, promoted flag); ``on_unmatched`` as in ``flag_promoted``."""
    return _flagged_sums(sales, campaign, "campaign_id", on_unmatched)


def promoted_daily(sales: DataFrame, campaign: DataFrame, chosen: str) -> DataFrame:
    """Sales of one campaign by (date, promoted flag)."""
    own = for_key(sales, "campaign_id", chosen)
    return _flagged_sums(own, for_key(campaign, "campaign_id", chosen), "date")


def sales_contribution(by_flag: DataFrame) -> DataFrame:
    """Add the campaign's total and each category's percent of it."""
    whole = F.sum("total_sales").over(Window.partitionBy("campaign_id"))  # two rows per campaign
    share = percent_of("total_sales", "campaign_total")
    return by_flag.withColumn("campaign_total", whole).withColumn("contribution_pct", share)


def sales_hierarchy(by_flag: DataFrame) -> DataFrame:
    """(campaign, category, total_sales, level, pct of all sales) for the total
    (level 0), each campaign (1) and each campaign's categories (2)."""
    whole = by_flag.agg(F.sum("total_sales")).scalar()
    levels = by_flag.rollup("campaign_id", "category").agg(
        F.sum("total_sales").alias("total_sales"),
        (2 - F.bit_count(F.grouping_id())).cast("long").alias("level"),
    )
    return levels.withColumn("pct", percent_of("total_sales", whole))
