"""The largest groups of very many, without grouping every row by its key.

Keys are dealt into a fixed number of buckets, and what a bucket adds up to
bounds each of its keys.  The keys of the heaviest buckets are added up exactly:
the nth of them is no larger than the nth of all.  A bucket that stays below
it holds none of the n largest, so its rows never reach the shuffle by key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.checks import check_metric
from spendlens.functions.values import sum_or_zero
from spendlens.operators.bloom import bit_at, bit_words
from spendlens.operators.filters import drop_missing
from spendlens.operators.lineage import cut
from spendlens.operators.metrics import metric_totals
from spendlens.operators.ranking import rank_slice
from spendlens.schema import METRICS, SUM_METRICS

#: Buckets of keys: the rows that a map task sends in the first pass at most, and bits of the filter in the last.
BUCKETS = 1 << 16
#: Sums of floating-point numbers in another order differ by far less than this share.
SLACK = 1e-9


class Bounded(NamedTuple):
    rows: DataFrame  # rows of the keys that can be among the n largest
    rest: DataFrame  # one row, none without groups: the sum metrics over all other rows with a key


def split_by_bounds(df: DataFrame, key: str, metric: str, n: int) -> Bounded:
    """Rows that decide the n largest groups of a sum metric, and what the others add up to.

    Nothing is estimated: every one of the n largest is in ``rows`` with all
    its rows, also with equal or negative values.  Three passes read the table;
    where groups are alike, no bucket can be left out and the last one
    groups all rows.  The first two passes run while the plan is built.
    """
    if METRICS[check_metric(metric)].kind != "sum":
        raise ValueError(f"{metric} is a mean, which sums of buckets do not bound")
    keyed = drop_missing(df, [key])
    place = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    most = F.sum(F.greatest(F.col(metric), F.lit(0))).cast("double")  # without what lowers a sum
    buckets = cut(keyed.groupBy(place.alias("place")).agg(F.coalesce(most, F.lit(0.0)).alias("most"), *[F.sum(m).alias(m) for m in SUM_METRICS]))
    heaviest = buckets.orderBy(F.desc("most"), "place").limit(n)
    tried = keyed.filter(bit_at(bit_words(heaviest, BUCKETS).scalar(), place))
    nth = rank_slice(metric_totals(tried, key, metric), key, n, n).agg(F.max(F.col("value").cast("double")).alias("nth")).scalar()
    # missing if there are fewer than n groups there
    judged = cut(buckets.withColumn("can", F.coalesce(F.col("most") >= nth - SLACK * F.abs(nth), F.lit(True))))
    can = bit_words(judged.filter("can").select("place"), BUCKETS).scalar()
    sums = [sum_or_zero(F.when(~F.col("can"), F.col(m))).alias(m) for m in SUM_METRICS]
    rest = judged.agg(F.count(F.lit(1)).alias("buckets"), *sums).filter("buckets > 0").drop("buckets")
    return Bounded(keyed.filter(bit_at(can, place)), rest)
