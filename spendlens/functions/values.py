"""Expressions over metric values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.ids import _col
from spendlens.schema import EPSILON, METRICS, NON_PROMOTED_LABEL, PROMOTED_LABEL


def agg_for(metric: str, source: Column | str | None = None) -> Column:
    """Aggregate of one metric by its class: 0-for-nothing sum, or plain mean
    of the row values."""
    column = _col(source if source is not None else metric)
    if METRICS[metric].kind == "mean":
        return F.avg(column)
    return sum_or_zero(column)


def sum_or_zero(c: Column | str) -> Column:
    """Sum in which a group without any value counts 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    """``part / whole * 100``; NULL when the whole is 0."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double")) * 100


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Position of a value between low and high, 0 to 1; NULL when they meet."""
    value, low, high = (c.cast("double") for c in (value, low, high))
    return F.try_divide(value - low, high - low)


def zero_to_epsilon(c: Column | str, eps: float = EPSILON) -> Column:
    """Exact 0 as a tiny value, so a link of weight 0 stays visible."""
    value = _col(c).cast("double")
    return F.when(value == 0, F.lit(eps)).otherwise(value)


def label_flag(c: Column | str) -> Column:
    """Promoted flag as its category label."""
    return F.when(_col(c), PROMOTED_LABEL).otherwise(NON_PROMOTED_LABEL)


def is_member(value: Column | str, members: Column | str) -> Column:
    """Whether the value is in the array; false for a missing array or value."""
    return F.coalesce(F.array_contains(members, _col(value)), F.lit(False))


def unit_of(metric: Column | str) -> Column:
    """Unit of a metric name, empty for an unknown one."""
    units = F.create_map(*[F.lit(x) for name, m in METRICS.items() for x in (name, m.unit)])
    return F.coalesce(F.try_element_at(units, _col(metric)), F.lit(""))


def class_of(metric: Column | str) -> Column:
    """``sum`` or ``mean`` for a metric name."""
    kinds = F.create_map(*[F.lit(x) for name, m in METRICS.items() for x in (name, m.kind)])
    return F.try_element_at(kinds, _col(metric))


def metric_text(value: Column | str, unit: Column | str) -> Column:
    """Value with two decimals and its unit."""
    return F.format_string("%.2f %s", _col(value), _col(unit))


def rank_text(metric: Column | str, rank: Column | str) -> Column:
    """Series legend: metric name with its rank."""
    return F.format_string("%s (rank: %d)", _col(metric), _col(rank))


def round_metrics(df: DataFrame, digits: int = 2, metrics: Iterable[str] = METRICS) -> DataFrame:
    """Round metric columns half to even."""
    return df.withColumns({m: F.bround(m, digits) for m in metrics if m in df.columns})


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted sum of columns; a NULL part makes the score NULL."""
    terms = [F.lit(w) * F.col(name) for name, w in weights.items()]
    score = terms[0]
    for term in terms[1:]:
        score = score + term
    return score
