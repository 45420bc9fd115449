"""Arithmetic that neither fails on a zero divisor nor depends on the order rows arrive in."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F

MONEY = "decimal(24,6)"


def ratio(top: Column, bottom: Column) -> Column:
    """Division as double; NULL for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def money(amount: Column) -> Column:
    """Amount in whole micros. Summing these is exact, so a retried task cannot change the last digit."""
    return amount.cast(MONEY)


def exact_sum(amount: Column) -> Column:
    return F.sum(money(amount)).cast("double")


def count_distinct_if(condition: Column, what: Column) -> Column:
    return F.countDistinct(F.when(condition, what))


def share_of_total(part: Column, whole: int = 1) -> Column:
    """Part of the total over all rows, the total standing for ``whole``. Use on an aggregated result of few
    rows only: the total window is one task."""
    return ratio(part * whole, F.sum(part).over(W.partitionBy()))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL when a variance is zero or there are no pairs (``corr`` fails there)."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
