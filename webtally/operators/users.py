"""Lifetime value, cohorts and loyalty."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webtally.functions.dates import iso_week_label, week_start
from webtally.functions.numbers import ratio, safe_corr
from webtally.functions.params import flatten, in_days, named


def clv_sessions_correlation(users: DataFrame, start, end) -> DataFrame:
    """Correlation of lifetime revenue and session count over users with revenue, from daily user snapshots."""
    value = F.col("user_ltv.revenue_in_usd")
    per_user = (
        users.filter(F.col("snapshot_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
        .filter(value > 0)
        .groupBy("pseudo_user_id")
        .agg(F.max(value).alias("revenue"), F.max("user_ltv.sessions").cast("double").alias("sessions"))
    )
    return per_user.agg(F.round(safe_corr(F.col("revenue"), F.col("sessions")), 2).alias("clv_sessions_correlation"))


def cohort_retention(events: DataFrame, start, end, weeks: int = 8, rated: int = 4) -> DataFrame:
    """Users by ISO week of their first event, and how many of them came back 0 to 7 weeks later.

    One shuffle by user: a user becomes a first day and the set of active weeks, which the calendar bounds."""
    users = flatten(events.filter(in_days(start, end))).groupBy("user_pseudo_id").agg(
        F.min("event_day").alias("first_day"), F.collect_set(week_start(F.col("event_day"))).alias("active")
    )
    known = F.col("user_pseudo_id").isNotNull()
    first_week = week_start(F.col("first_day"))
    came = [F.array_contains("active", F.date_add(first_week, 7 * n)) for n in range(weeks)]
    cohorts = users.groupBy(iso_week_label(F.col("first_day")).alias("year_week")).agg(
        F.count("user_pseudo_id").alias("cohort_size"),
        *[F.count_if(known & came[n]).alias(f"week_{n}") for n in range(weeks)],
    )
    rates = [
        (ratio(F.col(f"week_{n}"), F.col("cohort_size")) * 100).alias(f"week_{n}_retention_rate")
        for n in range(1, rated + 1)
    ]
    return cohorts.select("*", *rates).orderBy("year_week")


def loyalty_tiers(events: DataFrame, start, end) -> DataFrame:
    """Members and purchases per loyalty tier; a user's tier is the last one in text order.

    Users with purchases only have a NULL tier. Purchases without a user belong to nobody."""
    known = F.col("user_pseudo_id").isNotNull()
    users = (
        flatten(events.filter(in_days(start, end))).filter(named("purchase", "loyalty_tier_update"))
        .groupBy("user_pseudo_id")
        .agg(
            F.max(F.when(named("loyalty_tier_update"), F.col("loyalty_tier"))).alias("membership_tier"),
            F.count_if(named("purchase") & known).alias("purchases"),
        )
    )
    tiers = users.groupBy("membership_tier").agg(
        F.count("user_pseudo_id").alias("total_members"), F.sum("purchases").alias("total_purchases")
    )
    average = F.round(ratio(F.col("total_purchases"), F.col("total_members")), 2)
    return tiers.withColumn("avg_purchases_per_user", average).orderBy(F.desc("total_purchases"), "membership_tier")
