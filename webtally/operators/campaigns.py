"""Paid campaigns and organic search conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webtally.functions.dates import between_dates
from webtally.functions.numbers import exact_sum, money, ratio
from webtally.functions.params import flatten, in_days, named
from webtally.functions.urls import transform_url


def ads_campaign_performance(events: DataFrame, start, end) -> DataFrame:
    """Users, revenue and revenue per user of each campaign and channel group."""
    rows = flatten(events.filter(in_days(start, end))).filter(
        F.col("ads_campaign").isNotNull() & F.col("purchase_revenue_usd").isNotNull()
    )
    campaigns = rows.groupBy(F.col("ads_campaign").alias("google_ads_campaign"), "primary_channel").agg(
        F.countDistinct("user_pseudo_id").alias("unique_users"),
        exact_sum(F.col("purchase_revenue_usd")).alias("total_revenue"),
    )
    return campaigns.withColumn("revenue_per_user", ratio(F.col("total_revenue"), F.col("unique_users"))).orderBy(
        F.desc("total_revenue"), "google_ads_campaign", "primary_channel"
    )


def ads_campaign_sessions(events: DataFrame, start, end) -> DataFrame:
    """Sessions, purchases and revenue per account, campaign and device; 0 for events without a device."""
    keys = ["ads_account", "ads_campaign", "device_category"]
    sessions = (
        flatten(events.filter(in_days(start, end)))
        .filter(F.col("ads_account").isNotNull() & F.col("ads_campaign").isNotNull())
        .groupBy(*keys, "session_key")
        .agg(F.count_if(named("purchase")).alias("purchases"), F.sum(money(F.col("param_revenue"))).alias("revenue"))
    )
    totals = sessions.groupBy(*keys).agg(
        F.count("session_key").alias("session_count"), F.sum("purchases").alias("purchases"),
        F.sum("revenue").cast("double").alias("revenue"),
    )
    known = F.col("device_category").isNotNull()
    return totals.select(
        F.col("ads_account").alias("google_ads_account_name"), F.col("ads_campaign").alias("google_ads_campaign_name"),
        F.col("device_category").alias("device_type"), "session_count",
        F.when(known, F.col("purchases")).otherwise(0).alias("total_purchases"),
        F.coalesce(F.when(known, F.col("revenue")), F.lit(0.0)).alias("total_revenue"),
    ).orderBy(F.desc("session_count"), "google_ads_account_name", "google_ads_campaign_name", "device_type")


def ads_revenue_transactions(events: DataFrame, start, end) -> DataFrame:
    """Revenue, transactions, users and their ratios per day and campaign."""
    rows = flatten(events.filter(in_days(start, end))).filter(
        F.col("ads_campaign").isNotNull() & F.col("transaction_id").isNotNull()
    )
    days = rows.groupBy("event_date", F.col("ads_campaign").alias("campaign_name")).agg(
        exact_sum(F.col("purchase_revenue_usd")).alias("daily_revenue"),
        F.countDistinct("transaction_id").alias("daily_transactions"),
        F.countDistinct("user_pseudo_id").alias("unique_users"),
    )
    revenue, transactions, users = (F.col(c) for c in ("daily_revenue", "daily_transactions", "unique_users"))
    return days.select(
        "*", ratio(revenue, users).alias("revenue_per_user"), ratio(transactions, users).alias("transactions_per_user"),
        F.round(ratio(revenue, transactions), 2).alias("average_revenue_per_transaction"),
    ).orderBy("event_date", F.desc("daily_revenue"), "campaign_name")


def organic_query_value(events: DataFrame, search: DataFrame, start, end) -> DataFrame:
    """Organic sessions and purchase value of landing URLs, credited to search queries by their share of clicks.

    Starts and purchases are counted per session before they meet, so their pairs are a product of counts."""
    hits = flatten(events.filter(in_days(start, end))).filter(
        F.col("user_pseudo_id").isNotNull() & F.col("ga_session_id").isNotNull()
    )
    session = ["user_pseudo_id", "ga_session_id"]
    organic = (F.col("manual_source") == "google") & (F.col("manual_medium") == "organic")
    starts = (
        hits.filter(named("session_start") & organic)
        .groupBy(*session, transform_url(F.col("page_location"), "all").alias("url")).agg(F.count("*").alias("starts"))
    )
    purchases = hits.filter(named("purchase")).groupBy(*session).agg(
        F.count("*").alias("purchases"), F.sum(money(F.col("first_value"))).alias("amount")
    )
    landings = starts.filter(F.col("url").isNotNull()).join(purchases, session).groupBy("url").agg(
        F.sum(F.col("starts") * F.col("purchases")).alias("sessions"),
        F.sum(F.col("starts") * F.col("amount")).cast("double").alias("amount"),
    )
    queries = (
        search.filter((F.col("clicks") > 0) & between_dates("data_date", start, end))
        .filter(F.col("query").isNotNull() & F.col("url").isNotNull())
        .groupBy("query", transform_url(F.col("url"), "all").alias("url")).agg(F.sum("clicks").alias("clicks"))
    )
    all_clicks = queries.groupBy("url").agg(F.sum("clicks").alias("url_clicks"))
    shared = queries.join(all_clicks.join(landings, "url"), "url")
    credit = F.round(ratio(F.col("sessions") * F.col("clicks"), F.col("url_clicks")), 2)
    return (
        shared.select(F.col("query").alias("search_query"), credit.alias("credit"), "amount")
        .groupBy("search_query")
        .agg(
            F.round(F.sum(money(F.col("credit"))).cast("double"), 2).alias("total_sov_conversion"),
            F.round(F.sum(money(F.col("credit") * F.col("amount"))).cast("double"), 2).alias("total_purchase_value"),
        )
        .orderBy(F.desc("total_sov_conversion"), "search_query")
    )
