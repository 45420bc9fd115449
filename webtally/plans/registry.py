"""Registered queries: every report on tables derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from webtally.operators import attribution, campaigns, daily, navigation, privacy, promo, search, sessions, shaping, users
from webtally.sources import testdata, writers

YEAR = ("2024-01-01", "2024-12-31")
# All days of the search and sales tables.
OLD_YEARS = ("1995-01-01", "2001-12-31")
# Promotion visitors of the 30 days before the last day of the events' month, which is the last of the monthly tables.
RECENT = {"as_of": "2024-01-31", "days": 30}
LAST_MONTH = "2024-01-31"

Query = Callable[[SparkSession, str], DataFrame]


def _utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def on_events(report: Callable, *args, stagger: bool = False, **options) -> Query:
    return lambda spark, folder: report(testdata.stored_events(_utc(spark), folder, stagger), *args, **options)


def on_search(report: Callable) -> Query:
    return lambda spark, folder: report(testdata.search(_utc(spark), folder), *OLD_YEARS)


def _clv_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return users.clv_sessions_correlation(testdata.users(_utc(spark), folder), *YEAR)


def _promo_funnel(spark: SparkSession, folder: str) -> DataFrame:
    events, pages = testdata.stored_events(_utc(spark), folder), testdata.search(spark, folder)
    return promo.promo_funnel(events, pages, *OLD_YEARS, **RECENT)


def _organic_query_value(spark: SparkSession, folder: str) -> DataFrame:
    events, pages = testdata.stored_events(_utc(spark), folder), testdata.search(spark, folder)
    # The two derived tables cover different years; every search row counts at its day of the event year.
    shifted = pages.withColumn("data_date", F.date_add(F.lit(YEAR[0]).cast("date"), F.dayofyear("data_date") - 1))
    return campaigns.organic_query_value(events, shifted, *YEAR)


def _sales_customers(spark: SparkSession, folder: str) -> DataFrame:
    sales, customers = testdata.sales(_utc(spark), folder), testdata.customers(spark, folder)
    return shaping.sales_customer_asof_membership(sales, customers, *OLD_YEARS)


def _time_decay(spark: SparkSession, folder: str, only_before: bool = False) -> DataFrame:
    """Ten significant digits: powers and sums of doubles differ between engines beyond that."""
    report = attribution.attribution_time_decay(testdata.stored_events(_utc(spark), folder), *YEAR, only_before=only_before)
    value = F.col("total_attributed_value")
    digits = F.floor(F.log10(value)) - 9
    large, small = F.pow(F.lit(10.0), digits), F.pow(F.lit(10.0), -digits)
    rounded = F.when(digits >= 0, F.round(value / large) * large).otherwise(F.round(value * small) / small)
    return report.withColumn("total_attributed_value", rounded)


def _monthly_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Write the monthly tables and count what was stored per table and day."""
    base = writers.new_folder(_utc(spark), "monthly")
    paths = writers.write_monthly_tables(testdata.monthly_rows(spark, folder), base, LAST_MONTH)
    stored = None
    for path in paths:
        rows = writers.read_monthly_table(spark, path).withColumn("table_name", F.lit(path.rsplit("/", 1)[1]))
        stored = rows if stored is None else stored.unionByName(rows)
    return stored.groupBy("table_name", "event_date").agg(
        F.count("*").alias("row_count"), F.countDistinct("user_id").alias("users"),
        F.countDistinct("session_id").alias("sessions"), F.max(F.unix_micros("event_timestamp")).alias("last_event"),
    )


QUERIES: dict[str, Query] = {
    "page_navigation_flow": on_events(navigation.page_navigation_flow, *YEAR),
    "navigation_without_loops": on_events(navigation.navigation_without_loops, *YEAR),
    "navigation_steps": on_events(navigation.navigation_steps, *YEAR),
    "navigation_steps_whole_session": on_events(navigation.navigation_steps, *YEAR, whole_session=True),
    "exit_pages": on_events(navigation.exit_pages, *YEAR),
    "landing_page_conversion": on_events(navigation.landing_page_conversion, *YEAR),
    "landing_pages_top10": on_events(navigation.landing_pages_top10, *YEAR),
    "average_session_duration": on_events(sessions.average_session_duration, *YEAR),
    "session_metrics_by_source": on_events(sessions.session_metrics_by_source, *YEAR),
    "session_conversion_rate": on_events(sessions.session_conversion_rate, *YEAR),
    "bounce_rate_by_page": on_events(sessions.bounce_rate_by_page, *YEAR),
    "page_engagement": on_events(sessions.page_engagement, *YEAR),
    "hourly_event_funnel": on_events(sessions.hourly_event_funnel, *YEAR),
    "attribution_first_click": on_events(attribution.attribution_first_click, *YEAR),
    "attribution_last_click": on_events(attribution.attribution_last_click, *YEAR),
    "attribution_linear": on_events(attribution.attribution_linear, *YEAR),
    "attribution_time_decay": _time_decay,
    "attribution_time_decay_before": lambda spark, folder: _time_decay(spark, folder, only_before=True),
    "page_revenue_attribution": on_events(attribution.page_revenue_attribution, *YEAR),
    "source_product_revenue": on_events(attribution.source_product_revenue, *YEAR),
    "marketing_channels": on_events(attribution.marketing_channels, *YEAR),
    "traffic_category": on_events(attribution.traffic_category),
    "engagement_status": on_events(attribution.engagement_status),
    "clv_sessions_correlation": _clv_correlation,
    "cohort_retention": on_events(users.cohort_retention, *YEAR, stagger=True),
    "loyalty_tiers": on_events(users.loyalty_tiers, *YEAR),
    "promo_user_engagement": on_events(promo.promo_user_engagement, **RECENT),
    "promo_touch_attribution": on_events(promo.promo_touch_attribution),
    "promo_ctr": on_events(promo.promo_ctr),
    "promo_bounce": on_events(promo.promo_bounce, **RECENT),
    "user_clv": on_events(promo.user_clv),
    "promo_retention": on_events(promo.promo_retention, **RECENT),
    "promo_funnel": _promo_funnel,
    "promo_users": on_events(promo.promo_users, **RECENT),
    "promo_traffic_breakdown": on_events(promo.promo_traffic_breakdown),
    "promo_vs_non_promo": on_events(promo.promo_vs_non_promo),
    "promo_user_journey": on_events(promo.promo_user_journey),
    "search_appearance_totals": on_search(search.search_appearance_totals),
    "search_report": on_search(search.search_report),
    "search_keyword_promo": on_search(search.search_keyword_promo),
    "ctr_by_position": on_search(search.ctr_by_position),
    "search_query_device": on_search(search.search_query_device),
    "ctr_position_daily_corr": on_search(search.ctr_position_daily_corr),
    "ctr_position_corr_trend": on_search(search.ctr_position_corr_trend),
    "ads_campaign_performance": on_events(campaigns.ads_campaign_performance, *YEAR),
    "ads_campaign_sessions": on_events(campaigns.ads_campaign_sessions, *YEAR),
    "ads_revenue_transactions": on_events(campaigns.ads_revenue_transactions, *YEAR),
    "organic_query_value": _organic_query_value,
    "daily_metrics": on_events(daily.daily_metrics, *YEAR),
    "performance_trend": on_events(daily.performance_trend, *YEAR),
    "consent_user_estimate": on_events(privacy.consent_user_estimate, *YEAR),
    "consent_summary": on_events(privacy.consent_summary, *YEAR),
    "non_consented_by_country": on_events(privacy.non_consented_by_country, *YEAR),
    "measurement_protocol_ratio": on_events(privacy.measurement_protocol_ratio, *YEAR),
    "event_pivot": on_events(shaping.event_pivot, *YEAR),
    "flat_event_params": on_events(shaping.flat_event_params, *YEAR),
    "flat_user_properties": on_events(shaping.flat_user_properties, *YEAR),
    "flat_items": on_events(shaping.flat_items, *YEAR),
    "flat_events": on_events(shaping.flat_events, *YEAR),
    "sales_customer_asof_membership": _sales_customers,
    "monthly_partitioned_sink": _monthly_sink,
}
