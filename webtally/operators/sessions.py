"""Session, page and hour metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webtally.functions.channels import source_medium
from webtally.functions.dates import utc_hour, week_of_year, weekday_label
from webtally.functions.numbers import money, ratio
from webtally.functions.params import flatten, in_days, named


def average_session_duration(events: DataFrame, start, end) -> DataFrame:
    """Mean seconds between first and last event of a session, per day; midnight splits a session."""
    per_day = flatten(events.filter(in_days(start, end))).groupBy("event_day", "session_key").agg(
        (F.max("event_micros") - F.min("event_micros")).alias("micros")
    )
    seconds = F.sum("micros") / 1_000_000
    return (
        per_day.groupBy(F.col("event_day").alias("event_date"))
        .agg(F.round(ratio(seconds, F.count("session_key")), 2).alias("average_session_duration_seconds"))
        .orderBy("event_date")
    )


def session_metrics_by_source(events: DataFrame, start, end) -> DataFrame:
    """Users, sessions, engagement, revenue and conversion per ``source / medium``."""
    source = source_medium(F.col("manual_source"), F.col("manual_medium"), F.col("gclid"))
    sessions = (
        flatten(events.filter(in_days(start, end)))
        .groupBy("user_pseudo_id", "session_key", F.coalesce(source, F.lit("direct")).alias("traffic_source"))
        .agg(
            F.max(F.col("engaged_text").try_cast("bigint")).alias("engaged"),
            F.sum("engagement_msec").alias("msec"),
            F.count_if(named("page_view")).alias("pageviews"),
            F.count_if(named("signup")).alias("signups"),
            F.count_if(named("purchase")).alias("purchases"),
            F.sum(money(F.col("purchase_revenue"))).alias("revenue"),
        )
    )
    totals = sessions.groupBy("traffic_source").agg(
        F.countDistinct("user_pseudo_id").alias("total_users"),
        F.count("session_key").alias("total_sessions"),
        F.count_if((F.col("engaged") == 1) & F.col("session_key").isNotNull()).alias("engaged_sessions"),
        F.sum("msec").alias("msec"),
        F.count("msec").alias("timed"),
        F.sum("pageviews").alias("total_pageviews"),
        F.sum("signups").alias("total_signups"),
        F.sum("purchases").alias("total_transactions"),
        F.sum("revenue").cast("double").alias("revenue"),
    )
    visits = F.col("total_sessions")
    return totals.select(
        "traffic_source", "total_users", "total_sessions", "engaged_sessions",
        F.round(ratio(F.col("msec") / 1000, F.col("timed")), 2).alias("avg_engagement_time_sec"),
        F.round(ratio(F.col("engaged_sessions"), visits), 3).alias("session_engagement_rate"),
        "total_pageviews",
        F.round(ratio(F.col("total_pageviews"), visits), 2).alias("avg_pageviews_per_session"),
        "total_signups", "total_transactions",
        F.round(F.coalesce("revenue", F.lit(0.0)), 2).alias("total_revenue"),
        F.round(ratio(F.col("total_transactions"), visits), 3).alias("session_conversion_rate"),
    ).orderBy(F.desc("total_users"), "traffic_source")


def session_conversion_rate(events: DataFrame, start, end) -> DataFrame:
    """Share of a day's sessions whose user purchased on that day (NULL rate on days with none).

    Three aggregations of falling size replace the semi join: session, then user, then day."""
    sessions = flatten(events.filter(in_days(start, end))).groupBy("event_day", "user_pseudo_id", "session_key").agg(
        F.max(named("purchase")).alias("bought")
    )
    bought = F.col("user_pseudo_id").isNotNull() & F.max("bought")
    users = sessions.groupBy("event_day", "user_pseudo_id").agg(
        F.count("session_key").alias("sessions"), bought.alias("bought")
    )
    days = users.groupBy(F.col("event_day").alias("event_date")).agg(
        F.sum("sessions").alias("total_sessions"),
        F.sum(F.when(F.col("bought"), F.col("sessions")).otherwise(0)).alias("converted_sessions"),
    )
    converted = F.when(F.col("converted_sessions") > 0, F.col("converted_sessions"))
    return days.withColumn(
        "session_conversion_rate", F.round(ratio(converted, F.col("total_sessions")) * 100, 3)
    ).orderBy("event_date")


def bounce_rate_by_page(events: DataFrame, start, end) -> DataFrame:
    """Share of a page's sessions on a day without engagement; a missing page never has engaged sessions."""
    sessions = flatten(events.filter(in_days(start, end))).groupBy("event_day", "page_location", "session_key").agg(
        F.max(F.coalesce(F.col("engaged_int") == 1, F.lit(False))).alias("engaged")
    )
    engaged = F.col("engaged") & F.col("session_key").isNotNull() & F.col("page_location").isNotNull()
    pages = sessions.groupBy(F.col("event_day").alias("event_date"), "page_location").agg(
        F.count("session_key").alias("total_sessions"), F.count_if(engaged).alias("session_engaged")
    )
    rate = F.lit(1) - ratio(F.col("session_engaged"), F.col("total_sessions"))
    return pages.withColumn("bounce_rate", F.round(rate, 2)).orderBy("event_date", "page_location")


def page_engagement(events: DataFrame, start, end) -> DataFrame:
    """Engagement seconds of all events and views per page."""
    pages = flatten(events.filter(in_days(start, end))).groupBy("page_location").agg(
        (F.sum("engagement_msec") / 1000).alias("total_engagement_time_seconds"),
        F.count_if(named("page_view")).alias("total_page_views"),
    )
    per_view = ratio(F.col("total_engagement_time_seconds"), F.col("total_page_views"))
    return pages.withColumn("average_engagement_time_per_page", per_view).orderBy(
        F.desc("total_engagement_time_seconds"), "page_location"
    )


def hourly_event_funnel(events: DataFrame, start, end) -> DataFrame:
    """Sessions, page views and item steps for every hour that has a session start.

    One pass: rows shrink to (hour, event, session) first. A step is NULL, not 0, in hours without it."""
    steps = ["view_item", "add_to_cart", "purchase"]
    with_session = F.col("has_session_id")
    counted = (
        named("page_view")
        | (named("session_start") & with_session)
        | (named(*steps) & with_session & (F.size("items.item_id") > 0))
    )
    slots = (
        flatten(events.filter(in_days(start, end)))
        .filter(named("page_view", "session_start", *steps)).filter(counted)
        .groupBy("event_day", utc_hour(F.col("event_micros")).alias("hour"), "event_name", "ga_session_id")
        .agg(F.count("event_micros").alias("hits"))
    )

    def sessions_of(name: str):
        return F.count(F.when(named(name), F.col("ga_session_id")))

    def present(name: str, value):
        return F.when(F.count_if(named(name)) > 0, value)

    hours = slots.groupBy("event_day", "hour").agg(
        F.count_if(named("session_start")).alias("starts"),
        sessions_of("session_start").alias("sessions"),
        present("page_view", F.sum(F.when(named("page_view"), F.col("hits")))).alias("pageviews"),
        present("view_item", sessions_of("view_item")).alias("view_item_sessions"),
        present("add_to_cart", sessions_of("add_to_cart")).alias("add_to_cart_sessions"),
        present("purchase", sessions_of("purchase")).alias("order_sessions"),
    ).filter(F.col("starts") > 0)
    day = F.col("event_day")
    return hours.select(
        day.alias("event_date"), week_of_year(day).alias("iso_week_of_the_year"), weekday_label(day).alias("weekday"),
        "hour", "sessions", "pageviews", "view_item_sessions", "add_to_cart_sessions", "order_sessions",
    ).orderBy("weekday", "hour", "event_date")
