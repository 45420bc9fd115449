"""Daily key figures and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from webtally.functions.numbers import count_distinct_if, money, ratio
from webtally.functions.params import flatten, in_days, named


def daily_metrics(events: DataFrame, start, end) -> DataFrame:
    """Sessions, their mean length, users, new users, purchases, revenue, views and engagement per day."""
    sessions = flatten(events.filter(in_days(start, end))).groupBy("event_day", "user_pseudo_id", "ga_session_id").agg(
        (F.max("event_micros") - F.min("event_micros")).alias("micros"),
        F.count("*").alias("events"),
        F.count_if(named("page_view")).alias("views"),
        F.count_if(named("purchase")).alias("purchases"),
        F.sum(money(F.col("purchase_revenue"))).alias("revenue"),
        F.max(F.coalesce(F.col("session_number") == 1, F.lit(False))).alias("is_first"),
        F.max(F.coalesce(F.col("engaged_text") == "1", F.lit(False))).alias("engaged"),
    )
    user = F.col("user_pseudo_id")
    # User and session number are joined without a separator here, as the figures are defined that way.
    session = F.concat(user, F.col("ga_session_id").cast("string"))
    days = sessions.groupBy(F.col("event_day").alias("date_formatted")).agg(
        F.countDistinct(session).alias("sessions"),
        (ratio(F.sum("micros"), F.count("micros")) / 1_000_000).alias("averageSessionDuration_seconds"),
        F.countDistinct(user).alias("totalUsers"),
        count_distinct_if(F.col("is_first"), user).alias("NewUsers"),
        F.sum("purchases").alias("Purchases"),
        F.coalesce(F.sum("revenue").cast("double"), F.lit(0.0)).alias("purchaseRevenue"),
        F.sum("views").alias("screenPageViews"),
        count_distinct_if(F.col("engaged"), session).alias("engagedSessions"),
        F.sum("events").alias("eventCount"),
    )
    rate = F.round(ratio(F.col("engagedSessions"), F.col("sessions")) * 100, 2)
    return days.withColumn("engagementRate_percent", rate).select(
        "date_formatted", "sessions", "averageSessionDuration_seconds", "totalUsers", "NewUsers", "Purchases",
        "purchaseRevenue", "screenPageViews", "engagedSessions", "engagementRate_percent", "eventCount",
    ).orderBy("date_formatted")


def performance_trend(events: DataFrame, start, end) -> DataFrame:
    """Sessions per day against the day before and the last seven days, with buyers and revenue."""
    users = (
        flatten(events.filter(in_days(start, end)))
        .groupBy("event_day", "user_pseudo_id", "session_key")
        .agg(
            F.max(named("purchase")).alias("bought"),
            F.sum(F.when(named("purchase"), money(F.col("value_double")))).alias("revenue"),
        )
        .groupBy("event_day", "user_pseudo_id")
        .agg(F.count("session_key").alias("sessions"), F.max("bought").alias("bought"), F.sum("revenue").alias("revenue"))
    )
    days = users.groupBy(F.col("event_day").alias("event_date")).agg(
        F.sum("sessions").alias("total_sessions"),
        F.count(F.when(F.col("bought"), F.col("user_pseudo_id"))).alias("purchasing_users"),
        F.sum("revenue").cast("double").alias("total_revenue"),
    )
    # One row per day from here on, so one task is enough for the calendar windows.
    in_time = W.orderBy("event_date")
    today, before = F.col("total_sessions"), F.col("previous_sessions")
    return days.withColumn("previous_sessions", F.lag("total_sessions").over(in_time)).select(
        "event_date", "total_sessions", "previous_sessions",
        F.round(F.avg("total_sessions").over(in_time.rowsBetween(-6, 0)), 2).alias("avg_sessions_7d"),
        F.when(today > before, "Increase").when(today < before, "Decrease").otherwise("Stable").alias("session_trend"),
        "purchasing_users", "total_revenue",
    ).orderBy("event_date")
