"""Consent and suspicious traffic."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, functions as F

from webtally.functions.fixed import CONSENT_FACTORS
from webtally.functions.numbers import money, ratio, share_of_total
from webtally.functions.params import flatten, in_days, named


def consent_user_estimate(events: DataFrame, start, end, factors: dict[str, float] = CONSENT_FACTORS) -> DataFrame:
    """Page views by consent (a user id means granted) and the users they stand for, by views per user."""
    state = F.when(F.col("user_pseudo_id").isNotNull(), "Granted").otherwise("Denied")
    counted = flatten(events.filter(in_days(start, end))).filter(named("page_view")).groupBy(
        state.alias("consent_state")
    ).agg(F.count("*").alias("total_events"), F.countDistinct("user_pseudo_id").alias("distinct_users"))
    factor = F.create_map(*[F.lit(x) for x in chain(*factors.items())])[F.col("consent_state")]
    return counted.select(
        "*", F.round(ratio(F.col("total_events"), factor)).cast("bigint").alias("estimated_users"),
        F.round(share_of_total(F.col("total_events")), 4).alias("event_share"),
    ).orderBy(F.desc("total_events"), "consent_state")


def consent_summary(events: DataFrame, start, end) -> DataFrame:
    """Events, users, sessions, engagement and revenue per consent state, device and country.

    Distinct users and sessions are plain counts after shrinking to (group, user, session) and (group, user)."""
    keys = {
        "analytics_storage": "analytics_storage_status", "ads_storage": "ads_storage_status",
        "device_category": "device_type", "country": "user_country",
    }
    sessions = flatten(events.filter(in_days(start, end))).groupBy(*keys, "user_pseudo_id", "session_key").agg(
        F.count("*").alias("events"), F.sum("engagement_msec").alias("msec"),
        F.count("engagement_msec").alias("timed"),
        F.max(F.coalesce(F.col("session_number") == 1, F.lit(False))).alias("is_new"),
        F.max(named("purchase")).alias("bought"),
        F.sum(F.when(named("purchase"), money(F.col("value_double"))).otherwise(0)).alias("revenue"),
    )
    users = sessions.groupBy(*keys, "user_pseudo_id").agg(
        F.count("session_key").alias("sessions"), F.max("is_new").alias("is_new"), F.max("bought").alias("bought"),
        *[F.sum(c).alias(c) for c in ("events", "msec", "timed", "revenue")],
    )
    user = F.col("user_pseudo_id")
    groups = users.groupBy(*[F.col(k).alias(name) for k, name in keys.items()]).agg(
        F.sum("events").alias("total_events"), F.count(user).alias("total_users"),
        F.sum("sessions").alias("total_sessions"),
        (ratio(F.sum("msec"), F.sum("timed")) / 1000).alias("avg_engagement_time_sec"),
        F.count(F.when(F.col("is_new"), user)).alias("new_users"),
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.count(F.when(F.col("bought"), user)).alias("converting_users"),
    )

    def percentage(part: str):
        return F.round(share_of_total(F.col(part)) * 100, 2)

    return groups.select(
        *keys.values(), "total_events", percentage("total_events").alias("event_percentage"),
        "total_users", percentage("total_users").alias("user_percentage"),
        "total_sessions", percentage("total_sessions").alias("session_percentage"),
        "avg_engagement_time_sec", "new_users", "total_revenue", "converting_users",
    ).orderBy(F.desc("total_events"), *keys.values())


def non_consented_by_country(events: DataFrame, start, end) -> DataFrame:
    """Events per day and country of users who refused both kinds of storage."""
    refused = flatten(events.filter(in_days(start, end))).filter(
        (F.col("analytics_storage") == "No") & (F.col("ads_storage") == "No")
    )
    return refused.groupBy(F.col("event_day").alias("date_formatted"), "country").agg(
        F.count("*").alias("total_events")
    ).orderBy(F.desc("total_events"), "date_formatted", "country")


def measurement_protocol_ratio(events: DataFrame, start, end) -> DataFrame:
    """Share of a day's events that look server-sent: desktop without language and operating system."""
    suspect = (
        F.col("device_language").isNull() & F.col("device_system").isNull() & (F.col("device_category") == "desktop")
    )
    share = F.round(ratio(F.count_if(suspect), F.count("*")), 4)
    return flatten(events.filter(in_days(start, end))).groupBy(F.col("event_day").alias("event_date")).agg(
        share.alias("measurement_protocol_event_ratio")
    ).orderBy("event_date")
