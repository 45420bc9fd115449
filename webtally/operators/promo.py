"""Visitors of promotion pages.

All per-user reports read one frame of user totals: events shrink to (user, session), then to users, so
distinct sessions are plain counts and a user with very many events is spread over tasks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from webtally.functions.fixed import PROMO_PATTERN
from webtally.functions.numbers import money, ratio
from webtally.functions.params import flatten, in_days, named
from webtally.functions.urls import is_promo
from webtally.functions.dates import utc_date
from webtally.operators.search import search_appearance_totals

SEARCH_COLUMNS = {
    "is_amp_top_stories": "is_amp_top_stories", "is_amp_blue_link": "is_amp_blue_link",
    "is_job_listing": "is_job_listing", "is_video": "is_video_results", "is_review_snippet": "is_review_snippet",
}


def _recent(as_of, days: int) -> Column:
    last = datetime.date.fromisoformat(str(as_of)) if as_of else datetime.datetime.now(datetime.timezone.utc).date()
    return in_days(last - datetime.timedelta(days=days), last)


def _user_totals(hits: DataFrame, pattern: str) -> DataFrame:
    """Totals of every user of ``hits`` (the flat view)."""
    promo = F.coalesce(is_promo(F.col("page_location"), pattern), F.lit(False))
    time = F.col("event_micros")
    sessions = hits.groupBy("user_pseudo_id", "session_id").agg(
        F.count("*").alias("events"),
        F.count_if(named("purchase")).alias("purchases"),
        F.sum(money(F.col("purchase_revenue"))).alias("revenue"),
        F.sum(F.when(named("purchase"), money(F.col("purchase_revenue")))).alias("bought"),
        F.count_if(F.col("engaged_text") == "0").alias("not_engaged"),
        F.count_if(promo).alias("promo_events"),
        F.count_if(promo & named("click")).alias("promo_clicks"),
        F.count_if(promo & named("page_view")).alias("promo_views"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.min(F.when(promo, time)).alias("first_promo"), F.max(F.when(promo, time)).alias("last_promo"),
        F.min(F.when(named("purchase"), time)).alias("first_purchase"),
    )
    added = ["events", "purchases", "revenue", "bought", "not_engaged", "promo_events", "promo_clicks", "promo_views"]
    return sessions.groupBy("user_pseudo_id").agg(
        F.count("session_id").alias("sessions"),
        F.count(F.when(F.col("purchases") > 0, F.col("session_id"))).alias("buying_sessions"),
        *[F.sum(c).alias(c) for c in added],
        *[F.min(c).alias(c) for c in ("first_time", "first_promo", "first_purchase")],
        *[F.max(c).alias(c) for c in ("last_time", "last_promo")],
    )


def _by_user(events: DataFrame, pattern: str) -> DataFrame:
    """Totals that need no sessions, in one aggregation by user."""
    promo = F.coalesce(is_promo(F.col("page_location"), pattern), F.lit(False))
    time = F.col("event_micros")
    return flatten(events).groupBy("user_pseudo_id").agg(
        F.count("*").alias("events"), F.count_if(promo).alias("promo_events"),
        F.count_if(promo & named("click")).alias("promo_clicks"), F.count_if(promo & named("page_view")).alias("promo_views"),
        F.min(F.when(promo, time)).alias("first_promo"), F.max(F.when(promo, time)).alias("last_promo"),
        F.min(F.when(named("purchase"), time)).alias("first_purchase"),
    )


def _recent_hits(events: DataFrame, pattern: str, as_of, days: int) -> DataFrame:
    return flatten(events.filter(_recent(as_of, days))).filter(
        named("page_view") & is_promo(F.col("page_location"), pattern)
    )


def _promo_users(events: DataFrame, pattern: str, as_of, days: int) -> DataFrame:
    """Totals of the users who viewed a promotion page in the last ``days`` days.

    The users come first, from the days of the window alone; their whole history is what the semi join leaves of all
    events before anything of it is added up. Where the history is large, Spark turns the users into a Bloom filter at
    run time, so that other users' events end at the scan and are not shuffled."""
    chosen = _recent_hits(events, pattern, as_of, days).filter(F.col("user_pseudo_id").isNotNull()).select("user_pseudo_id")
    return _user_totals(flatten(events).join(chosen, "user_pseudo_id", "left_semi"), pattern)


def _recent_views(events: DataFrame, pattern: str, as_of, days: int) -> DataFrame:
    """Promotion page views of the last ``days`` days, one row each."""
    return _recent_hits(events, pattern, as_of, days).select(
        "user_pseudo_id", "page_location", F.col("first_source").alias("source"), F.col("first_medium").alias("medium"),
        F.col("device_category").alias("device_type"), F.col("country").alias("user_country"),
        "event_micros", "sequence",
    )


def _engagement() -> dict[str, Column]:
    purchases, sessions = F.col("purchases"), F.col("sessions")
    return {
        "promo_sessions": sessions, "promo_page_views": F.col("events"), "purchases": purchases,
        "revenue_generated": F.col("revenue").cast("double"), "session_conversion_rate": ratio(purchases, sessions),
    }


def _linear_score() -> Column:
    return ratio(F.col("promo_events"), F.col("events"))


def _retention_days() -> Column:
    return F.datediff(utc_date(F.col("last_time")), utc_date(F.col("first_time")))


def _clv() -> Column:
    """Purchase revenue over the number of users, which is one for a known user."""
    return F.when(F.col("user_pseudo_id").isNotNull(), F.col("bought").cast("double"))


def promo_user_engagement(events: DataFrame, pattern: str = PROMO_PATTERN, as_of=None, days: int = 30) -> DataFrame:
    """Sessions, events, purchases and revenue of recent promotion visitors, over all their events."""
    metrics = [value.alias(name) for name, value in _engagement().items()]
    return _promo_users(events, pattern, as_of, days).select("user_pseudo_id", *metrics)


def promo_touch_attribution(events: DataFrame, pattern: str = PROMO_PATTERN) -> DataFrame:
    """First and last promotion event of every user and the promotion share of the user's events."""
    return _by_user(events, pattern).select(
        "user_pseudo_id", F.col("first_promo").alias("first_touch"), F.col("last_promo").alias("last_touch"),
        _linear_score().alias("linear_attribution_score"),
    )


def promo_ctr(events: DataFrame, pattern: str = PROMO_PATTERN) -> DataFrame:
    """Clicks per view of promotion pages, per user."""
    return _by_user(events, pattern).select(
        "user_pseudo_id", "promo_clicks", "promo_views",
        ratio(F.col("promo_clicks"), F.col("promo_views")).alias("promo_ctr"),
    )


def promo_bounce(events: DataFrame, pattern: str = PROMO_PATTERN, as_of=None, days: int = 30) -> DataFrame:
    """Events without engagement per session of recent promotion visitors."""
    return _promo_users(events, pattern, as_of, days).select(
        "user_pseudo_id", F.col("not_engaged").alias("bounced_sessions"), F.col("sessions").alias("total_sessions"),
        ratio(F.col("not_engaged"), F.col("sessions")).alias("bounce_rate"),
    )


def user_clv(events: DataFrame) -> DataFrame:
    """Purchase revenue, purchase sessions and lifetime value of every buyer."""
    revenue = F.col("bought").cast("double")
    sessions = flatten(events).filter(named("purchase")).groupBy("user_pseudo_id", "session_id").agg(
        F.sum(money(F.col("purchase_revenue"))).alias("bought")
    )
    buyers = sessions.groupBy("user_pseudo_id").agg(
        F.count("session_id").alias("buying_sessions"), F.sum("bought").alias("bought")
    )
    return buyers.select(
        "user_pseudo_id", revenue.alias("total_revenue"), F.col("buying_sessions").alias("total_sessions"),
        ratio(revenue, F.col("buying_sessions")).alias("avg_revenue_per_session"), _clv().alias("estimated_clv"),
    )


def promo_retention(events: DataFrame, pattern: str = PROMO_PATTERN, as_of=None, days: int = 30) -> DataFrame:
    """Days between first and last event of recent promotion visitors."""
    return _promo_users(events, pattern, as_of, days).select(
        "user_pseudo_id", F.col("first_time").alias("first_interaction"), F.col("last_time").alias("last_interaction"),
        _retention_days().alias("retention_days"), F.col("sessions").alias("session_count"),
    )


def promo_funnel(
    events: DataFrame, search: DataFrame, start, end, pattern: str = PROMO_PATTERN, as_of=None, days: int = 30
) -> DataFrame:
    """Every recent promotion page view with its user's totals and the site's search-appearance totals.

    Six per-user frames are one, joined once; the one row of search totals is a scalar subquery."""
    users = _promo_users(events, pattern, as_of, days).select(
        "user_pseudo_id",
        *[value.alias(name) for name, value in _engagement().items()],
        F.col("first_promo").alias("first_touch"), F.col("last_promo").alias("last_touch"),
        _linear_score().alias("linear_attribution_score"),
        ratio(F.col("promo_clicks"), F.col("promo_views")).alias("promo_ctr"),
        ratio(F.col("not_engaged"), F.col("sessions")).alias("bounce_rate"),
        _clv().alias("estimated_clv"), _retention_days().alias("retention_days"),
        F.col("sessions").alias("session_count"),
    )
    appearance = search_appearance_totals(search, start, end).select(
        F.struct(*[F.col(flag).alias(name) for flag, name in SEARCH_COLUMNS.items()]).alias("totals")
    )
    views = _recent_views(events, pattern, as_of, days)
    joined = views.join(users, "user_pseudo_id", "left")
    tie_break = [F.desc("revenue_generated"), "user_pseudo_id", "event_micros", "sequence"]
    output = [c for c in views.columns if c not in ("event_micros", "sequence")] + users.columns[1:]
    return (
        joined.withColumn("appearance", appearance.scalar()).orderBy(*tie_break)
        .select(*output, *[F.col(f"appearance.{name}").alias(name) for name in SEARCH_COLUMNS.values()])
    )


def promo_users(events: DataFrame, pattern: str = PROMO_PATTERN, as_of=None, days: int = 30) -> DataFrame:
    """Every recent promotion page view with its user's sessions, purchases, revenue and conversion rate."""
    users = _promo_users(events, pattern, as_of, days).select(
        "user_pseudo_id", F.col("sessions").alias("promo_sessions"), F.col("events").alias("promo_page_views"),
        F.col("purchases").alias("total_purchases"), F.col("revenue").cast("double").alias("total_revenue"),
        F.round(ratio(F.col("purchases"), F.col("sessions")) * 100, 2).alias("conversion_rate"),
    )
    views = _recent_views(events, pattern, as_of, days).withColumnsRenamed(
        {"source": "traffic_source", "medium": "traffic_medium"}
    )
    joined = views.join(users, "user_pseudo_id", "left")
    return joined.orderBy(F.desc("total_revenue"), "user_pseudo_id", "event_micros", "sequence").drop(
        "event_micros", "sequence"
    )


def promo_traffic_breakdown(events: DataFrame, pattern: str = PROMO_PATTERN) -> DataFrame:
    """Users and sessions with promotion pages per traffic source."""
    hits = flatten(events).filter(is_promo(F.col("page_location"), pattern))
    seen = hits.groupBy(F.col("first_source").alias("traffic_source"), "user_pseudo_id", "session_id").agg(F.lit(1))
    return seen.groupBy("traffic_source").agg(
        F.countDistinct("user_pseudo_id").alias("total_users"), F.countDistinct("session_id").alias("total_sessions")
    )


def promo_vs_non_promo(events: DataFrame, pattern: str = PROMO_PATTERN) -> DataFrame:
    """Users, sessions, purchases and revenue on promotion pages, other pages and events without a page."""
    kind = is_promo(F.col("page_location"), pattern).alias("is_promo_visit")
    seen = flatten(events).groupBy(kind, "user_pseudo_id", "session_id").agg(
        F.count_if(named("purchase")).alias("purchases"), F.sum(money(F.col("purchase_revenue"))).alias("revenue")
    )
    return seen.groupBy("is_promo_visit").agg(
        F.countDistinct("user_pseudo_id").alias("total_users"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.sum("purchases").alias("total_purchases"), F.sum("revenue").cast("double").alias("total_revenue"),
    )


def promo_user_journey(events: DataFrame, pattern: str = PROMO_PATTERN) -> DataFrame:
    """First promotion event and first purchase of every user."""
    return _by_user(events, pattern).select(
        "user_pseudo_id", F.col("first_promo").alias("first_promo_visit"), "first_purchase"
    )
