"""Page paths, entry and exit pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from webtally.functions.numbers import ratio
from webtally.functions.params import flatten, in_days, named
from webtally.functions.urls import page_path, tidy_url, without_query_and_fragment
from webtally.operators.skew import EVENT_ORDER, event_order, measured_span, neighbours

ENTRANCE, EXIT = "(entrance)", "(exit)"


def _moves(events: DataFrame, start, end, keys: list[str]) -> DataFrame:
    views = flatten(events.filter(in_days(start, end))).filter(named("page_view"))
    pages = views.select("user_pseudo_id", "session_key", *EVENT_ORDER, page_path(F.col("page_location")).alias("page"))
    return neighbours(pages, keys, "page").select(
        "session_key",
        F.coalesce("previous", F.lit(ENTRANCE)).alias("previous_page"),
        F.col("page").alias("current_page"),
        F.coalesce("next", F.lit(EXIT)).alias("next_page"),
    )


def _count_moves(moves: DataFrame) -> DataFrame:
    triple = ["previous_page", "current_page", "next_page"]
    counted = moves.groupBy(*triple).agg(F.countDistinct("session_key").alias("session_count"))
    return counted.orderBy(F.desc("session_count"), *triple)


def page_navigation_flow(events: DataFrame, start, end) -> DataFrame:
    """Sessions per (previous, current, next) page path."""
    return _count_moves(_moves(events, start, end, ["session_key"]))


def navigation_without_loops(events: DataFrame, start, end) -> DataFrame:
    """As ``page_navigation_flow`` per user and session, leaving out moves from or to the same page."""
    moves = _moves(events, start, end, ["user_pseudo_id", "session_key"])
    here = F.col("current_page")
    return _count_moves(moves.filter((here != F.col("previous_page")) & (here != F.col("next_page"))))


def navigation_steps(events: DataFrame, start, end, whole_session: bool = False) -> DataFrame:
    """How often each path of up to five pages opens a user's first session.

    A page that repeats the one before it is no step. Campaign, medium, source and referrer are the ones in
    force at the step; later steps count only while these equal the ones at the first step. As a path needs
    its first step, the first five steps of a session decide its row. With ``whole_session`` the values at a
    session's end hold for all its steps, so every session gives its whole path."""
    attributes = ["campaign", "medium", "source", "referrer"]
    hits = (
        flatten(events.filter(in_days(start, end)))
        .filter(F.col("user_pseudo_id").isNotNull() & (F.col("session_number") == 1))
        .select(
            "user_pseudo_id", "session_key", *EVENT_ORDER, "campaign", "medium", "source",
            tidy_url(F.col("page_location")).alias("page"), tidy_url(F.col("page_referrer")).alias("referrer"),
        )
    )
    spanned = measured_span(hits, ["session_key"], ["event_micros"])  # events of one time stay together
    if whole_session:
        return _step_counts(spanned.withColumn("state", F.lit(True)).select("session_key", *EVENT_ORDER, "_span", "page", "state"))
    # Attributes in force: those of the last event at or before this time (events at one time are peers).
    at_or_before = W.partitionBy("session_key", "_span").orderBy("event_micros")
    in_force = F.max_by(F.struct("user_pseudo_id", *attributes), event_order()).over(at_or_before)
    state = F.struct(F.col("user_pseudo_id"), *[F.col(f"_state.{a}").alias(a) for a in attributes])
    dressed = spanned.withColumn("_state", in_force).select(
        "session_key", *EVENT_ORDER, "_span", "page", state.alias("state")
    )
    return _step_counts(dressed)


def _step_counts(dressed: DataFrame) -> DataFrame:
    """Paths and how often they occur, from (session_key, time, _span, page, state)."""
    moved = neighbours(dressed, ["session_key"], "page", span="_span").filter(
        F.col("previous").isNull() | (F.col("previous") != F.col("page"))
    )
    visit = F.row_number().over(W.partitionBy("session_key").orderBy(*EVENT_ORDER))
    opening = moved.withColumn("visit", visit).filter(F.col("visit") <= 5)
    per_session = opening.groupBy("session_key").agg(
        *[F.max(F.when(F.col("visit") == n, F.struct("state", "page"))).alias(f"v{n}") for n in range(1, 6)]
    )
    same = [F.col("v1.page").alias("stage1")] + [
        F.when(F.col(f"v{n}.state").eqNullSafe(F.col("v1.state")), F.col(f"v{n}.page")).alias(f"stage{n}")
        for n in range(2, 6)
    ]
    stages = [f"stage{n}" for n in range(1, 6)]
    paths = per_session.select(*same).filter(F.col("stage1").isNotNull())
    return (
        paths.groupBy(*stages).agg(F.count("*").alias("navigation_frequency"))
        .orderBy(F.desc("navigation_frequency"), *stages)
    )


def exit_pages(events: DataFrame, start, end) -> DataFrame:
    """Sessions per last page viewed."""
    views = flatten(events.filter(in_days(start, end))).filter(named("page_view"))
    last = views.groupBy("user_pseudo_id", "ga_session_id").agg(
        F.max_by("page_location", event_order()).alias("exit_page")
    )
    session = F.concat("user_pseudo_id", F.col("ga_session_id").cast("string"))
    return (
        last.filter(F.col("exit_page").isNotNull())
        .groupBy("exit_page").agg(F.countDistinct(session).alias("session_count"))
        .orderBy(F.desc("session_count"), "exit_page")
    )


def landing_page_conversion(events: DataFrame, start, end) -> DataFrame:
    """Purchases per first page viewed in their session: one pass and one shuffle by session."""
    hits = flatten(events.filter(in_days(start, end))).filter(
        named("page_view", "purchase") & F.col("session_key").isNotNull()
    )
    sessions = hits.groupBy("session_key").agg(
        F.min_by("page_location", F.when(named("page_view"), event_order())).alias("landing_page"),
        F.count_if(named("purchase")).alias("purchases"),
    )
    return (
        sessions.filter(F.col("landing_page").isNotNull() & (F.col("purchases") > 0))
        .groupBy("landing_page").agg(F.sum("purchases").alias("total_purchases"))
        .orderBy(F.desc("total_purchases"), "landing_page")
    )


def landing_pages_top10(events: DataFrame, start, end) -> DataFrame:
    """The ten page and source combinations with most users."""
    keys = ["landing_page", "traffic_source", "traffic_medium"]
    views = (
        flatten(events.filter(in_days(start, end)))
        .filter(named("page_view") & F.col("user_pseudo_id").isNotNull())
        .select(
            without_query_and_fragment(F.col("page_location")).alias("landing_page"),
            F.col("source").alias("traffic_source"), F.col("medium").alias("traffic_medium"),
            "user_pseudo_id", "entrances", "bounce", "engagement_msec",
        )
        .filter(F.col("landing_page").isNotNull())
    )
    per_user = views.groupBy(*keys, "user_pseudo_id").agg(
        F.count("*").alias("page_views"), F.sum("entrances").alias("entrances"), F.sum("bounce").alias("bounces"),
        F.sum("engagement_msec").alias("msec"), F.count("engagement_msec").alias("timed"),
    )
    pages = per_user.groupBy(*keys).agg(
        F.count("*").alias("unique_users"),
        *[F.sum(c).alias(c) for c in ("page_views", "entrances", "bounces", "msec", "timed")],
    )
    return pages.select(
        *keys, "unique_users", "page_views", "entrances",
        F.round(ratio(F.col("entrances"), F.col("page_views")), 2).alias("entrance_rate"),
        F.round(ratio(F.col("bounces"), F.col("entrances")), 2).alias("bounce_rate"),
        F.round(ratio(F.col("msec"), F.col("timed")) / 1000, 2).alias("avg_engagement_time_sec"),
    ).orderBy(F.desc("unique_users"), *keys).limit(10)
