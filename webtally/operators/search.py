"""Search-console reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from webtally.functions.channels import first_match
from webtally.functions.dates import between_dates
from webtally.functions.fixed import AMP_CLASSES, APPEARANCE_FLAGS, PROMO_PATTERN
from webtally.functions.numbers import ratio, safe_corr
from webtally.functions.urls import is_promo


def _totals() -> list[Column]:
    ctr = ratio(F.sum("clicks"), F.sum("impressions")) * 100
    return [
        F.sum(F.coalesce("impressions", F.lit(0))).alias("total_impressions"),
        F.sum(F.coalesce("clicks", F.lit(0))).alias("total_clicks"),
        F.round(ctr, 2).alias("ctr"),
    ]


def _position(total: Column, impressions: Column) -> Column:
    return ratio(total, impressions) + 1.0


def search_appearance_totals(search: DataFrame, start, end) -> DataFrame:
    """Number of rows with each appearance flag set; always one row."""
    flags = [F.coalesce(F.col(f).try_cast("bigint"), F.lit(0)) for f in APPEARANCE_FLAGS]
    return search.filter(between_dates("data_date", start, end)).agg(
        *[F.sum(value).alias(name) for name, value in zip(APPEARANCE_FLAGS, flags)]
    )


def search_report(search: DataFrame, start, end, pattern: str = PROMO_PATTERN) -> DataFrame:
    """Impressions, clicks and click rate by device and country, traffic source, day, query, AMP class and
    promotional query: one scan and one shuffle, each row counting once per grouping it belongs to."""
    amp = first_match([(label, F.col(flag)) for flag, label in AMP_CLASSES], "Non-AMP")

    def group(report: str, category: Column, segment: Column | None = None) -> Column:
        place = F.lit(None).cast("string") if segment is None else segment
        return F.struct(
            F.lit(report).alias("report_type"), category.cast("string").alias("category"), place.alias("segment")
        )

    query = F.col("search_query")
    groups = F.array(
        group("Device_Country", F.col("device_category"), F.col("country")),
        group("Traffic_Source", F.col("traffic_source")),
        group("Daily_Trends", F.col("data_date")),
        group("Search_Query_Performance", query),
        group("AMP_Performance", amp),
        F.when(is_promo(F.lower(query), pattern), group("Keyword_Performance", query)),
    )
    rows = search.filter(between_dates("data_date", start, end)).select(
        F.explode(groups).alias("g"), "impressions", "clicks"
    ).filter(F.col("g").isNotNull())
    keys = ["report_type", "category", "segment"]
    return rows.groupBy(*[F.col(f"g.{k}").alias(k) for k in keys]).agg(*_totals()).orderBy(
        "report_type", F.desc("total_impressions"), "category", "segment"
    )


def search_keyword_promo(search: DataFrame, start, end, pattern: str = PROMO_PATTERN) -> DataFrame:
    """Impressions, clicks and click rate of promotional queries."""
    rows = search.filter(between_dates("data_date", start, end) & is_promo(F.lower("search_query"), pattern))
    return rows.groupBy("search_query").agg(*_totals()).orderBy(F.desc("total_impressions"), "search_query")


def _ranked(search: DataFrame, start, end) -> DataFrame:
    return search.filter(
        (F.col("impressions") > 0) & (F.col("sum_top_position") < 20) & between_dates("data_date", start, end)
    )


def _ctr_and_position() -> list[Column]:
    return [
        ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
        _position(F.sum("sum_top_position"), F.sum("impressions")).alias("position"),
    ]


def ctr_by_position(search: DataFrame, start, end) -> DataFrame:
    """Mean click rate of queries by their rounded average position."""
    queries = _ranked(search, start, end).groupBy("query").agg(*_ctr_and_position())
    return (
        queries.groupBy(F.round("position").alias("position"))
        .agg(F.round(F.avg("ctr") * 100, 2).alias("avg_ctr_percentage"))
        .orderBy("position")
    )


def search_query_device(search: DataFrame, start, end) -> DataFrame:
    """Impressions, clicks, click rate and average position per query and device."""
    rows = search.filter(between_dates("data_date", start, end) & F.col("query").isNotNull())
    totals = rows.groupBy("query", "device").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.sum("sum_top_position").alias("top"),
    )
    return totals.select(
        "query", "device", "impressions", "clicks",
        F.round(ratio(F.col("clicks"), F.col("impressions")), 4).alias("ctr"),
        F.round(_position(F.col("top"), F.col("impressions")), 2).alias("avg_position"),
    ).orderBy(F.desc("impressions"), "query", "device")


def _daily_correlation(search: DataFrame, start, end) -> DataFrame:
    daily = _ranked(search, start, end).groupBy("data_date", "query").agg(*_ctr_and_position())
    return daily.groupBy("data_date").agg(safe_corr(F.col("ctr"), F.col("position")).alias("corr"))


def ctr_position_daily_corr(search: DataFrame, start, end) -> DataFrame:
    """Correlation of click rate and position over the queries of each day."""
    return _daily_correlation(search, start, end).select(
        "data_date", F.round("corr", 4).alias("ctr_position_correlation")
    ).orderBy("data_date")


def ctr_position_corr_trend(search: DataFrame, start, end) -> DataFrame:
    """Daily correlation over the whole calendar range (0 where there is none) with trailing means of 7, 14 and
    30 days and the mean of the calendar month number. From the daily correlation on there is one row per day."""
    spark = search.sparkSession
    days = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    calendar = spark.range(1).select(F.explode(days).alias("data_date"))
    filled = calendar.join(_daily_correlation(search, start, end), "data_date", "left").select(
        "data_date", F.coalesce("corr", F.lit(0.0)).alias("corr")
    )

    def trailing(n: int) -> Column:
        mean = F.avg("corr").over(W.orderBy("data_date").rowsBetween(1 - n, 0))
        return F.round(mean, 4).alias(f"moving_avg_{n}d")

    monthly = F.avg("corr").over(W.partitionBy(F.month("data_date")))
    return filled.select(
        "data_date", F.round("corr", 4).alias("ctr_position_correlation"), trailing(7), trailing(14), trailing(30),
        F.round(monthly, 4).alias("avg_monthly_corr"),
    ).orderBy("data_date")
