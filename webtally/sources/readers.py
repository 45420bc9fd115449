"""Parquet readers. Every schema is given, so no files are opened to infer it and ``yyyymmdd`` partition
values stay text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtally.functions.dates import between_dates
from webtally.functions.params import in_days
from webtally.sources import schemas


def read_table(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    return spark.read.schema(schemas.ddl(fields)).parquet(path)


def read_events(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Events partitioned by ``event_date``; with ``start`` and ``end`` only those days are listed and read.

    One day is ``start == end``."""
    events = read_table(spark, path, schemas.EVENT_FIELDS)
    return events.filter(in_days(start, end)) if start is not None and end is not None else events


def read_search_site(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    rows = read_table(spark, path, schemas.SEARCH_SITE_FIELDS)
    return rows.filter(between_dates("data_date", start, end)) if start is not None and end is not None else rows


def read_search_url(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    rows = read_table(spark, path, schemas.SEARCH_URL_FIELDS)
    return rows.filter(between_dates("data_date", start, end)) if start is not None and end is not None else rows


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.USER_FIELDS)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.SALES_FIELDS)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.CUSTOMER_FIELDS)
