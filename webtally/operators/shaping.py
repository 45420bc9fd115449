"""Flat and pivoted forms of the nested event table, and the sales join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webtally.functions.dates import between_dates
from webtally.functions.fixed import ITEM_LIST_FIELDS, ITEM_NUMBER_FIELDS, ITEM_TEXT_FIELDS, PIVOT_EVENTS
from webtally.functions.params import in_days
from webtally.sources.writers import stored

EVENT = ["user_pseudo_id", "event_timestamp", "event_name"]
ITEM_FIELDS = ITEM_TEXT_FIELDS + [name for name, _ in ITEM_NUMBER_FIELDS] + ITEM_LIST_FIELDS


def event_pivot(events: DataFrame, start, end, names: list[str] = PIVOT_EVENTS) -> DataFrame:
    """Events of each listed name per user; users with none of them have zeros."""
    counts = [F.count_if(F.col("event_name") == name).alias(name) for name in names]
    return events.filter(in_days(start, end)).groupBy("user_pseudo_id").agg(*counts).orderBy("user_pseudo_id")


def _param_columns(entry: str) -> list[Column]:
    slots = ("string", "int", "float", "double")
    return [F.col(f"{entry}.key").alias("param_key")] + [
        F.col(f"{entry}.value.{s}_value").alias(f"param_{s}_value") for s in slots
    ]


def _property_columns(entry: str) -> list[Column]:
    slots = ("string", "int", "float", "double")
    return (
        [F.col(f"{entry}.key").alias("user_property_key")]
        + [F.col(f"{entry}.value.{s}_value").alias(f"user_property_{s}_value") for s in slots]
        + [F.col(f"{entry}.value.set_timestamp_micros").alias("user_property_set_timestamp")]
    )


def _item_columns(entry: str) -> list[Column]:
    return [F.col(f"{entry}.{name}").alias(name) for name in ITEM_FIELDS]


def flat_event_params(events: DataFrame, start, end) -> DataFrame:
    """One row per event parameter."""
    rows = events.filter(in_days(start, end)).select(*EVENT, F.explode("event_params").alias("p"))
    return rows.select(*EVENT, *_param_columns("p"))


def flat_user_properties(events: DataFrame, start, end) -> DataFrame:
    """One row per user property of an event."""
    rows = events.filter(in_days(start, end)).select(*EVENT, F.explode("user_properties").alias("p"))
    return rows.select(*EVENT, *_property_columns("p"))


def flat_items(events: DataFrame, start, end) -> DataFrame:
    """One row per item of an event."""
    rows = events.filter(in_days(start, end)).select(*EVENT, F.explode("items").alias("p"))
    return rows.select(*EVENT, *_item_columns("p"))


#: Shared triples up to this number, some ten megabytes, are sent to every task, so that no array is shuffled.
FEW_TRIPLES = 100_000


def flat_events(events: DataFrame, start, end, ordered: bool = False, few: int = FEW_TRIPLES) -> DataFrame:
    """Every combination of an event's parameters, user properties and items, one row each; sorted if ``ordered``.

    Events are matched to their parts by (user, time, name), so events that share all three get each other's
    parts too. The triples of several events are counted first, from three columns, and stored. All other events are
    exploded in place; those of shared triples are stored and meet their parts, one row each, in three
    joins, which spill where a triple has many. An event without a user, time or name matches nothing and keeps one row
    without parts. So events are read three times, and arrays are shuffled only where there are more than ``few`` shared
    triples (``few`` chooses the plan, never the result)."""
    rows = events.filter(in_days(start, end))
    complete = F.lit(True)
    for column in EVENT:
        complete = complete & F.col(column).isNotNull()
    shared = stored(rows.filter(complete).groupBy(*EVENT).count().filter("count > 1").drop("count"), "shared")
    known = F.broadcast(shared) if shared.limit(few + 1).count() <= few else shared
    arrays = ["event_params", "user_properties", "items"]
    whole = rows.select(*EVENT, *[F.when(complete, F.col(a)).alias(a) for a in arrays])
    once = (
        whole.join(known, EVENT, "left_anti")
        .select(*EVENT, F.explode_outer("event_params").alias("p"), "user_properties", "items")
        .select(*EVENT, *_param_columns("p"), F.explode_outer("user_properties").alias("u"), "items")
        .select(*EVENT, *_value_names("param"), *_property_columns("u"), F.explode_outer("items").alias("i"))
        .select(*EVENT, *_value_names("param"), *_value_names("user_property"), *_item_columns("i"))
    )
    again = stored(rows.select(*EVENT, *arrays).join(known, EVENT, "left_semi"), "again")
    parts = {
        "event_params": _param_columns("p"), "user_properties": _property_columns("p"), "items": _item_columns("p"),
    }
    matched = again.select(*EVENT)
    for column, values in parts.items():
        matched = matched.join(again.select(*EVENT, F.explode(column).alias("p")).select(*EVENT, *values), EVENT, "left")
    flat = once.unionByName(matched)
    order = ["user_pseudo_id", "event_timestamp", "event_name", "param_key", "user_property_key", "item_id"]
    return flat.orderBy(*order) if ordered else flat


def _value_names(kind: str) -> list[str]:
    names = [f"{kind}_key"] + [f"{kind}_{s}_value" for s in ("string", "int", "float", "double")]
    return names + ["user_property_set_timestamp"] if kind == "user_property" else names


def sales_customer_asof_membership(sales: DataFrame, customers: DataFrame, start, end) -> DataFrame:
    """Sales with the customer, for customers who were members on the day of the sale."""
    member = (sales["customer_id"] == customers["customer_id"]) & (
        sales["sale_date"] >= customers["membership_start_date"]
    )
    return sales.filter(between_dates("sale_date", start, end)).join(customers, member, "left").select(
        "sale_id", sales["customer_id"], "customer_name", "customer_email", "product_id", "sale_amount"
    )
