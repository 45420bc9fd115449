"""Reading the key/value columns of an event, and the flat view of an event that the reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def param_sql(key: str, slot: str, column: str = "event_params") -> str:
    """Value of ``key`` in one slot (``string``, ``int``, ``float``, ``double``); NULL when the key is absent.

    The key position and the slot are read as two plain arrays, so Parquet reads only the key leaf and
    that one slot, and the lookup stays inside generated code (a lambda ``filter`` would do neither)."""
    position = f"CAST(array_position({column}.key, '{key}') - 1 AS INT)"
    return f"get({column}.value.{slot}_value, {position})"


def param(key: str, slot: str, column: str = "event_params") -> Column:
    return F.expr(param_sql(key, slot, column))


# Purchase value as the sum of the numeric slots; NULL when the event has no ``value`` key.
SUMMED_VALUE = "CASE WHEN array_contains(event_params.key, 'value') THEN {} END".format(
    " + ".join(f"coalesce({param_sql('value', slot)}, 0)" for slot in ("int", "float", "double"))
)
# Purchase value from the first filled slot; 0 when there is none.
FIRST_VALUE = "coalesce({}, 0)".format(", ".join(param_sql("value", slot) for slot in ("double", "float", "int")))

_SESSION = param_sql("ga_session_id", "int")
_ADS = "session_traffic_source_last_click.google_ads_campaign"

# Name of each flat column and the expression it stands for.
FLAT_COLUMNS = {
    "event_date": "event_date",
    "event_day": "to_date(event_date, 'yyyyMMdd')",
    # Renamed, as a passed-through column is aliased on one side of a self-union only, which defeats exchange reuse.
    "event_micros": "event_timestamp",
    "sequence": "event_bundle_sequence_id",
    "event_name": "event_name",
    "user_pseudo_id": "user_pseudo_id",
    "ga_session_id": _SESSION,
    "session_id": f"CAST({_SESSION} AS STRING)",
    "has_session_id": "coalesce(array_contains(event_params.key, 'ga_session_id'), false)",
    # User and session number as one text key; NULL when either is missing.
    "session_key": f"concat(user_pseudo_id, '-', CAST({_SESSION} AS STRING))",
    "session_number": param_sql("ga_session_number", "int"),
    "page_location": param_sql("page_location", "string"),
    "page_referrer": param_sql("page_referrer", "string"),
    "engagement_msec": param_sql("engagement_time_msec", "int"),
    "engaged_int": param_sql("session_engaged", "int"),
    "engaged_text": param_sql("session_engaged", "string"),
    "entrances": param_sql("entrances", "int"),
    "bounce": param_sql("bounce", "int"),
    "source": param_sql("source", "string"),
    "medium": param_sql("medium", "string"),
    "campaign": param_sql("campaign", "string"),
    "utm_source": param_sql("utm_source", "string"),
    "utm_medium": param_sql("utm_medium", "string"),
    "utm_campaign": param_sql("utm_campaign", "string"),
    "event_source": param_sql("traffic_source", "string"),
    "loyalty_tier": param_sql("loyalty_tier", "string"),
    "value_double": param_sql("value", "double"),
    "param_revenue": param_sql("purchase_revenue", "double"),
    "summed_value": SUMMED_VALUE,
    "first_value": FIRST_VALUE,
    "first_source": "traffic_source.source",
    "first_medium": "traffic_source.medium",
    "manual_source": "collected_traffic_source.manual_source",
    "manual_medium": "collected_traffic_source.manual_medium",
    "manual_campaign": "collected_traffic_source.manual_campaign_name",
    "gclid": "collected_traffic_source.gclid",
    "ads_account": f"{_ADS}.account_name",
    "ads_campaign": f"{_ADS}.campaign_name",
    "primary_channel": "session_traffic_source_last_click.cross_channel_campaign.primary_channel_group",
    "purchase_revenue": "ecommerce.purchase_revenue",
    "purchase_revenue_usd": "ecommerce.purchase_revenue_in_usd",
    "transaction_id": "ecommerce.transaction_id",
    "device_category": "device.category",
    "device_language": "device.language",
    "device_system": "device.operating_system",
    "country": "geo.country",
    "analytics_storage": "privacy_info.analytics_storage",
    "ads_storage": "privacy_info.ads_storage",
    "event_value_in_usd": "event_value_in_usd",
    "items": "items",
}


def flatten(events: DataFrame) -> DataFrame:
    """One row per event with every parameter and struct field the reports read as a plain column.

    Columns a report does not use are pruned by the optimizer down to the Parquet leaves."""
    return events.selectExpr(*[f"{text} AS {name}" for name, text in FLAT_COLUMNS.items()])


def in_days(start, end) -> Column:
    """Inclusive date range as a comparison on the ``event_date`` partition column."""
    return F.col("event_date").between(str(start).replace("-", ""), str(end).replace("-", ""))


def named(*names: str) -> Column:
    return F.col("event_name").isin(*names) if len(names) > 1 else F.col("event_name") == names[0]
