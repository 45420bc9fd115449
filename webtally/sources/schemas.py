"""Schemas of the input tables, as the upstream exports fix them."""

from __future__ import annotations

from webtally.functions.fixed import APPEARANCE_FLAGS, ITEM_LIST_FIELDS, ITEM_NUMBER_FIELDS, ITEM_TEXT_FIELDS

_SLOTS = "string_value: string, int_value: bigint, float_value: double, double_value: double"
ITEM_FIELDS = {
    **dict.fromkeys(ITEM_TEXT_FIELDS, "string"), **dict(ITEM_NUMBER_FIELDS), **dict.fromkeys(ITEM_LIST_FIELDS, "string"),
}
_ITEM = ", ".join(f"{name}: {kind}" for name, kind in ITEM_FIELDS.items())

EVENT_FIELDS = {
    "event_date": "string",
    "event_timestamp": "bigint",
    "event_name": "string",
    "user_pseudo_id": "string",
    "event_value_in_usd": "double",
    "event_bundle_sequence_id": "bigint",
    "event_params": f"array<struct<key: string, value: struct<{_SLOTS}>>>",
    "user_properties": f"array<struct<key: string, value: struct<{_SLOTS}, set_timestamp_micros: bigint>>>",
    "items": f"array<struct<{_ITEM}>>",
    "traffic_source": "struct<source: string, medium: string>",
    "collected_traffic_source":
        "struct<manual_source: string, manual_medium: string, manual_campaign_name: string, gclid: string>",
    "session_traffic_source_last_click":
        "struct<google_ads_campaign: struct<account_name: string, campaign_name: string>, "
        "cross_channel_campaign: struct<primary_channel_group: string>>",
    "ecommerce": "struct<purchase_revenue: double, purchase_revenue_in_usd: double, transaction_id: string>",
    "device": "struct<category: string, language: string, operating_system: string>",
    "geo": "struct<country: string>",
    "privacy_info": "struct<analytics_storage: string, ads_storage: string>",
}
SEARCH_SITE_FIELDS = {
    "data_date": "date", "query": "string", "device": "string", "impressions": "bigint", "clicks": "bigint",
    "sum_top_position": "double",
}
SEARCH_URL_FIELDS = {
    "data_date": "date", "query": "string", "search_query": "string", "url": "string", "device_category": "string",
    "country": "string", "traffic_source": "string", "impressions": "bigint", "clicks": "bigint",
    **{flag: "boolean" for flag in APPEARANCE_FLAGS},
}
USER_FIELDS = {
    "pseudo_user_id": "string", "user_ltv": "struct<revenue_in_usd: double, sessions: bigint>", "snapshot_date": "date",
}
SALES_FIELDS = {
    "sale_id": "bigint", "customer_id": "bigint", "sale_date": "date", "sale_amount": "double", "product_id": "bigint",
}
CUSTOMER_FIELDS = {
    "customer_id": "bigint", "customer_name": "string", "customer_email": "string", "membership_start_date": "date",
}
MONTHLY_FIELDS = {
    "user_id": "bigint", "session_id": "string", "event_name": "string", "event_date": "date",
    "event_timestamp": "timestamp",
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())
