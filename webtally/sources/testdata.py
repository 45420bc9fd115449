"""Input tables derived from the driver's tables by fixed rules (see FIXTURES.md), without randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtally.functions.dates import DAY_MICROS
from webtally.functions.fixed import APPEARANCE_FLAGS
from webtally.functions.params import flatten
from webtally.sources.readers import read_events
from webtally.sources.schemas import EVENT_FIELDS, ITEM_FIELDS
from webtally.sources.writers import new_folder, write_by_date

HOST = "https://www.shop.example.com/"
# Fixed values of the derivation.
PAGES = ["", "products", "products/ring/", "promo/summer", "cart", "Checkout", "offer-week", "blog/sale-tips"]
EVENT_SUFFIXES = ["", "?ref=x", "#top"]
SEARCH_SUFFIXES = ["", "?g=1", "#s"]
CHANNELS = [
    ("google", "cpc"), ("google", "organic"), ("facebook", "paid_social"), ("newsletter", "email"), (None, None),
    ("bing", "organic"), ("youtube", "video"), ("amazon", "ppc"), ("etsy", "referral"), ("vimeo", "cpv"),
    ("adnet", "display"), ("instagram", "social"), ("partner", "affiliate"), ("blog", "referral"),
    ("podcast", "audio"), ("gateway", "sms"), ("app", "push"), ("site", "mobile"), ("unknown", "other"),
    ("direct", "none"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str | None], index: str) -> str:
    """SQL for the entry of a constant list at a 0-based index."""
    texts = ", ".join("CAST(NULL AS STRING)" if v is None else f"'{v}'" for v in values)
    return f"get(array({texts}), CAST({index} AS INT))"


def _slots(text: str = "NULL", whole: str = "NULL", double: str = "NULL", extra: str = "", single: str = "NULL") -> str:
    return (
        f"named_struct('string_value', CAST({text} AS STRING), 'int_value', CAST({whole} AS BIGINT), "
        f"'float_value', CAST({single} AS DOUBLE), 'double_value', CAST({double} AS DOUBLE){extra})"
    )


def _param(key: str, text: str = "NULL", whole: str = "NULL", double: str = "NULL", single: str = "NULL") -> str:
    """SQL for a parameter, NULL when it has no value."""
    present = " OR ".join(f"({v}) IS NOT NULL" for v in (text, whole, double, single) if v != "NULL")
    return f"CASE WHEN {present} THEN named_struct('key', '{key}', 'value', {_slots(text, whole, double, single=single)}) END"


def event_rows(spark: SparkSession, folder: str, stagger: bool = False) -> DataFrame:
    """Driver events as plain columns. ``stagger`` moves a user's events on by 0 to 3 weeks, by user id, so that
    users first appear in different weeks."""
    moved = f" + user_id % 4 * {7 * DAY_MICROS}" if stagger else ""
    return table(spark, folder, "events").selectExpr(
        "event_id AS e", "user_id AS uid", "value AS v", "event_type",
        f"unix_micros(CAST(ts AS TIMESTAMP)){moved} AS us", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    ).selectExpr("*", f"date_format(date_from_unix_date(CAST(us DIV {DAY_MICROS} AS INT)), 'yyyyMMdd') AS event_date")


def nested(plain: DataFrame) -> DataFrame:
    """Nested event table of plain rows (``event_rows``), each row by itself."""
    name = (
        "CASE event_type WHEN 'view' THEN 'page_view' WHEN 'purchase' THEN 'purchase' "
        f"WHEN 'click' THEN {_pick(['click', 'view_item', 'add_to_cart', 'page_view'], 'e % 4')} "
        f"WHEN 'error' THEN {_pick(['session_start', 'session_start', 'loyalty_tier_update'], 'e % 3')} "
        f"WHEN 'signup' THEN {_pick(['signup', 'page_view'], 'e % 2')} END"
    )
    source, medium = (_pick([pair[i] for pair in CHANNELS], "e % 20") for i in (0, 1))
    rows = plain.selectExpr(
        "*", f"{name} AS event_name", f"{source} AS src", f"{medium} AS med",
        "CASE WHEN k % 10 <> 9 THEN concat('camp', k % 5) END AS camp",
        "CASE WHEN e % 11 = 0 THEN concat('g', e) END AS gclid",
        f"us DIV {2 * DAY_MICROS} AS sid",
        "CASE WHEN event_type = 'purchase' THEN v END AS revenue",
    )
    page = f"concat('{HOST}', {_pick(PAGES, 'k % 8')}, {_pick(EVENT_SUFFIXES, 'e % 3')})"
    referrer = f"concat('{HOST}', {_pick(PAGES, '(k + 3) % 8')})"
    tier = _pick(["bronze", "silver", "gold"], "k % 3")
    params = [
        _param("ga_session_id", whole="sid"),
        _param("ga_session_number", whole="sid - 9860"),
        _param("page_location", text=f"CASE WHEN e % 37 <> 0 THEN {page} END"),
        _param("page_referrer", text=f"CASE WHEN e % 5 <> 0 THEN {referrer} END"),
        _param("engagement_time_msec", whole="k * 1000 + e % 1000"),
        _param("session_engaged", text="k % 2", whole="k % 2"),
        _param("entrances", whole="CAST(event_name = 'page_view' AND k % 3 = 0 AS BIGINT)"),
        _param("bounce", whole="CAST(k % 6 = 0 AS BIGINT)"),
        *[_param(key, text="src") for key in ("source", "utm_source", "traffic_source")],
        *[_param(key, text="med") for key in ("medium", "utm_medium")],
        *[_param(key, text="camp") for key in ("campaign", "utm_campaign")],
        _param(
            "value", whole="CASE WHEN e % 4 = 0 THEN floor(revenue) END", double="CASE WHEN e % 2 = 1 THEN revenue END",
            single="CASE WHEN e % 4 = 2 THEN revenue WHEN e % 12 = 0 AND revenue IS NOT NULL THEN 2.5 END",
        ),
        _param("purchase_revenue", double="revenue"),
        _param("loyalty_tier", text=f"CASE WHEN event_name = 'loyalty_tier_update' THEN {tier} END"),
    ]
    number = "(e * 7 + j)"
    filled = {
        "item_id": f"concat('i', {number} % 40)",
        "item_name": f"concat('name', {number} % 40)",
        "item_brand": "'acme'",
        "item_category": f"CASE WHEN (e + j) % 17 <> 0 THEN concat('cat', {number} % 5) END",
        "quantity": "1 + (k + j) % 3",
        "item_revenue": "CASE WHEN j = 0 THEN v ELSE k END",
        "affiliation": "'shop'",
    }
    item = ", ".join(f"'{n}', CAST({filled.get(n, 'NULL')} AS {kind})" for n, kind in ITEM_FIELDS.items())
    items = (
        "CASE WHEN event_name IN ('view_item', 'add_to_cart', 'purchase') AND e % 9 <> 0 "
        f"THEN transform(sequence(0, CAST(e % 2 AS INT)), j -> named_struct({item})) "
        f"ELSE from_json('[]', '{EVENT_FIELDS['items']}') END"
    )
    stamp = ", 'set_timestamp_micros', us - 1"
    plan = _pick(["free", "pro"], "uid % 2")
    properties = (
        "CASE WHEN e % 8 <> 0 THEN array("
        f"named_struct('key', 'plan', 'value', {_slots(text=plan, extra=stamp)}), "
        f"named_struct('key', 'visits', 'value', {_slots(whole='uid', extra=stamp)})) "
        f"ELSE from_json('[]', '{EVENT_FIELDS['user_properties']}') END"
    )
    columns = {
        "event_date": "event_date",
        "event_timestamp": "us",
        "event_name": "event_name",
        "user_pseudo_id": "CASE WHEN e % 50 <> 0 THEN concat('u', uid) END",
        "event_value_in_usd": "revenue",
        "event_bundle_sequence_id": "e",
        "event_params": f"array_compact(array({', '.join(params)}))",
        "user_properties": properties,
        "items": items,
        "traffic_source": "named_struct('source', src, 'medium', med)",
        "collected_traffic_source":
            "named_struct('manual_source', src, 'manual_medium', med, 'manual_campaign_name', "
            "CASE WHEN k % 20 = 0 THEN 'Cross-Network promo' ELSE concat('camp', k % 5) END, 'gclid', gclid)",
        "session_traffic_source_last_click":
            "named_struct('google_ads_campaign', named_struct("
            "'account_name', CASE WHEN gclid IS NOT NULL THEN concat('acct', k % 2) END, "
            "'campaign_name', CASE WHEN gclid IS NOT NULL THEN concat('ads', k % 4) END), "
            "'cross_channel_campaign', named_struct('primary_channel_group', "
            f"{_pick(['Paid Search', 'Display'], 'k % 2')}))",
        "ecommerce":
            "named_struct('purchase_revenue', revenue, 'purchase_revenue_in_usd', revenue, 'transaction_id', "
            f"CASE WHEN event_type = 'purchase' THEN concat('t', e, {_pick(['-live', '-test'], 'e % 2')}) END)",
        "device":
            f"named_struct('category', {_pick(['desktop', 'mobile', 'tablet'], '(e DIV 4) % 3')}, "
            "'language', CASE WHEN e % 13 <> 0 THEN 'en' END, "
            "'operating_system', CASE WHEN e % 13 <> 0 THEN concat('os', k % 3) END)",
        "geo": "named_struct('country', concat('NATION_', uid % 25))",
        "privacy_info":
            "named_struct('analytics_storage', CASE WHEN e % 5 = 0 THEN 'No' ELSE 'Yes' END, "
            "'ads_storage', CASE WHEN e % 10 = 0 THEN 'No' ELSE 'Yes' END)",
    }
    return rows.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


_written: dict[tuple[str, str, bool], str] = {}


def stored_events(spark: SparkSession, folder: str, stagger: bool = False) -> DataFrame:
    """The nested event table, written once per application as Parquet partitioned by day in the shared folder
    and read back, as the reports meet it in practice. Plain rows are shuffled, and nested in the task that writes them."""
    key = (spark.sparkContext.applicationId, folder, stagger)
    if key not in _written or not _exists(spark, _written[key]):
        path = new_folder(spark, "events")
        write_by_date(event_rows(spark, folder, stagger), path, widen=nested)
        _written[key] = path
    return read_events(spark, _written[key])


def search(spark: SparkSession, folder: str) -> DataFrame:
    """Search table with the columns of both the site grain and the URL grain."""
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    name = "CASE WHEN l_orderkey % 29 <> 0 THEN p_name END"
    device = _pick(["DESKTOP", "MOBILE", "TABLET"], "l_suppkey % 3")
    columns = {
        "data_date": "CAST(l_shipdate AS DATE)",
        "query": name,
        "search_query": f"CASE WHEN l_partkey % 6 = 0 THEN concat({name}, ' sale') ELSE {name} END",
        "url": f"concat('{HOST}', {_pick(PAGES, 'l_partkey % 8')}, {_pick(SEARCH_SUFFIXES, 'l_suppkey % 3')})",
        "device": device,
        "device_category": device,
        "country": "concat('NATION_', l_suppkey % 25)",
        "traffic_source": _pick(["web", "image", "news"], "l_linenumber % 3"),
        # Parts with a name of even length are shown rarely and at positions 1 to 20, all others at the top.
        "impressions":
            "CASE WHEN l_linenumber = 7 THEN 0 WHEN length(p_name) % 2 = 0 THEN 1 ELSE CAST(l_quantity AS BIGINT) END",
        "clicks":
            "CASE WHEN l_linenumber = 7 THEN 0 WHEN length(p_name) % 2 = 0 THEN l_orderkey % 2 ELSE floor(l_quantity * l_discount) END",
        "sum_top_position":
            "CAST(CASE WHEN length(p_name) % 2 = 0 THEN (length(p_name) * 3 + ascii(p_name)) % 20 ELSE l_linenumber * (l_suppkey % 5) END AS DOUBLE)",
    }
    for n, flag in enumerate(APPEARANCE_FLAGS):
        columns[flag] = f"CASE WHEN l_orderkey % {n + 3} <> 0 THEN l_partkey % {n + 2} = 0 END"
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Daily user snapshot: three days for each user, the last of them in another year."""
    buyers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    counts = orders.groupBy("o_custkey").count()
    return buyers.join(counts, buyers["c_custkey"] == counts["o_custkey"], "left").selectExpr(
        "concat('u', c_custkey) AS pseudo_user_id", "c_custkey", "c_acctbal", "coalesce(count, 0) AS n",
        "inline(array(named_struct('d', DATE'2024-01-15', 'k', 0), named_struct('d', DATE'2024-03-01', 'k', 1), "
        "named_struct('d', DATE'2023-06-30', 'k', 2)))",
    ).selectExpr(
        "pseudo_user_id",
        "named_struct('revenue_in_usd', CASE k WHEN 0 THEN c_acctbal WHEN 1 THEN c_acctbal * 0.5 + 100 ELSE 100000 - c_acctbal END, "
        "'sessions', n + CASE k WHEN 0 THEN 0 WHEN 1 THEN c_custkey % 7 ELSE 50 END) AS user_ltv",
        "d AS snapshot_date",
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS sale_id", "o_custkey AS customer_id", "CAST(o_orderdate AS DATE) AS sale_date",
        "o_totalprice AS sale_amount", "o_orderkey % 2000 AS product_id",
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS customer_id", "c_name AS customer_name", "concat(lower(c_name), '@example.com') AS customer_email",
        "date_add(DATE'1995-01-01', CAST(c_custkey % 2000 AS INT)) AS membership_start_date",
    )


def monthly_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the monthly tables, taken from the stored events so that each month reads only its own days."""
    return flatten(stored_events(spark, folder)).selectExpr(
        "CAST(substr(user_pseudo_id, 2) AS BIGINT) AS user_id", "session_id", "event_name", "event_day AS event_date",
        "timestamp_micros(event_micros) AS event_timestamp",
    )
