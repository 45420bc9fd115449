"""Hand-written events with the values each report must give: ties, missing keys, empty input, zero divisors."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.build import DAY, at, event, events, rows, view
from webtally.functions.channels import channel_grouping
from webtally.functions.dates import iso_week_label, week_of_year, week_start, weekday_label
from webtally.functions.numbers import safe_corr
from webtally.functions.params import flatten, param
from webtally.functions.urls import page_path, tidy_url, transform_url, without_query_and_fragment
from webtally.operators import attribution, campaigns, daily, navigation, privacy, promo, search, sessions, shaping, users
from webtally.sources import readers, schemas, writers

HOST = "https://shop.example.com"


def values(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_param_is_null_without_the_key_and_takes_the_slot_asked_for(spark):
    df = events(spark, [event("u", "2024-01-05 10:00:00", "page_view", 7, {"source": "s"}), event("u", "2024-01-05 10:00:01", "x", None)])
    got = rows(df.select(param("ga_session_id", "int"), param("ga_session_id", "string"), param("source", "string"), param("no", "int")))
    assert got == [(7, None, "s", None), (None, None, None, None)]


def test_session_key_is_null_when_a_part_is(spark):
    df = events(spark, [event("u", 0, "x", 7), event(None, 0, "x", 7), event("u", 0, "x", None)])
    assert rows(flatten(df).select("session_key")) == [("u-7",), (None,), (None,)]


def test_url_helpers(spark):
    url = F.lit(f"{HOST}/A/b/?q=1#f")
    assert values(spark, page_path(url), without_query_and_fragment(url), tidy_url(url), page_path(F.lit("http://h/a#f"))) == (
        "/A/b/", f"{HOST}/A/b/", f"{HOST}/a/b", "/a#f",
    )
    assert values(spark, *[transform_url(url, part) for part in ("parameters", "protocol", "domain", "all", "other")]) == (
        f"{HOST}/A/b/", "shop.example.com/A/b/?q=1#f", "/A/b/?q=1#f", "/A/b/", None,
    )


CHANNELS = [
    ((None, "cpc", None, "g"), "Direct"), (("google", None, None, None), "Direct"),
    (("google", "cpc", "x Cross-Network y", None), "Cross-network"), (("Etsy", "CPC", None, None), "Paid Shopping"),
    (("etsy", "ppc", None, "g"), "Paid Shopping"), (("bing", "paid", None, None), "Paid Search"),
    (("zzz", "email", None, "g"), "Paid Search"), (("google", "cpm", None, None), "Paid Search"),
    (("fb", "paid_social", None, None), "Paid Social"), (("vimeo", "cpv", None, None), "Paid Video"),
    (("site", "Banner", None, None), "Display"), (("site", "cpm", None, None), "Display"),
    (("ebay", "x", None, None), "Organic Shopping"), (("my-fb-page", "x", None, None), "Organic Social"),
    (("x", "sm", None, None), "Organic Social"), (("twitch", "x", None, None), "Organic Video"),
    (("x", "in-video", None, None), "Organic Video"), (("yahoo", "x", None, None), "Organic Search"),
    (("x", "organic", None, None), "Organic Search"), (("x", "e-mail", None, None), "Email"),
    (("x", "affiliate", None, None), "Affiliates"), (("x", "referral", None, None), "Referral"),
    (("x", "audio", None, None), "Audio"), (("x", "sms", None, None), "SMS"),
    (("x", "webpush", None, None), "Push Notifications"), (("x", "mobile app", None, None), "Push Notifications"),
    (("x", "y", None, None), "Unassigned"),
]


@pytest.mark.parametrize("fields, channel", CHANNELS)
def test_channel_rules_and_their_order(spark, fields, channel):
    assert values(spark, channel_grouping(*[F.lit(f).cast("string") for f in fields])) == (channel,)


def test_calendar_parts(spark):
    day = {d: F.lit(d).cast("date") for d in ("2024-01-01", "2023-01-01", "2024-12-30", "2024-12-22", "2024-12-29")}
    assert values(spark, week_of_year(day["2024-01-01"]), week_of_year(day["2023-01-01"])) == ("01", "00")
    assert values(spark, weekday_label(day["2023-01-01"]), weekday_label(day["2024-01-01"])) == ("0 - Sunday", "1 - Monday")
    assert values(spark, iso_week_label(day["2024-12-30"]), iso_week_label(day["2024-12-29"])) == ("2025-01", "2024-52")
    assert values(spark, F.datediff(week_start(day["2024-12-30"]), week_start(day["2024-12-22"]))) == (14,)


def test_navigation_orders_ties_by_sequence_and_keeps_missing_pages(spark):
    df = events(spark, [
        view("u", "2024-01-05 10:00:00", f"{HOST}/a"), view("u", "2024-01-05 10:00:00", f"{HOST}/b?x"),
        view("u", "2024-01-05 12:30:00", None), view("v", "2024-01-05 10:00:00", f"{HOST}/a"),
        view(None, "2024-01-05 10:00:00", f"{HOST}/z"),
    ])
    assert set(rows(navigation.page_navigation_flow(df, *DAY))) == {
        ("(entrance)", "/a", "/b", 1), ("/a", "/b", "(exit)", 1), ("/b", None, "(exit)", 1),
        ("(entrance)", "/a", "(exit)", 1), ("(entrance)", "/z", "(exit)", 0),
    }


def test_navigation_without_loops(spark):
    pages = ["a", "a", "b", "a", "c"]
    df = events(spark, [view("u", f"2024-01-05 1{i}:00:00", f"{HOST}/{p}") for i, p in enumerate(pages)])
    assert set(rows(navigation.navigation_without_loops(df, *DAY))) == {("/a", "/b", "/a", 1), ("/b", "/a", "/c", 1), ("/a", "/c", "(exit)", 1)}


def first_visit(user, hour, page, **params):
    return view(user, f"2024-01-05 {hour:02d}:00:00", f"{HOST}/{page}", params={"ga_session_number": 1, **params})


def test_steps_skip_repeats_and_stop_at_five(spark):
    df = events(spark, [first_visit("u", h, p) for h, p in enumerate(["A/", "a?x=1", "b", "c", "d", "e", "f"])])
    assert rows(navigation.navigation_steps(df, *DAY)) == [tuple(f"{HOST}/{p}" for p in "abcde") + (1,)]


def test_steps_end_where_the_campaign_changes(spark):
    df = events(spark, [
        first_visit("u", 1, "a", campaign="x"), first_visit("u", 2, "b", campaign="y"), first_visit("u", 3, "c", campaign="x"),
        first_visit("v", 1, "a"),
    ])
    assert set(rows(navigation.navigation_steps(df, *DAY))) == {
        (f"{HOST}/a", None, f"{HOST}/c", None, None, 1), (f"{HOST}/a", None, None, None, None, 1),
    }


def test_exit_pages_and_landing_conversion(spark):
    df = events(spark, [
        view("u", "2024-01-05 10:00:00", "a"), view("u", "2024-01-05 11:00:00", "b"), view("v", "2024-01-05 10:00:00", "b"),
        view("v", "2024-01-05 11:00:00", None), event("u", "2024-01-05 09:00:00", "purchase"),
        event("u", "2024-01-05 12:00:00", "purchase"), event("w", "2024-01-05 12:00:00", "purchase"),
    ])
    assert rows(navigation.exit_pages(df, *DAY)) == [("b", 1)]
    assert rows(navigation.landing_page_conversion(df, *DAY)) == [("a", 2)]


def test_midnight_splits_a_session(spark):
    df = events(spark, [event("u", "2024-01-05 23:59:00", "x"), event("u", "2024-01-05 23:59:30", "x"), event("u", "2024-01-06 00:01:00", "x")])
    assert rows(sessions.average_session_duration(df, *DAY)) == [(datetime.date(2024, 1, 5), 30.0), (datetime.date(2024, 1, 6), 0.0)]


def test_missing_page_never_counts_as_engaged(spark):
    engaged = {"session_engaged": 1}
    df = events(spark, [view("u", "2024-01-05 10:00:00", None, params=engaged), view("u", "2024-01-05 10:00:00", "a", params=engaged)])
    day = datetime.date(2024, 1, 5)
    assert rows(sessions.bounce_rate_by_page(df, *DAY)) == [(day, None, 1, 0, 1.0), (day, "a", 1, 1, 0.0)]


def test_conversion_rate_is_null_without_purchases_and_counts_all_sessions_of_a_buyer(spark):
    df = events(spark, [
        event("a-b", "2024-01-05 10:00:00", "purchase", 1), event("a-b", "2024-01-05 10:00:00", "x", 2),
        event("u", "2024-01-05 10:00:00", "x", 1), event("u", "2024-01-06 10:00:00", "x", 1),
    ])
    assert rows(sessions.session_conversion_rate(df, *DAY)) == [
        (datetime.date(2024, 1, 5), 3, 2, 66.667), (datetime.date(2024, 1, 6), 1, 0, None),
    ]


def test_source_metrics_prefer_the_click_id_and_call_missing_parts_direct(spark):
    source = {"manual_source": "s", "manual_medium": "m", "manual_campaign_name": None, "gclid": None}
    df = events(spark, [
        event("u", 0, "page_view", collected_traffic_source={**source, "gclid": "g"}, event_date="20240105"),
        event("v", 0, "purchase", collected_traffic_source=source, event_date="20240105"),
        event("w", 0, "signup", collected_traffic_source={**source, "manual_medium": None}, event_date="20240105"),
    ])
    got = {r[0]: (r[1], r[2], r[6], r[8], r[9], r[11]) for r in rows(sessions.session_metrics_by_source(df, *DAY))}
    assert got == {"google / cpc": (1, 1, 1, 0, 0, 0.0), "s / m": (1, 1, 0, 0, 1, 1.0), "direct": (1, 1, 0, 1, 0, 0.0)}


def test_hourly_steps_without_items_are_null(spark):
    item = {name: None for name in schemas.ITEM_FIELDS}
    df = events(spark, [
        event("u", "2024-01-07 05:10:00", "session_start", 1), event("v", "2024-01-07 05:20:00", "session_start", 1),
        event("u", "2024-01-07 05:30:00", "view_item", 1), event("u", "2024-01-07 05:30:00", "purchase", 1, items=[item, item]),
        event("u", "2024-01-07 06:30:00", "page_view", 1),
    ])
    assert rows(sessions.hourly_event_funnel(df, *DAY)) == [
        (datetime.date(2024, 1, 7), "01", "0 - Sunday", "05", 1, None, None, None, 1),
    ]


def test_first_click_takes_purchases_before_it_and_drops_those_without_value(spark):
    df = events(spark, [
        event("u", "2024-01-05 09:00:00", "purchase", 1, {"value": 5}),
        event("u", "2024-01-05 10:00:00", "session_start", 1, {"utm_source": "first"}),
        event("u", "2024-01-05 11:00:00", "session_start", 1, {"utm_source": "second"}),
        event("u", "2024-01-05 12:00:00", "purchase", 1, {"value": 2.5}), event("u", "2024-01-05 12:00:00", "purchase", 1),
        event("v", "2024-01-05 10:00:00", "session_start", 1, {"utm_source": "none"}),
    ])
    assert rows(attribution.attribution_first_click(df, *DAY)) == [("first", None, None, 7.5)]


def test_linear_scores_do_not_sum_to_one(spark):
    def hit(name, source, **more):
        return event("u", "2024-01-05 10:00:00", name, traffic_source={"source": source, "medium": None}, **more)

    bought = {"purchase_revenue": 9.0, "purchase_revenue_in_usd": 9.0, "transaction_id": "t"}
    df = events(spark, [hit("x", "a"), hit("x", "a"), hit("purchase", "b", ecommerce=bought), hit("x", None)])
    assert set(rows(attribution.attribution_linear(df, *DAY))) == {("a", 1.0, None), ("b", 0.5, 9.0), (None, 0.0, None)}


def test_loyalty_keeps_buyers_without_a_tier(spark):
    def tier(user, name):
        return event(user, "2024-01-05 10:00:00", "loyalty_tier_update", 1, {"loyalty_tier": name})

    df = events(spark, [tier("u", "gold"), tier("u", "silver"), event("u", 0, "purchase", event_date="20240105"),
                        event("v", 0, "purchase", event_date="20240105"), event(None, 0, "purchase", event_date="20240105")])
    assert set(rows(users.loyalty_tiers(df, *DAY))) == {("silver", 1, 1, 1.0), (None, 1, 1, 1.0)}


def test_cohorts_cross_the_iso_year(spark):
    df = events(spark, [event("u", f"{d} 10:00:00", "x") for d in ("2024-12-22", "2024-12-29", "2024-12-30")])
    [row] = users.cohort_retention(df, *DAY).collect()
    assert (row["year_week"], row["cohort_size"], row["week_0"], row["week_1"], row["week_2"], row["week_3"]) == ("2024-51", 1, 1, 1, 1, 0)
    assert (row["week_1_retention_rate"], row["week_3_retention_rate"]) == (100.0, 0.0)


def test_correlation_without_spread_is_null(spark):
    def corr(*pairs):
        return spark.createDataFrame(list(pairs), "x double, y double").agg(safe_corr(F.col("x"), F.col("y"))).first()[0]

    assert corr((1.0, 2.0)) is None
    assert corr((1.0, 2.0), (1.0, 3.0)) is None
    assert corr((1.0, 2.0), (2.0, 4.0), (None, 9.0)) == pytest.approx(1.0)


def site_rows(spark, *data):
    return spark.createDataFrame(list(data), schemas.ddl(schemas.SEARCH_SITE_FIELDS))


def test_trend_fills_days_without_correlation(spark):
    day = datetime.date(2024, 1, 1)
    df = site_rows(spark, (day, "a", "d", 10, 1, 0.0), (day, "b", "d", 10, 5, 10.0))
    got = rows(search.ctr_position_corr_trend(df, "2024-01-01", "2024-01-02"))
    assert got == [(day, 1.0, 1.0, 1.0, 1.0, 0.5), (datetime.date(2024, 1, 2), 0.0, 0.5, 0.5, 0.5, 0.5)]


def test_query_rates_are_null_without_impressions(spark):
    df = site_rows(spark, (datetime.date(2024, 1, 1), "a", "d", 0, 0, 0.0), (datetime.date(2024, 1, 1), None, "d", 5, 1, 0.0))
    assert rows(search.search_query_device(df, *DAY)) == [("a", "d", 0, 0, None, None)]


def test_appearance_totals_of_nothing_are_one_row(spark):
    df = spark.createDataFrame([], schemas.ddl(schemas.SEARCH_URL_FIELDS))
    [row] = rows(search.search_appearance_totals(df, *DAY))
    assert len(row) == 29 and set(row) == {None}


def test_trend_of_sessions(spark):
    df = events(spark, [event("u", "2024-01-05 10:00:00", "x", s) for s in (1, 2)] + [event("u", "2024-01-06 10:00:00", "x", 1), event("u", "2024-01-08 10:00:00", "purchase", 1, {"value": 3})])
    got = [r[1:] for r in rows(daily.performance_trend(df, *DAY))]
    assert got == [(2, None, 2.0, "Stable", 0, None), (1, 2, 1.5, "Decrease", 0, None), (1, 1, 1.33, "Stable", 1, None)]


def test_daily_metrics_join_user_and_session_without_separator(spark):
    df = events(spark, [event("u1", "2024-01-05 10:00:00", "x", 23), event("u12", "2024-01-05 10:00:10", "x", 3), event(None, "2024-01-05 10:00:00", "x", 1)])
    [row] = daily.daily_metrics(df, *DAY).collect()
    assert (row["sessions"], row["totalUsers"], row["eventCount"], row["purchaseRevenue"], row["engagementRate_percent"]) == (1, 2, 3, 0.0, 0.0)


def test_consent_estimate(spark):
    df = events(spark, [view("u", "2024-01-05 10:00:00", "p")] * 3 + [view(None, "2024-01-05 10:00:00", "p")])
    assert rows(privacy.consent_user_estimate(df, *DAY)) == [("Granted", 3, 1, 2, 0.75), ("Denied", 1, 0, 0, 0.25)]
    assert rows(privacy.consent_user_estimate(df, *DAY, factors={"Granted": 3.0}))[1] == ("Denied", 1, 0, None, 0.25)


def test_pivot_keeps_users_without_listed_events(spark):
    df = events(spark, [event("u", 0, "other", event_date="20240105"), event("v", 0, "page_view", event_date="20240105")])
    assert rows(shaping.event_pivot(df, *DAY, ["page_view", "upgrade"])) == [("u", 0, 0), ("v", 1, 0)]


def prop(key):
    return {"key": key, "value": {"string_value": key, "int_value": None, "float_value": None, "double_value": None, "set_timestamp_micros": 1}}


def item(name):
    return {field: name if field == "item_id" else None for field in schemas.ITEM_FIELDS}


def test_flat_events_equal_the_joins_they_stand_for(spark):
    time = "2024-01-05 10:00:00"
    df = events(spark, [
        event("u", time, "x", 1, {"a": 1, "b": "t"}, user_properties=[prop("p"), prop("q")], items=[item("i")]),
        event("u", time, "x", 1, {"a": 2}, items=[item("j")]),
        event("u", time, "y", None), event(None, time, "x", 1, {"a": 3}, user_properties=[prop("p")]),
    ])
    key = ["user_pseudo_id", "event_timestamp", "event_name"]
    joined = df.select(*key)
    for part in (shaping.flat_event_params, shaping.flat_user_properties, shaping.flat_items):
        joined = joined.join(part(df, *DAY), key, "left")
    flat = shaping.flat_events(df, *DAY)
    assert flat.columns == joined.columns and len(flat.columns) == 40
    assert sorted(rows(flat), key=str) == sorted(rows(joined), key=str)
    assert flat.count() == 2 * 5 * 2 * 2 + 1 + 1


def test_sales_join_needs_membership_on_the_day(spark):
    day = datetime.date
    sales = spark.createDataFrame([(1, 7, day(2024, 1, 5), 1.0, 9), (2, 7, day(2024, 1, 4), 1.0, 9), (3, None, day(2024, 1, 5), 1.0, 9), (4, 7, day(2023, 1, 5), 1.0, 9)], schemas.ddl(schemas.SALES_FIELDS))
    customers = spark.createDataFrame([(7, "n", "e", day(2024, 1, 5))], schemas.ddl(schemas.CUSTOMER_FIELDS))
    assert sorted(rows(shaping.sales_customer_asof_membership(sales, customers, *DAY))) == [
        (1, 7, "n", "e", 9, 1.0), (2, 7, None, None, 9, 1.0), (3, None, None, None, 9, 1.0),
    ]


def promo_events(spark):
    bought = {"purchase_revenue": 4.0, "purchase_revenue_in_usd": 4.0, "transaction_id": "t"}
    engaged = {"session_engaged": {"string_value": "0"}}
    return events(spark, [
        view("u", "2024-01-20 10:00:00", f"{HOST}/Sale/x", params=engaged), view("u", "2024-01-20 10:00:00", f"{HOST}/other", 2),
        event("u", "2024-01-25 10:00:00", "purchase", 2, {"session_engaged": {"string_value": "1"}}, ecommerce=bought),
        view("v", "2023-06-01 10:00:00", f"{HOST}/offer"), view(None, "2024-01-20 10:00:00", f"{HOST}/deal"),
        view("w", "2024-01-20 10:00:00", f"{HOST}/wholesale"),
    ])


def test_promo_reports(spark):
    df = promo_events(spark)
    recent = {"as_of": "2024-01-31"}
    assert rows(promo.promo_user_engagement(df, **recent)) == [("u", 2, 3, 1, 4.0, 0.5)]
    assert rows(promo.promo_bounce(df, **recent)) == [("u", 1, 2, 0.5)]
    assert rows(promo.promo_retention(df, **recent)) == [("u", at("2024-01-20 10:00:00"), at("2024-01-25 10:00:00"), 5, 2)]
    assert rows(promo.user_clv(df)) == [("u", 4.0, 1, 4.0, 4.0)]
    assert {r[0]: r[3] for r in rows(promo.promo_touch_attribution(df))} == {"u": 1 / 3, "v": 1.0, None: 1.0, "w": 0.0}
    assert {r[0]: r[1:] for r in rows(promo.promo_ctr(df))} == {"u": (0, 1, 0.0), "v": (0, 1, 0.0), None: (0, 1, 0.0), "w": (0, 0, None)}
    assert {(r[0], r[1], r[8]) for r in rows(promo.promo_users(df, **recent))} == {("u", f"{HOST}/Sale/x", 1), (None, f"{HOST}/deal", None)}
    assert {(r[0], r[1], r[3]) for r in rows(promo.promo_vs_non_promo(df))} == {(True, 2, 0), (False, 2, 0), (None, 1, 1)}


def test_organic_credit_is_shared_by_clicks(spark):
    organic = {"manual_source": "google", "manual_medium": "organic", "manual_campaign_name": None, "gclid": None}
    df = events(spark, [
        event("u", "2024-01-05 10:00:00", "session_start", 1, {"page_location": f"{HOST}/a?x"}, collected_traffic_source=organic),
        event("u", "2024-01-05 10:00:00", "purchase", 1, {"value": 5.0}), event("u", "2024-01-05 10:00:00", "purchase", 1),
    ])
    day = datetime.date(2024, 1, 5)
    fields = {k: schemas.SEARCH_URL_FIELDS[k] for k in ("data_date", "query", "url", "clicks")}
    clicks = spark.createDataFrame([(day, "p", "http://h/a#t", 3), (day, "q", f"{HOST}/a", 1), (day, "q", f"{HOST}/b", 9), (day, None, f"{HOST}/a", 9)], schemas.ddl(fields))
    assert rows(campaigns.organic_query_value(df, clicks, *DAY)) == [("p", 1.5, 7.5), ("q", 0.5, 2.5)]


REPORTS_WITH_RATIOS = [
    navigation.page_navigation_flow, navigation.navigation_steps, navigation.landing_pages_top10, sessions.average_session_duration,
    sessions.session_metrics_by_source, sessions.session_conversion_rate, sessions.bounce_rate_by_page, sessions.page_engagement,
    sessions.hourly_event_funnel, attribution.attribution_first_click, attribution.attribution_last_click,
    attribution.attribution_linear, attribution.attribution_time_decay, attribution.page_revenue_attribution,
    attribution.source_product_revenue, attribution.marketing_channels, campaigns.ads_campaign_performance,
    campaigns.ads_campaign_sessions, campaigns.ads_revenue_transactions, daily.daily_metrics, daily.performance_trend,
    privacy.consent_user_estimate, privacy.consent_summary, privacy.measurement_protocol_ratio, shaping.flat_events,
]


@pytest.mark.parametrize("report", REPORTS_WITH_RATIOS, ids=lambda r: r.__name__)
def test_no_events_give_no_rows(spark, report):
    assert report(events(spark, []), *DAY).count() == 0


def test_monthly_tables(spark, tmp_path):
    names = [name for name, _, _ in writers.month_names("2024-02-29", 4)]
    assert names == ["202402", "202401", "202312", "202311"]
    df = spark.createDataFrame(
        [(1, "s", "x", datetime.date(2024, 1, 31), datetime.datetime(2024, 1, 31, 23)), (2, "s", "x", datetime.date(2023, 1, 1), None)],
        schemas.ddl(schemas.MONTHLY_FIELDS),
    )
    for _ in range(2):
        paths = writers.write_monthly_tables(df, str(tmp_path), "2024-02-29", 3)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["web_analytics_202402", "web_analytics_202401", "web_analytics_202312"]
    assert [writers.read_monthly_table(spark, p).count() for p in paths] == [0, 1, 0]
    assert (tmp_path / "web_analytics_202401" / "event_date=2024-01-31").is_dir()


def test_reader_keeps_day_partitions_as_text(spark, tmp_path):
    df = events(spark, [event("u", "2024-01-05 10:00:00", "x"), event("u", "2024-01-06 10:00:00", "x")])
    writers.write_by_date(df, str(tmp_path / "ev"))
    back = readers.read_events(spark, str(tmp_path / "ev"), "2024-01-06", "2024-01-06")
    assert back.schema["event_date"].dataType.simpleString() == "string"
    assert [r["event_date"] for r in back.collect()] == ["20240106"]


class _Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        writers.shared_folder(_Cluster)


def test_flat_events_of_many_events_at_one_time(spark):
    """All share user, time and name, so every one gets the parts of all."""
    rows_ = [event("u", "2024-01-05 10:00:00", "x", None, {"k": i}) for i in range(30)]
    flat = shaping.flat_events(events(spark, rows_), *DAY)
    assert flat.count() == 900 and flat.select("param_int_value").distinct().count() == 30


def test_a_failing_monthly_write_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    """Whatever step fails, every table reads whole, old or new, and the next write goes on from there."""
    def write(user):
        rows_ = [(10 * user + m, "s", "x", datetime.date(2024, m, 3), None) for m in (1, 2)]
        df = spark.createDataFrame(rows_, schemas.ddl(schemas.MONTHLY_FIELDS))
        return writers.write_monthly_tables(df, str(tmp_path), "2024-02-29", 2)

    def read(paths):
        return [r["user_id"] for p in paths for r in writers.read_monthly_table(spark, p).collect()]

    paths = write(1)
    assert read(paths) == [12, 11]
    move, moves = writers._move, []

    def failing(*args):
        moves.append(args)
        if len(moves) == fail_at:
            raise OSError("lost")
        move(*args)

    # Moves: the old table of February aside, its new one in, then those of January; the third write finds one aside.
    for fail_at, want in ((1, [12, 11]), (2, [12, 11]), (3, [22, 11])):
        moves.clear()
        monkeypatch.setattr(writers, "_move", failing)
        with pytest.raises(OSError):
            write(2)
        assert read(paths) == want
        monkeypatch.setattr(writers, "_move", move)
    assert read(write(3)) == [32, 31]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_old-")]
