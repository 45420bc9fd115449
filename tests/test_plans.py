"""What the physical plans must look like: pruned, free of Python and of pairwise joins, and read once."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from webtally.operators import attribution, navigation, sessions
from webtally.plans.registry import QUERIES, YEAR
from webtally.sources import testdata, writers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_pairwise_join(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert not re.search(r"Python|ArrowEval|MapInPandas|BatchEval", text)
    assert not re.search(r"CartesianProduct|NestedLoopJoin", text)


def test_days_prune_partitions_and_lookups_prune_leaves(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    events = testdata.stored_events(spark, folder)
    text = plan(sessions.page_engagement(events, "2024-01-05", "2024-01-06"))
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ >= 20240105\)", text)
    assert re.search(r"ReadSchema: (\S+)", text).group(1) == (
        "struct<event_name:string,event_params:array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>>"
    )


@pytest.mark.parametrize(
    "report, scans",
    [(navigation.page_navigation_flow, 1), (navigation.navigation_steps, 1), (attribution.page_revenue_attribution, 2)],
)
def test_span_windows_share_their_shuffle(spark, folder, report, scans):
    df = report(testdata.stored_events(spark, folder), *YEAR)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", final)) == scans
    assert "ReusedExchange" in final


@pytest.mark.parametrize("name, scans, exchanges", [
    ("promo_users", 3, None), ("promo_funnel", 5, None),  # the window's days twice: for its users, and for its views
    ("organic_query_value", 6, None),
    ("promo_ctr", 1, 1), ("promo_touch_attribution", 1, 1), ("promo_user_journey", 1, 1), ("user_clv", 1, 2),
    ("promo_traffic_breakdown", 1, 2), ("promo_vs_non_promo", 1, 2),
])
def test_promotion_reports_read_and_shuffle_little(spark, folder, name, scans, exchanges):
    """Scans of all tables, the two behind the search fixture included."""
    text = plan(QUERIES[name](spark, folder))
    assert len(re.findall("FileScan", text)) <= scans
    assert exchanges is None or len(re.findall(r"\bExchange ", text)) <= exchanges + 1
    if name == "user_clv":
        assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_name,purchase\)", text)
    if name in ("promo_traffic_breakdown", "promo_vs_non_promo"):
        assert text.index("Expand") < text.index("FileScan") and text.count("HashAggregate") >= 4


def test_flat_events_gathers_and_shuffles_no_arrays(spark, folder):
    """Events are counted and the shared ones stored before; what is left reads the events once and sorts nothing."""
    df = QUERIES["flat_events"](spark, folder)
    text = plan(df)
    assert "collect_list" not in text and "Sort [user_pseudo_id" not in text
    assert len(re.findall(r"FileScan.*event_date", text)) == 1
    assert not re.search(r"rangepartitioning", text)


@pytest.mark.parametrize("name", ["promo_user_engagement", "promo_bounce", "promo_retention", "promo_funnel", "promo_users"])
def test_recent_promotion_users_are_chosen_before_their_history_is_added_up(spark, folder, name):
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, folder))
    finally:
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    semi = text.index("LeftSemi")
    assert text.count("keys=[user_pseudo_id#", 0, semi) >= 2  # totals above the join
    assert "might_contain" in text[semi:]  # other users end at the scan of their history


@pytest.mark.parametrize("name", ["attribution_time_decay", "attribution_time_decay_before"])
def test_time_decay_reads_interactions_once_beside_stored_purchases(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert len(re.findall(r"FileScan.*event_date", text)) == 1 and len(re.findall("FileScan", text)) == 2


def test_events_are_nested_after_their_shuffle_and_sort(spark, folder, monkeypatch):
    monkeypatch.setattr(testdata, "_written", {})
    frames, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args: (frames.append(self._df), write(self, *args)))
    testdata.stored_events(spark, folder)
    written, = frames
    text = plan(written)
    assert len(re.findall("Exchange", text)) == 1 and len(re.findall(r"Sort \[", text)) == 1
    # The plan is printed from the top: neither the shuffle and the sort nor what is below them knows the nested columns.
    above, below = text.split("Sort [", 1)
    assert "event_params" in above and "event_params" not in below and "items" not in below
    # Spark keeps this order when it writes, as the date can't be null; else it would sort the nested rows.
    assert written.schema["event_date"].nullable is False
    assert "event_date" in written._jdf.queryExecution().optimizedPlan().outputOrdering().mkString()


def test_widened_rows_without_a_date_stay(spark, tmp_path):
    rows = spark.createDataFrame([("20240102", 1), (None, 2), ("20240101", 3)], "event_date string, n int")
    path = str(tmp_path / "days")
    writers.write_by_date(rows, path, widen=lambda df: df.select("event_date", "n", F.array("n", "n").alias("pair")))
    back = spark.read.schema("n int, pair array<int>, event_date string").parquet(path).orderBy("n").collect()
    assert [tuple(r) for r in back] == [(1, [1, 1], "20240102"), (2, [2, 2], None), (3, [3, 3], "20240101")]
