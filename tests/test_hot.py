"""The skew-sensitive queries against their SQL when one user has a third of all events."""

import pathlib

import duckdb
import pytest

from tests.compare import differences, duck
from webtally.plans.oracle import ORACLES
from webtally.plans.registry import QUERIES


@pytest.fixture(scope="module")
def hot_folder(folder, tmp_path_factory):
    target = tmp_path_factory.mktemp("hot")
    for path in pathlib.Path(folder).glob("*.parquet"):
        if path.stem != "events":
            (target / path.name).symlink_to(path)
    duckdb.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN (event_id * 2654435761) % 9 < 3 THEN 7 ELSE user_id END AS user_id)
        FROM '{folder}/events.parquet') TO '{target}/events.parquet' (FORMAT parquet)"""
    )
    return str(target)


@pytest.mark.parametrize("name", [
    "page_navigation_flow", "navigation_steps", "exit_pages", "session_metrics_by_source", "attribution_linear",
    "attribution_time_decay", "page_revenue_attribution", "source_product_revenue", "cohort_retention", "promo_funnel",
    "organic_query_value", "daily_metrics", "consent_summary",
])
def test_query_equals_sql_with_a_hot_user(spark, hot_folder, name):
    assert differences(QUERIES[name](spark, hot_folder), duck(hot_folder), ORACLES[name]) == []
