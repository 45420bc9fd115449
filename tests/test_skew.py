"""Span-wise windows and the dealt-out join against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from webtally.operators.attribution import attribution_time_decay, page_revenue_attribution
from webtally.operators.skew import EVENT_ORDER, measured_span, neighbours, running
from tests.build import DAY, event, events, rows, view

HOUR = 3_600_000_000


def skewed(seed: int, n: int = 400) -> list[tuple]:
    """(key, time, sequence, value): half of the rows have one key, some none, and times repeat."""
    pick = random.Random(seed)
    keys = ["hot"] * 6 + [None] * 3 + ["a", "b", "c"]
    return [
        (pick.choice(keys), pick.randrange(40) * HOUR // 4, i, pick.choice([None, 1, 2, 3, 5])) for i in range(n)
    ]


SCHEMA = "k string, event_micros bigint, sequence bigint, v bigint"


def crowded(seed: int, n: int = 300) -> list[tuple]:
    """A key, and the missing one, with all rows in one hour: a third at one microsecond, a third in one millisecond."""
    pick = random.Random(seed)
    base = 473_000 * HOUR
    times = [lambda: 1234, lambda: 5_000_000 + pick.randrange(1000), lambda: pick.randrange(HOUR)]
    rows_ = [(pick.choice(["hot", None]), base + pick.choice(times)(), i - 20, pick.choice([None, 1, 2, 3])) for i in range(n)]
    return [*rows_, ("a", base, 2**62, 1), ("a", base - HOUR, -(2**62), 2), ("hot", base - 5 * HOUR, 7, 4)]


def test_no_span_has_more_rows_than_allowed(spark):
    df = spark.createDataFrame(crowded(1), SCHEMA)
    spanned = measured_span(df, ["k"], list(EVENT_ORDER), rows=7).collect()
    assert sorted((r["k"] or "", r["event_micros"], r["sequence"]) for r in spanned) == sorted((r[0] or "", r[1], r[2]) for r in crowded(1))
    sizes: dict = {}
    for r in spanned:
        sizes.setdefault((r["k"], tuple(r["_span"])), []).append((r["event_micros"], r["sequence"]))
    assert max(map(len, sizes.values())) <= 7 and len(sizes) < len(spanned) / 1.2
    # Spans of a key follow each other in the order of their rows.
    for key in ("hot", None, "a"):
        ends = [(min(v), max(v)) for (k, _), v in sorted(sizes.items(), key=lambda s: s[0][1]) if k == key]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    whole = measured_span(df, ["k"], list(EVENT_ORDER), rows=1000)
    assert dict(whole.dtypes)["_span"] == "bigint"


def test_neighbours_of_a_crowded_hour(spark):
    data = crowded(2)
    df = spark.createDataFrame(data, SCHEMA)
    window = W.partitionBy("k").orderBy(*EVENT_ORDER)
    want = df.select("k", "sequence", F.lag("v").over(window).alias("previous"), F.lead("v").over(window).alias("next"))
    got = neighbours(df, ["k"], "v", rows=5).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how, strict, backwards", [("sum", True, False), ("max", False, True), ("sum", False, False)])
def test_running_of_a_crowded_hour(spark, how, strict, backwards):
    df = spark.createDataFrame(crowded(3), SCHEMA)
    plain = running(df, ["k"], "event_micros", {"v": "total"}, how, strict, backwards)
    cut = running(df, ["k"], "event_micros", {"v": "total"}, how, strict, backwards, rows=5)
    assert sorted(map(str, cut.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_neighbours(spark, seed):
    data = skewed(seed)
    got = {r["sequence"]: (r["previous"], r["next"]) for r in neighbours(spark.createDataFrame(data, SCHEMA), ["k"], "v").collect()}
    want = {}
    for key in {r[0] for r in data}:
        line = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, row in enumerate(line):
            want[row[2]] = (line[i - 1][3] if i else None, line[i + 1][3] if i + 1 < len(line) else None)
    assert got == want


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("backwards", [True, False])
def test_running(spark, how, strict, backwards):
    data = skewed(7)
    df = spark.createDataFrame(data, SCHEMA)
    got = {
        r["sequence"]: r["total"]
        for r in running(df, ["k"], "event_micros", {"v": "total"}, how, strict, backwards).collect()
    }
    combine = {"sum": sum, "max": max}[how]

    def counts(other, row):
        if other[0] != row[0] or other[3] is None:
            return False
        if other[1] == row[1]:
            return not strict
        return (other[1] > row[1]) == backwards

    want = {}
    for row in data:
        values = [other[3] for other in data if counts(other, row)]
        want[row[2]] = combine(values) if values else None
    assert got == want


def random_session(seed: int, users: int, n: int) -> list[dict]:
    pick = random.Random(seed)
    start = 1_704_067_200_000_000
    out = []
    for i in range(n):
        user = pick.choice(["hot"] * users + [f"u{j}" for j in range(users)])
        time = start + pick.randrange(6 * 24 * 12) * 300_000_000 + pick.choice([0, 0, 1, 17_000_000])
        if pick.random() < 0.3:
            amount = pick.choice([10.0, 12.5, 99.99])
            out.append(event(user, time, "purchase", pick.choice([1, 2]), {"value": amount}, event_value_in_usd=amount))
        else:
            page = pick.choice(["https://x.y/a?q=1", "https://x.y/a", "https://x.y/b", None])
            out.append(view(user, time, page, pick.choice([1, 2]), params={"utm_source": pick.choice(["s", "t", None])}))
    return out


@pytest.mark.parametrize("only_before", [False, True])
@pytest.mark.parametrize("half_life, fold, span_rows", [
    (24, 32, 10**6), (24, 0, 10**6), (24, 10, 9), (24, 1000, 10**6), (0.5, 0, 10**6), (0.5, 0, 9), (0.5, 1000, 9), (168, 0, 40),
])
def test_time_decay_equals_all_pairs(spark, half_life, fold, span_rows, only_before):
    data = random_session(1, 3, 220)
    span = ("2018-01-01", "2024-12-31") if half_life < 24 else DAY
    report = attribution_time_decay(events(spark, data), *span, half_life, only_before, fold, span_rows)
    got = {r["utm_source"]: r["total_attributed_value"] for r in report.collect()}

    def param(row, key, slot):
        return next((p["value"][slot] for p in row["event_params"] if p["key"] == key), None)

    want: dict = {}
    for touch in (r for r in data if r["event_name"] == "page_view"):
        for buy in (r for r in data if r["event_name"] == "purchase" and r["user_pseudo_id"] == touch["user_pseudo_id"]):
            if only_before and buy["event_timestamp"] < touch["event_timestamp"]:
                continue
            hours = int((buy["event_timestamp"] - touch["event_timestamp"]) / HOUR)
            source = param(touch, "utm_source", "string_value")
            want[source] = want.get(source, 0) + param(buy, "value", "double_value") * 0.5 ** (hours / half_life)
    assert got.keys() == want.keys()
    for source, value in want.items():
        assert got[source] == pytest.approx(value, rel=1e-9)


@pytest.mark.parametrize("purchases", [0, 31, 32, 33, 1000])
@pytest.mark.parametrize("half_life", [4, 24])
def test_time_decay_of_any_number_of_purchases(spark, purchases, half_life):
    """One user with 20 views around equal purchases, over seven years."""
    start = 1_733_000_000_000_000
    buys = [start + i * 137_000_000 for i in range(purchases)]
    views = [start - 2 * HOUR + i * HOUR // 2 for i in range(20)]
    data = [event("u", t, "purchase", 1, {"value": 1.5}) for t in buys] + [view("u", t, "https://x.y/a") for t in views]
    got = attribution_time_decay(events(spark, data), "2018-01-01", "2024-12-31", half_life).collect()
    want = sum(1.5 * 0.5 ** (int((b - v) / HOUR) / half_life) for b in buys for v in views)
    assert [r["total_attributed_value"] for r in got] == ([pytest.approx(want, rel=1e-9)] if purchases else [])


@pytest.mark.parametrize("fold", [0, 32])
def test_time_decay_lists_no_interaction_without_purchase(spark, fold):
    """Of interactions before only, those after the last purchase give no row, also within its hour."""
    start = 1_733_000_400_000_000
    data = [event("u", start + HOUR + 5, "purchase", 1, {"value": 8.0})] + [
        view("u", start + t, "https://x.y/a", params={"utm_source": name})
        for t, name in [(HOUR + 6, "after"), (HOUR + 5, "at"), (HOUR + 4, "hour"), (6, "day"), (4, "day"), (9 * HOUR, "late")]
    ]
    got = attribution_time_decay(events(spark, data), "2018-01-01", "2024-12-31", 1, True, fold).collect()
    assert {r["utm_source"]: r["total_attributed_value"] for r in got} == {"at": 8.0, "hour": 8.0, "day": 12.0}
    both = attribution_time_decay(events(spark, data), "2018-01-01", "2024-12-31", 1, False, fold).collect()
    assert {r["utm_source"]: r["total_attributed_value"] for r in both} == {
        "after": 8.0, "at": 8.0, "hour": 8.0, "day": 12.0, "late": 8.0 * 2**7}


def test_page_revenue_equals_all_pairs(spark):
    data = random_session(2, 2, 260)
    got = {r["page_location"]: (r["views"], r["purchase_influence"], r["page_revenue"]) for r in page_revenue_attribution(events(spark, data), *DAY).collect()}

    def page(row):
        text = next((p["value"]["string_value"] for p in row["event_params"] if p["key"] == "page_location"), None)
        return text and text.split("?")[0]

    def session(row):
        return row["user_pseudo_id"], next(p["value"]["int_value"] for p in row["event_params"] if p["key"] == "ga_session_id")

    buys: dict = {}
    for row in (r for r in data if r["event_name"] == "purchase"):
        place = (session(row), row["event_timestamp"])
        buys[place] = buys.get(place, 0) + row["event_value_in_usd"]
    views = [(session(r), r["event_timestamp"], page(r)) for r in data if r["event_name"] == "page_view" and page(r)]
    want = {}
    for name in {v[2] for v in views}:
        revenue, touched = 0.0, 0
        for (who, when), amount in buys.items():
            before = [v for v in views if v[0] == who and v[1] < when]
            own = sum(v[2] == name for v in before)
            revenue += own * float(f"{amount / len(before) + 1e-9:.2f}") if own else 0
            touched += own > 0
        want[name] = (sum(v[2] == name for v in views), touched, pytest.approx(revenue, abs=0.005))
    assert got == want
