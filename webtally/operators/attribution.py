"""Which source, campaign or page gets the credit for a purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from webtally.functions import fixed
from webtally.functions.channels import channel_grouping, source_medium, traffic_category as category_of
from webtally.functions.dates import HOUR_MICROS, floor_div, local_second
from webtally.functions.numbers import money, ratio, share_of_total
from webtally.functions.params import flatten, in_days, named
from webtally.functions.urls import without_query
from webtally.operators.skew import SPAN_ROWS, event_order, measured_span, running
from webtally.sources.writers import stored

# Levels of the groups of time decay that are no binary digit.
SAME_HOUR, OUTSIDE = -2, -1

UTM = ["utm_source", "utm_medium", "utm_campaign"]


def attribution_first_click(events: DataFrame, start, end) -> DataFrame:
    """All purchase value of a user goes to the UTM values of the user's first session start."""
    hits = flatten(events.filter(in_days(start, end))).filter(
        named("session_start", "purchase") & F.col("user_pseudo_id").isNotNull()
    )
    bought = named("purchase") & (F.col("summed_value") > 0)
    users = hits.groupBy("user_pseudo_id").agg(
        F.min_by(F.struct(*UTM), F.when(named("session_start"), event_order())).alias("first"),
        F.sum(F.when(bought, money(F.col("summed_value")))).alias("amount"),
    ).filter(F.col("first").isNotNull() & F.col("amount").isNotNull())
    names = [f"first_{c}" for c in UTM]
    return (
        users.groupBy(*[F.col(f"first.{c}").alias(f"first_{c}") for c in UTM])
        .agg(F.sum("amount").cast("double").alias("total_purchase_value"))
        .orderBy(F.desc("total_purchase_value"), *names)
    )


def attribution_last_click(events: DataFrame, start, end) -> DataFrame:
    """Purchase sessions and revenue by the source and campaign written on the purchase event."""
    keys = ["event_source", "campaign"]
    sessions = (
        flatten(events.filter(in_days(start, end))).filter(named("purchase"))
        .groupBy(*keys, "user_pseudo_id", "session_id")
        .agg(F.sum(money(F.col("purchase_revenue"))).alias("revenue"))
    )
    totals = sessions.groupBy(F.col("event_source").alias("traffic_source"), "campaign").agg(
        F.count("session_id").alias("total_conversions"), F.sum("revenue").cast("double").alias("total_revenue")
    )
    average = F.round(ratio(F.col("total_revenue"), F.col("total_conversions")), 2)
    return totals.withColumn("average_revenue_per_conversion", average).orderBy(
        F.desc("total_revenue"), "traffic_source", "campaign"
    )


def attribution_linear(events: DataFrame, start, end) -> DataFrame:
    """Events of a source divided by the number of sources of the user, and revenue, per source.

    Events shrink to one row per user and source before the user's sources are counted."""
    pairs = (
        flatten(events.filter(in_days(start, end))).filter(F.col("user_pseudo_id").isNotNull())
        .groupBy("user_pseudo_id", F.col("first_source").alias("traffic_source"))
        .agg(F.count("first_source").alias("touches"), F.sum(money(F.col("purchase_revenue"))).alias("revenue"))
    )
    sources = F.count("traffic_source").over(W.partitionBy("user_pseudo_id"))
    scored = pairs.withColumn("score", ratio(F.col("touches"), sources).cast("decimal(28,12)"))
    return (
        scored.groupBy("traffic_source").agg(
            F.sum("score").cast("double").alias("total_attribution_score"),
            F.sum("revenue").cast("double").alias("total_revenue"),
        ).orderBy(F.desc("total_attribution_score"), "traffic_source")
    )


def attribution_time_decay(
    events: DataFrame, start, end, half_life_hours: float = 24, only_before: bool = False, fold: int = 32,
    span_rows: int = SPAN_ROWS,
) -> DataFrame:
    """Purchase value times 0.5 ^ (whole hours from interaction to purchase / half life), summed over every
    interaction and every purchase of a user, per UTM values. An interaction after the purchase counts too,
    with a weight above one, unless ``only_before`` is set; one at the same time counts in both cases.

    No row is made for a pair. Purchases are stored and counted per buyer. A buyer with at most ``fold`` of them carries
    them as one short array, which each of the user's interactions folds into its credit; for the others, if there are
    any, ``_frequent_buyers`` gives the same from sums (``fold`` and ``span_rows`` choose the plan, never the result).
    So events are read twice, or three times where there are such buyers."""
    known = flatten(events.filter(in_days(start, end))).filter(F.col("user_pseudo_id").isNotNull()).select(
        F.col("user_pseudo_id").alias("user"), F.struct(*UTM).alias("utm"), "event_name",
        floor_div(F.col("event_micros"), HOUR_MICROS).alias("hour"),
        F.pmod("event_micros", F.lit(HOUR_MICROS).cast("bigint")).alias("place"),
        F.when(named("purchase"), F.col("summed_value").cast("double")).alias("amount"),
    )
    touches = known.filter(named(*fixed.TOUCH_EVENTS)).select("user", "utm", "hour", "place")
    purchases = stored(known.filter(F.col("amount") > 0).select("user", "hour", "place", "amount"), "purchases")
    buyers = purchases.groupBy("user").agg(
        F.count("*").alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour")
    )
    frequent = buyers.filter(F.col("n") > fold).drop("n")
    some = not frequent.isEmpty()
    few = purchases.join(frequent, "user", "left_anti") if some else purchases
    lists = few.groupBy("user").agg(F.collect_list(F.struct("hour", "place", "amount")).alias("purchases"))
    later = "p.hour > hour OR p.hour = hour AND p.place >= place"
    # Whole hours between, cut towards zero.
    hours = f"p.hour - hour + CASE WHEN {later} THEN IF(p.place < place, -1, 0) ELSE IF(p.place > place, 1, 0) END"
    credit = F.expr(
        f"aggregate({f'filter(purchases, p -> {later})' if only_before else 'purchases'}, CAST(NULL AS DOUBLE), (total, p) -> "
        f"coalesce(total, 0D) + p.amount * power(0.5D, ({hours}) / {float(half_life_hours)}D))"
    )
    parts = touches.join(lists, "user").select("utm", credit.alias("part")).filter("part IS NOT NULL")
    if some:
        rows = touches.withColumn("amount", F.lit(None).cast("double")).unionByName(
            purchases.withColumn("utm", F.lit(None).cast(touches.schema["utm"].dataType))
        )
        theirs = stored(rows.join(frequent, "user"), "frequent")
        parts = parts.unionByName(_frequent_buyers(theirs, half_life_hours, only_before, span_rows))
    return (
        parts.groupBy(*[F.col(f"utm.{c}").alias(c) for c in UTM])
        .agg(F.sum("part").alias("total_attributed_value"))
        .orderBy(F.desc("total_attributed_value"), *UTM)
    )


def _frequent_buyers(theirs: DataFrame, half_life_hours: float, only_before: bool, span_rows: int) -> DataFrame:
    """Time-decay credit (``utm``, ``part``) of users with many purchases; rows with an ``amount`` are purchases.

    ``_meetings`` says in which groups a row takes part, so that each pair meets in one group, whose purchases all lie on
    one side of its ``edge``. With purchase and interaction at hours a, b and places p, q in the hour, the hours between
    them are

    - a - b, less one if p < q, where the purchase is in a later hour;
    - a - b + 1, less one if p <= q, where it is in an earlier one;
    - none in the same hour, where the pair counts if p >= q or not ``only_before``.

    So the credit of a group is a product of two sums, and for the condition on p and q a decayed running total. Purchases
    are weighed from the edge on and interactions up to it: no weight exceeds one where purchases are later, nor the weight
    of a true pair elsewhere, and sums are never subtracted, so the result is finite where the true terms are."""
    def decay(hours: Column) -> Column:
        return F.pow(F.lit(0.5), hours / half_life_hours)

    group = ["user", "level", "edge", "later"]
    met = theirs.withColumn("meeting", F.explode(_meetings())).select("user", "utm", "amount", "hour", "place", "meeting.*")
    if only_before:
        met = met.filter("later")
    same = F.col("level") == SAME_HOUR
    weighted = met.select(
        *group, "utm", "hour",
        (F.col("amount") * decay(F.col("hour") - F.col("edge") + F.when(F.col("later"), 0).otherwise(1))).alias("bought"),
        F.when(F.col("amount").isNull(), decay(F.col("edge") - F.col("hour"))).alias("touched"),
        # Purchases that the condition is true of have a smaller position than the interaction.
        (F.when(same, -F.col("place")).otherwise(F.col("place"))
         - F.when(F.col("amount").isNotNull() & (same | ~F.col("later")), 1).otherwise(0)).alias("position"),
    )
    spread = measured_span(weighted, group, ["position"], rows=span_rows).repartition(*group, "_span")
    products = spread.filter(~same) if only_before else spread
    sums = products.groupBy(*group, "utm").agg(F.sum("bought").alias("bought"), F.sum("touched").alias("touched"))
    total = F.max("bought").over(W.partitionBy(*group))  # of the one row of purchases
    product = sums.withColumn("bought", total).filter("utm IS NOT NULL AND bought IS NOT NULL").select(
        "utm", (F.col("bought") * F.col("touched")).alias("part")
    )
    ordered = spread if only_before else spread.filter(~same)
    rest = running(ordered, group, "position", {"bought": "smaller"}, span="_span").filter(
        "utm IS NOT NULL AND smaller IS NOT NULL"
    )
    hour_more = decay(F.col("edge") - F.col("hour") - 1) - F.col("touched")
    return product.unionByName(
        rest.select("utm", (F.col("smaller") * F.when(same, F.col("touched")).otherwise(hour_more)).alias("part"))
    )


def _meetings() -> Column:
    """Groups (``level``, ``edge``, ``later``) in which a row of a buyer takes part: ``later`` ones have purchases from the
    hour ``edge`` on and interactions before it, the others the reverse; at level ``SAME_HOUR`` both are in that hour.

    Interactions before the buyer's first purchase hour or after the last one meet all purchases in one group, those
    between them by the first binary digit in which two hours, counted from the first, differ: the digits above it and
    its place give the group. So an interaction takes part once where it is outside, and inside once for each digit that
    the buyer's own span has (none for a single purchase, 14 for a year of them); purchases are in two groups more."""
    bought, hour = F.col("amount").isNotNull(), F.col("hour")
    first, last = F.col("first_hour"), F.col("last_hour")

    def meeting(level: Column, edge: Column, later: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), edge.alias("edge"), later.alias("later"))

    def at(level: Column) -> Column:
        half = F.pow(F.lit(2.0), level).cast("bigint")
        above = F.pmod(hour - first, half * 2)
        return meeting(level, hour - above + half, bought == (above >= half))

    before = meeting(F.lit(OUTSIDE), first, F.lit(True))
    after = meeting(F.lit(OUTSIDE), last + 1, F.lit(False))
    digits = F.when(last > first, F.length(F.bin(last - first))).otherwise(0)
    inside = F.concat(
        F.array(meeting(F.lit(SAME_HOUR), hour, F.lit(True))),
        F.transform(F.filter(F.sequence(F.lit(0), digits), lambda level: level < digits), at),
    )
    return (
        F.when(bought, F.concat(inside, F.array(before, after)))
        .when(hour < first, F.array(before)).when(hour > last, F.array(after)).otherwise(inside)
    )


def page_revenue_attribution(events: DataFrame, start, end) -> DataFrame:
    """Purchase revenue split evenly over the pages viewed before it in the session.

    Each purchase counts the views before it and each view adds up the shares of the purchases after it:
    two running totals per session instead of a row for every view and purchase."""
    hits = flatten(events.filter(in_days(start, end))).filter(named("page_view", "purchase")).select(
        "session_key", "event_micros",
        F.when(named("page_view"), without_query(F.col("page_location"))).alias("page"),
        F.when(named("purchase"), money(F.col("event_value_in_usd"))).alias("amount"),
    )
    # One shuffle, by session and span, serves everything up to the totals per session and page.
    kept = hits.filter(F.col("session_key").isNotNull() & (F.col("page").isNotNull() | F.col("amount").isNotNull()))
    spread = measured_span(kept, ["session_key"], ["event_micros"]).repartition("session_key", "_span")
    moments = spread.groupBy("session_key", "_span", "event_micros", "page").agg(
        F.count("page").alias("views"), F.sum("amount").alias("amount")
    )
    counted = running(moments, ["session_key"], "event_micros", {"views": "views_before"}, span="_span")
    shared = F.col("amount").isNotNull() & (F.col("views_before") > 0)
    share = F.round(ratio(F.col("amount"), F.col("views_before")), 2).cast("decimal(24,2)")
    shares = counted.select(
        "session_key", "_span", "event_micros", "page", "views",
        F.when(shared, share).alias("share"), F.when(shared, F.lit(1)).alias("purchase"),
    )
    credited = running(
        shares, ["session_key"], "event_micros", {"share": "shares_after", "purchase": "purchases_after"},
        backwards=True, span="_span",
    ).filter(F.col("page").isNotNull() & F.col("shares_after").isNotNull())
    views = hits.filter(F.col("page").isNotNull())
    per_session = credited.groupBy("session_key", "page").agg(
        F.max("purchases_after").alias("purchases"),
        F.sum(F.col("shares_after") * F.col("views")).alias("revenue"),
    )
    revenue = per_session.groupBy("page").agg(
        F.sum("purchases").alias("purchase_influence"), F.sum("revenue").cast("double").alias("revenue")
    )
    seen = views.groupBy("page").agg(F.count("*").alias("views"))
    return seen.join(revenue, "page").select(
        F.col("page").alias("page_location"), "views", "purchase_influence",
        F.round("revenue", 2).alias("page_revenue"),
        F.round(ratio(F.col("revenue"), F.col("views")), 3).alias("page_value"),
    ).orderBy(F.desc("views"), "page_location")


def source_product_revenue(events: DataFrame, start, end, zone: str = "America/New_York") -> DataFrame:
    """Quantity and revenue of products by the buyer's last known source, with the share of the product's total.

    A session takes source and user of its first event, by wall-clock second in ``zone``; a session without a
    source takes the user's last one. Products come from purchases whose transaction id contains ``live``, on
    any date."""
    second = local_second(F.col("event_micros"), zone)
    source = source_medium(F.col("manual_source"), F.col("manual_medium"), F.col("gclid"))
    starts = (
        flatten(events.filter(in_days(start, end)))
        .select("session_key", "user_pseudo_id", "event_micros", "sequence", second.alias("second"), source.alias("source"))
        .groupBy("session_key")
        .agg(F.min_by(F.struct("user_pseudo_id", "source"), F.struct("second", "event_micros", "sequence")).alias("first"),
             F.min("second").alias("started"))
        .select("session_key", "first.user_pseudo_id", "started",
                F.when(F.col("first.source").isNotNull(), F.struct("started", "first.source")).alias("known"))
    )
    carried = running(starts, ["user_pseudo_id"], "started", {"known": "last_known"}, how="max", size=3600, strict=False)
    product = ["item_category", "item_name"]
    items = (
        flatten(events).filter(named("purchase") & F.col("transaction_id").contains("live"))
        .selectExpr(
            "session_key",
            "inline(arrays_zip(items.item_category, items.item_name, items.item_revenue, items.quantity)) "
            "AS (item_category, item_name, revenue, quantity)",
        )
        .select("session_key", *product, money(F.col("revenue")).alias("price"), "quantity")
    )
    sold = items.filter(F.col("session_key").isNotNull()).groupBy("session_key", *product).agg(
        F.sum("price").alias("price"), F.sum("quantity").alias("quantity")
    )
    totals = items.groupBy(*product).agg(
        F.sum("quantity").alias("total_products_purchased"),
        F.round(F.sum("price").cast("double"), 2).alias("total_category_revenue"),
    )
    by_source = (
        carried.select("session_key", F.coalesce("last_known.source", F.lit("direct")).alias("traffic_source"))
        .join(sold, "session_key", "left")
        .groupBy("traffic_source", *product)
        .agg(F.sum("quantity").alias("total_quantity_purchased"), F.sum("price").cast("double").alias("price"))
    )
    return by_source.join(totals, product, "left").select(
        "traffic_source", *product, "total_products_purchased", "total_category_revenue", "total_quantity_purchased",
        F.round(ratio(F.col("total_quantity_purchased"), F.col("total_products_purchased")), 2)
        .alias("purchase_percentage_of_total"),
        F.round("price", 2).alias("total_revenue"),
        F.round(ratio(F.col("price"), F.col("total_category_revenue")), 2).alias("revenue_percentage_of_total"),
    ).orderBy(F.desc("total_category_revenue"), "traffic_source", *product)


def marketing_channels(events: DataFrame, start, end) -> DataFrame:
    """Sessions and their share per marketing channel."""
    channel = channel_grouping(*[F.col(c) for c in ("manual_source", "manual_medium", "manual_campaign", "gclid")])
    counted = flatten(events.filter(in_days(start, end))).groupBy(channel.alias("channel_grouping")).agg(
        F.countDistinct("session_key").alias("session_count")
    )
    percentage = F.round(share_of_total(F.col("session_count"), 100), 2)
    return counted.withColumn("session_percentage", percentage).orderBy(F.desc("session_count"), "channel_grouping")


def traffic_category(events: DataFrame) -> DataFrame:
    """One row per event: user, source and the source's category."""
    source = F.col("first_source")
    return flatten(events).select(
        "user_pseudo_id", source.alias("source"), category_of(source).alias("traffic_category")
    )


def engagement_status(events: DataFrame) -> DataFrame:
    """One row per event: user, session and whether the session is engaged."""
    status = (
        F.when(F.col("engaged_text") == "1", "Engaged").when(F.col("engaged_text") == "0", "Not Engaged")
        .otherwise("Unknown")
    )
    return flatten(events).select("user_pseudo_id", "session_id", status.alias("session_status"))
