"""Ordered windows that stay spread out when one key holds a large part of all rows. (Joins are left to adaptive
execution, which splits a skewed side by its measured size.)

A Spark window puts a whole partition key into one task, so a session or user with a third of the events
(a bot, or the missing user id) would stop the job. Here a key is first cut into spans of its order column, whose
number follows the measured number of its rows.
The bulk of the work is a window over (key, span); what crosses a span border is a handful of rows per span,
and only those are brought together per key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from webtally.functions.dates import HOUR_MICROS, floor_div
from webtally.sources.writers import stored

EVENT_ORDER = ("event_micros", "sequence")


def event_order() -> Column:
    """Order of events: time, then export sequence number for equal times."""
    return F.struct(*EVENT_ORDER)


#: A span with more rows is cut into finer ones.
SPAN_ROWS = 1_000_000
#: Pieces that one cut makes of a span.
FAN = 64


def _digits(order: list[str], size: int) -> Iterator[Column]:
    """Places within a span, coarse to fine: of the first order column down to single values, then of the next one, whose
    range isn't known, from all longs on."""
    for k, column in enumerate(order):
        rest = F.col(column)
        if k:
            size = 1 << 58  # 64 cells hold all longs
            yield floor_div(rest, size)
        rest = F.pmod(rest, F.lit(size).cast("bigint"))
        while size > 1:
            size = -(-size // FAN)
            yield floor_div(rest, size)
            rest = F.pmod(rest, F.lit(size).cast("bigint"))


def measured_span(
    df: DataFrame, keys: list[str], order: list[str], size: int = HOUR_MICROS, rows: int = SPAN_ROWS, name: str = "_span",
) -> DataFrame:
    """``df`` with ``name``: the span of ``size`` of the first order column that a row is in, cut finer where a key has more
    than ``rows`` rows in one.

    Rows per key and span are counted first. Mostly that is all: no span is too large, and ``name`` is a whole number. Else
    those that are, at most one for every ``rows`` rows, are stored and cut into 64 pieces, these are counted, and so on
    down to single values of the first order column, then of the next one; ``name`` is then the array of places, which sorts
    like the order columns. So no span has more than ``rows`` rows, unless they are equal in all order columns."""
    together = [*keys, name]
    spanned = df.withColumn(name, floor_div(F.col(order[0]), size))
    large = spanned.groupBy(*together).count().filter(F.col("count") > rows).drop("count")
    if large.isEmpty():
        return spanned
    spanned = spanned.withColumn(name, F.array(name))
    large = stored(large.withColumn(name, F.array(name)), "spans")
    for digit in _digits(order, size):
        renamed = large.select(*[F.col(c).alias(f"_large_{c}") for c in together], F.lit(True).alias("_cut"))
        match = F.lit(True)
        for c in together:
            match = match & F.col(c).eqNullSafe(F.col(f"_large_{c}"))
        cut = F.when(F.col("_cut"), F.concat(name, F.array(digit))).otherwise(F.col(name))
        spanned = spanned.join(renamed, match, "left").select(*df.columns, cut.alias(name))
        large = stored(spanned.groupBy(*together).count().filter(F.col("count") > rows).drop("count"), "spans")
        if large.isEmpty():
            break
    return spanned


def neighbours(
    df: DataFrame, keys: list[str], value: str, span: str | None = None, rows: int = SPAN_ROWS,
) -> DataFrame:
    """Add ``previous`` and ``next``: the value of the event before and after within ``keys``.

    Rows inside a span get both from the window over (keys, span). The first and last row of each span are
    ordered again among themselves per key, where the row before a span's first row is the last row of the
    nearest earlier span. Both branches read one and the same exchange. Spans follow the measured number of rows
    (``measured_span``), unless ``span`` names a column that has them."""
    columns = [c for c in df.columns if c != span]
    spanned, span = (df, span) if span else (measured_span(df, keys, list(EVENT_ORDER), rows=rows), "_span")
    near = W.partitionBy(*keys, span).orderBy(*EVENT_ORDER)
    far = W.partitionBy(*keys).orderBy(*EVENT_ORDER)
    marked = spanned.select(
        *columns,
        F.lag(value).over(near).alias("_before"),
        F.lead(value).over(near).alias("_after"),
        F.lag(F.lit(True)).over(near).isNull().alias("_opens"),
        F.lead(F.lit(True)).over(near).isNull().alias("_closes"),
    )
    on_border = F.col("_opens") | F.col("_closes")
    inside = marked.filter(~on_border).select(*columns, F.col("_before").alias("previous"), F.col("_after").alias("next"))
    border = marked.filter(on_border).select(
        *columns,
        F.when(F.col("_opens"), F.lag(value).over(far)).otherwise(F.col("_before")).alias("previous"),
        F.when(F.col("_closes"), F.lead(value).over(far)).otherwise(F.col("_after")).alias("next"),
    )
    return inside.unionByName(border)


def running(
    df: DataFrame, keys: list[str], order: str, outputs: dict[str, str], how: str = "sum", strict: bool = True,
    backwards: bool = False, size: int = HOUR_MICROS, span: str | None = None, rows: int = SPAN_ROWS,
) -> DataFrame:
    """Add running totals within ``keys``: ``outputs`` maps a value column to the name of its total.

    The total of a row covers the rows with a smaller ``order`` (a whole number), or a greater one when
    ``backwards``; rows with an equal one count when not ``strict``. ``how`` is ``sum`` or ``max``. A span with
    something before it gets one carry row that brings in the total of all earlier spans of its key; most keys
    fit one span and get none. Spans follow the measured number of rows (``measured_span``) from ``size`` on, so that
    none has more than ``rows`` rows, unless their ``order`` is equal.

    Rows are shuffled once, by (keys, span); give ``span`` when ``df`` is already spread by that column. The
    span totals group by the other columns too, so that they read the same columns and share the shuffle."""
    combine = {"sum": F.sum, "max": F.max}[how]
    columns = df.columns
    real = df if span else measured_span(df, keys, [order], size, rows).repartition(*keys, "_span")
    span = span or "_span"
    edge, step, direction = (F.max, 1, F.desc) if backwards else (F.min, -1, F.asc)
    others = [c for c in columns if c not in {*keys, span, order, *outputs}]

    def add_up(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*keys, span, *by).agg(edge(order).alias(order), *[combine(v).alias(v) for v in outputs])

    totals = add_up(add_up(real, *others))
    earlier = W.partitionBy(*keys).orderBy(direction(span)).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, span, (F.col(order) + step).alias(order), *[combine(v).over(earlier).alias(v) for v in outputs]
    ).filter(" OR ".join(f"{v} IS NOT NULL" for v in outputs)).repartition(*keys, span)
    upto = W.partitionBy(*keys, span).orderBy(direction(order)).rangeBetween(W.unboundedPreceding, -1 if strict else 0)
    everything = real.withColumn("_real", F.lit(True)).unionByName(
        carried.withColumn("_real", F.lit(False)), allowMissingColumns=True
    )
    return everything.select(
        *columns, "_real", *[combine(v).over(upto).alias(name) for v, name in outputs.items()]
    ).filter("_real").drop("_real")
