"""Date-partitioned Parquet output."""

from __future__ import annotations

import atexit
import contextlib
import datetime
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtally.sources.readers import read_table
from webtally.sources.schemas import MONTHLY_FIELDS


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a local session, whose only executor is the driver, gets one temporary folder; on a
    cluster it is an error, as executors would write where nobody else can read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"webtally-{application}-")


_made: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """Path of a new folder for intermediate data in the shared folder; removed when the application's driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def _remove_made() -> None:
    jvm = SparkContext._jvm
    while jvm and _made:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            place = jvm.org.apache.hadoop.fs.Path(_made.pop())
            place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows reads it instead of computing it again."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_date(
    df: DataFrame, path: str, date_column: str = "event_date", widen: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Overwrite ``path`` with one Parquet folder per date.

    The rebalance hint lets adaptive execution write whole files per date and split a date that is too big for
    one task; the commit protocol publishes files only when the job has finished.

    ``widen`` makes the rows to write from those of ``df``, row by row and keeping the date. It is applied after rows have
    been shuffled and sorted by date, so that neither moves or holds more than the columns of ``df``. A missing date is
    empty text until then, which Spark writes like null: it would sort wide rows again by a text that may be null."""
    if widen:
        dated = df.withColumn(date_column, F.coalesce(F.col(date_column).cast("string"), F.lit("")))
        rows = widen(dated.hint("rebalance", F.col(date_column)).sortWithinPartitions(date_column))
    else:
        rows = df.hint("rebalance", F.col(date_column))
    rows.write.mode("overwrite").partitionBy(date_column).parquet(path)


def month_names(as_of, months: int = 12) -> list[tuple[str, datetime.date, datetime.date]]:
    """``(yyyymm, first day, first day of next month)`` of the month of ``as_of`` and those before it."""
    day = datetime.date.fromisoformat(str(as_of))
    count = day.year * 12 + day.month - 1
    first = [datetime.date(n // 12, n % 12 + 1, 1) for n in range(count + 1, count - months, -1)]
    return [(f"{month:%Y%m}", month, after) for after, month in zip(first, first[1:])]


def _files(spark: SparkSession, path: str):
    """Hadoop's path class and the file system of ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _aside(path: str) -> str:
    """Where a table's old folder is while a new one takes its place."""
    base, name = path.rstrip("/").rsplit("/", 1)
    return f"{base}/_old-{name}"


def _move(files, place, old: str, new: str) -> None:
    if not files.rename(place(old), place(new)):
        raise OSError(f"{old} can't be moved to {new}")


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``: the old one is moved aside, the new one moved in, and only then the
    old one deleted. After a failure at any step ``table_folder`` finds a whole table, and the next call goes on from it."""
    place, files = _files(spark, path)
    aside = _aside(path)
    if files.exists(place(path)):
        files.delete(place(aside), True)  # left by a call that failed after its table was in place
        _move(files, place, path, aside)
    _move(files, place, new, path)
    files.delete(place(aside), True)


def table_folder(spark: SparkSession, path: str) -> str:
    """``path``, or the folder that was moved aside if none has taken its place."""
    place, files = _files(spark, path)
    aside = _aside(path)
    return aside if not files.exists(place(path)) and files.exists(place(aside)) else path


def write_monthly_tables(df: DataFrame, base: str, as_of, months: int = 12, prefix: str = "web_analytics_") -> list[str]:
    """Create or replace one table per month, ``base/prefix_yyyymm``, partitioned by ``event_date``.

    One job writes all months to a staging folder; when it has finished, each month's folder takes the place of
    the old table. So the old tables stay until all new ones are complete, only folders are renamed, and a failure
    between the renames loses no table (``replace_folder``). A month without rows still gets its (empty) table. Returns the
    paths."""
    spark, base = df.sparkSession, base.rstrip("/")
    names = month_names(as_of, months)
    columns = df.select(*[F.col(name).cast(kind).alias(name) for name, kind in MONTHLY_FIELDS.items()])
    day = F.col("event_date")
    asked = columns.filter((day >= F.lit(names[-1][1])) & (day < F.lit(names[0][2])))
    staging = f"{base}/_staging-{uuid.uuid4().hex}"
    asked.withColumn("_month", F.date_format(day, "yyyyMM")).hint("rebalance", day).write.partitionBy(
        "_month", "event_date").parquet(staging)
    place, files = _files(spark, base)
    paths = []
    for name, _, _ in names:
        path, new = f"{base}/{prefix}{name}", f"{staging}/_month={name}"
        files.mkdirs(place(new))
        replace_folder(spark, new, path)
        paths.append(path)
    files.delete(place(staging), True)
    return paths


def read_monthly_table(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, table_folder(spark, path), MONTHLY_FIELDS)
