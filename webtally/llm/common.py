"""Helpers shared by the operators: input tables, stored intermediate tables, batching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from webtally.sources.writers import new_folder

#: Text that one step of a Python worker handles at a time, in characters; bounds what the step holds besides its input.
STEP_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, kind: str, rows_a_file: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows survives lost executors and reads the same rows
    every time, also those that a recomputation would number or sample differently. ``rows_a_file``, if not 0, keeps files
    of large rows small: a reader holds up to 4096 rows of a file at a time, whatever their size."""
    path = new_folder(df.sparkSession, kind)
    write = df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write
    write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batches: Iterable[pa.RecordBatch], column: str, chars: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches in slices of about ``chars`` characters, each with its texts (null: empty)."""
    for batch in batches:
        texts = batch.column(column)
        start = size = 0
        part: list[str] = []
        for i, text in enumerate(texts):
            value = text.as_py() or ""
            part.append(value)
            size += len(value)
            if size >= chars or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), part
                start, size, part = i + 1, 0, []


def numbered(df: DataFrame, group: str, order: list[str], name: str, weight: str = "1") -> DataFrame:
    """``df`` with ``name``: what the rows before it among those with its ``group`` (null is one) weigh, by ``order``, so the
    row's place from 0 where all weigh 1; and ``name_n``, what all of them weigh.

    Rows are sorted into ranges by sampled bounds, so a group may hold any share of them. Equal rows keep apart by a random
    last key, drawn once, as the ranges are stored before they are counted. What one task sorts is a range; what a window
    over a group sees are the sums of its ranges."""
    names = df.columns
    ranges = stored(
        df.withColumn("_weight", F.expr(weight).cast("bigint")).withColumn("_salt", F.rand(1))
        .repartitionByRange(group, *order, "_salt").withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.groupBy(group, "_range").agg(F.sum("_weight").alias("_sum")).select(
        F.col(group).alias("_group"), F.col("_range").alias("_its"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(W.partitionBy(group)).alias(f"{name}_n"))
    own = W.partitionBy(group, "_range").orderBy(*order, "_salt").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranges.withColumn("_own", F.coalesce(F.sum("_weight").over(own), F.lit(0)))
    together = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_its"))
    return ranked.join(offsets, together).select(*names, (F.col("_before") + F.col("_own")).alias(name), f"{name}_n")
