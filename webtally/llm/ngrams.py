"""Katz backoff models of any order as stored tables, for scoring any documents.

    P_k(w | h) = d_k(c(h,w)) c(h,w) / (c(h) + 1)    if the n-gram (h, w) occurs in training; h has k - 1 words
               = alpha_k(h) P_{k-1}(w | h')         otherwise; h' is h without its first word, alpha is 1 where h doesn't occur
    P_1        = as in ``katz``

For each order there is a Parquet table of its n-grams (h, s: hashes of history and h', w, n: count, p) and from the second
on one of backoff weights (h, alpha). An order's p is needed for the weights of the next one, so tables are made in rising
order; scoring goes the other way, with what is unseen handed on to the order below. Histories and words are 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtally.llm.common import steps, stored
from webtally.llm.katz import _MIX, END, LOW, START, Unigrams, _Hashes, discounts
from webtally.sources.writers import new_folder


class Model(NamedTuple):
    """Order, probability of a word that training doesn't have, and the folder of the tables."""

    order: int
    unknown: float
    folder: str


def _histories(words: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the last 0, 1, ... ``order`` - 1 words before each word of a text, START before its first."""
    before = np.concatenate([np.full(order, START, np.uint64), words])
    out = []
    for k in range(order):
        h = np.full(len(words), k, np.uint64)
        for j in range(k, 0, -1):
            h = (h ^ before[order - j : order - j + len(words)]) * _MIX
            h ^= h >> np.uint64(29)
        out.append(h)
    return out


def grams(documents: DataFrame, order: int) -> DataFrame:
    """row (a number), doc_id, h0 to h(order - 1), w and times: the distinct n-grams of each document. A null or empty text
    has the end as its one word."""
    names = [*[f"h{k}" for k in range(1, order)], "w"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part, texts in steps(batches, "text", 1 << 20):
            rows, columns, times = [], [], []
            for at, text in enumerate(texts):
                found = text.encode("utf-8", "replace").lower().split()
                words = np.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), np.uint64(END))
                each, n = np.unique(np.stack([*_histories(words, order)[1:], words]), axis=1, return_counts=True)
                rows.append(np.full(len(n), at)), columns.append(each), times.append(n)
            take = pa.array(np.concatenate(rows))
            whole = np.concatenate(columns, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(take), part.column("doc_id").take(take), *map(pa.array, whole), pa.array(np.concatenate(times))],
                names=["row", "doc_id", *names, "times"])

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    made = numbered.mapInArrow(run, "row long, doc_id long, " + ", ".join(f"{n} long" for n in names) + ", times long")
    return made.withColumn("h0", F.lit(0).cast("long"))


def fit(documents: DataFrame, order: int = 3, folder: str | None = None) -> Model:
    """Learns from all rows of ``documents`` (doc_id, text, ...) and writes the tables to ``folder``. An empty table gives
    a model without n-grams, by which every probability is 1."""
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "ngrams")
    found = stored(grams(documents, order), "grams")
    unknown = 1.0
    for k in range(1, order + 1):
        suffix = F.col(f"h{k - 2}") if k > 1 else F.lit(0).cast("long")
        counts = found.groupBy(F.col(f"h{k - 1}").alias("h"), suffix.alias("s"), "w").agg(F.sum("times").alias("n"))
        counts = stored(counts, "counts")  # so that adaptive execution can split a common history in the joins
        low = counts.agg(*[F.count(F.when(F.col("n") == r, 1)) for r in range(1, LOW + 2)]).first()
        d = discounts(list(low))
        weight = F.element_at(F.lit([*d.tolist(), 1.0]), F.least("n", F.lit(LOW + 1)).cast("int"))
        if k == 1:
            tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
            unknown = Unigrams(tokens, words, list(low)).unknown
            counts.withColumn("p", weight * F.col("n") / F.lit(float(tokens + 1))).write.parquet(f"{folder}/ngrams_1")
            continue
        times = counts.groupBy("h").agg(F.sum("n").alias("c"))
        counts.join(times, "h").select("h", "s", "w", "n", (weight * F.col("n") / (F.col("c") + 1)).alias("p")).write.parquet(f"{folder}/ngrams_{k}")
        own, below = spark.read.parquet(f"{folder}/ngrams_{k}"), spark.read.parquet(f"{folder}/ngrams_{k - 1}")
        lower = below.select(F.col("h").alias("s"), "w", F.col("p").alias("q"))
        own.join(lower, ["s", "w"]).groupBy("h").agg(((1 - F.sum("p")) / (1 - F.sum("q"))).alias("alpha")).write.parquet(f"{folder}/backoff_{k}")
    return Model(order, unknown, folder)


def score(spark: SparkSession, model: Model, documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens and score (log10) of every row of ``documents`` (doc_id, text, ...), learnt from or not. Repeated
    rows are scored each; an empty table stays empty."""
    found = stored(grams(documents, model.order), "grams")
    sums = []
    left = found.withColumn("sum", F.lit(0.0))
    for k in range(model.order, 0, -1):
        table_ = spark.read.parquet(f"{model.folder}/ngrams_{k}").select(F.col("h").alias(f"h{k - 1}"), "w", "p")
        met = stored(left.join(table_, [f"h{k - 1}", "w"], "left"), "met")
        total = F.col("times") * (F.col("sum") + F.log10("p"))
        sums.append(met.where("p IS NOT NULL").select("row", "doc_id", "times", total.alias("sum")))
        left = met.where("p IS NULL").drop("p")
        if k > 1:
            weights = spark.read.parquet(f"{model.folder}/backoff_{k}").withColumnRenamed("h", f"h{k - 1}")
            left = left.join(weights, f"h{k - 1}", "left").withColumn("sum", F.col("sum") + F.log10(F.coalesce("alpha", F.lit(1.0)))).drop(
                "alpha", f"h{k - 1}")
    sums.append(left.select("row", "doc_id", "times", (F.col("times") * (F.col("sum") + float(np.log10(model.unknown)))).alias("sum")))
    whole = sums[0]
    for more in sums[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("row", "doc_id").agg(F.sum("times").alias("n_tokens"), F.sum("sum").alias("score")).drop("row")
