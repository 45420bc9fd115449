"""Quality classifier on learned subword vectors.

A document is the mean of vectors looked up by hash for its words, its character n-grams and, of word pairs, whether
the second is the first again; a linear layer with softmax follows. Vectors and layer are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled
rows whose features Spark extracts. As everything before the softmax is linear, vectors times layer fold into one small
table of class logits per bucket, so scoring adds up table entries over the whole text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from webtally.llm.common import steps, table

BUCKETS = 1 << 16
#: Buckets of the word pair "the same word again" and of any other pair.
REPEATED, OTHERWISE = np.uint32(BUCKETS), np.uint32(BUCKETS + 1)
SIZE = BUCKETS + 2
#: Characters are UTF-8 bytes here.
NGRAMS = (3, 4, 5)
#: Rows of each class that training takes at most: those whose ids have the smallest hashes.
CLASS_ROWS = 1000
#: Logits are added up in units of one by this.
UNIT = 1 << 32
#: Characters whose features a worker holds at a time.
SLICE_CHARS = 1 << 20
DIMENSIONS, EPOCHS, RATE, SEED = 16, 10, 0.1, 7

_MIX = np.uint32(0x9E3779B1)
_WORD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint32(15))) * _MIX) >> np.uint32(16)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: the buckets of all texts in a row, and where those of each text begin and end."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    h = data.astype(np.uint32)
    single = h
    for n in range(2, max(NGRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + single[n - 1 :]
        if n in NGRAMS:
            yield _bucket(h + np.uint32(n)), np.minimum(starts, len(h)), np.minimum(np.maximum(ends - n + 1, starts), len(h))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begins):
        none = np.zeros(len(texts), np.int64)
        yield np.zeros(0, np.uint32), none, none
        return
    stops = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    lengths = stops - begins
    at = np.flatnonzero(~space)
    odd = np.uint64(2) * (at - np.repeat(begins, lengths)).astype(np.uint64) + np.uint64(1)
    value = data[at].astype(np.uint64) * (odd * _WORD)
    value ^= value >> np.uint64(31)
    words = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    words = ((words * _WORD) >> np.uint64(32)).astype(np.uint32)
    first, last = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    yield _bucket(words), first, last
    again = np.concatenate([[False], words[1:] == words[:-1]])
    again[first[first < last]] = False
    yield np.where(again, REPEATED, OTHERWISE), first, last


def sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of its features."""
    kinds = list(features(texts))
    out = []
    for i in range(len(texts)):
        own = np.concatenate([b[s[i] : e[i]] for b, s, e in kinds])
        ids, counts = np.unique(own, return_counts=True)
        out.append((ids.astype(np.int32), (counts / max(1, len(own))).astype(np.float32)))
    return out


@dataclass
class Model:
    """``logits``: what a bucket adds to the log odds of the higher class; ``bias``: the log odds without features."""

    logits: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Sums are of whole numbers, so a text's doesn't depend on the texts beside it."""
        whole = np.round(self.logits.astype(np.float64) * UNIT).astype(np.int64)
        total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for buckets, starts, ends in features(texts):
            sums = np.concatenate([[0], np.cumsum(whole[buckets])])
            total += sums[ends] - sums[starts]
            count += ends - starts
        return 1 / (1 + np.exp(-np.clip(total / UNIT / np.maximum(count, 1) + self.bias, -50, 50)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias from (buckets, shares, class 0 or 1). Steps are scaled per bucket by past gradients."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (SIZE, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    past = np.full(SIZE, 1e-8, np.float32)
    past_layer, past_bias = np.full(layer.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            ids, share, label = rows[i]
            mean = share @ vectors[ids]
            out = mean @ layer + bias
            error = np.exp(out - out.max())
            error /= error.sum()
            error[label] -= 1
            back = layer @ error
            grad = np.outer(mean, error)
            past_layer += grad * grad
            past_bias += error * error
            layer -= rate * grad / np.sqrt(past_layer)
            bias -= rate * error / np.sqrt(past_bias)
            past[ids] += share * share * (back @ back) / DIMENSIONS
            vectors[ids] -= rate * np.outer(share / np.sqrt(past[ids]), back)
    return vectors, layer, bias


def held_out(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Model of ``label`` (0 or 1) from the labelled rows that are not held out.

    At most ``CLASS_ROWS`` rows of each class are taken, those with the smallest hash of the id, so where labels abound
    both classes weigh the same. An id with several labels counts with the smallest, one with several
    texts with the smallest text; null labels and ids are left out. Without rows of both classes every score is nearly
    0 or 1, or a half if there are none at all. Features are extracted in parallel; what the training task receives is
    bounded by ``2 * CLASS_ROWS * BUCKETS`` numbers."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    found = {r["label"] for r in known.select("label").distinct().collect()}
    if len(found) < 2:
        return Model(np.zeros(SIZE, np.float32), {frozenset([0]): -12.0, frozenset([1]): 12.0}.get(frozenset(found), 0.0))
    chosen = [
        known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLASS_ROWS) for k in (0, 1)
    ]
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "text", SLICE_CHARS):
            found = sparse(texts)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("label"),
                pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()),
            ], names=["doc_id", "label", "ids", "shares"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        rows = [
            (np.frombuffer(i, np.int32), np.frombuffer(s, np.float32), int(k))
            for i, s, k in zip(frame["ids"], frame["shares"], frame["label"], strict=True)
        ]
        vectors, layer, bias = train(rows)
        return pd.DataFrame({
            "logits": [(vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32).tobytes()],
            "bias": [float(bias[1] - bias[0])],
        })

    extracted = sample.mapInArrow(extract, "doc_id long, label int, ids binary, shares binary")
    model = extracted.groupBy().applyInPandas(learn, "logits binary, bias double").collect()
    if not model:  # no labelled row has a document
        return Model(np.zeros(SIZE, np.float32), 0.0)
    return Model(np.frombuffer(model[0]["logits"], np.float32), model[0]["bias"])


def score(documents: DataFrame, model: Model, column: str = "text", name: str = "score") -> DataFrame:
    """``documents`` with ``name``: the probability of class 1, from the text alone, the whole of it.

    Null and empty texts get the probability that the bias gives; very long ones are added up in bounded memory; repeated
    rows get equal scores; other columns stay, one called ``name`` is replaced; an empty table stays empty."""
    fields = [f for f in documents.schema if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, column, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays(
                [part.column(f.name) for f in fields] + [pa.array(model.scores(texts))], names=schema.names)

    return documents.mapInArrow(run, schema)


#: Documents with a lower score are rejected.
KEEP = 0.7


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: the score of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not rejected, with the columns they came with."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, name="_score").where(F.col("_score") >= KEEP).drop("_score")
