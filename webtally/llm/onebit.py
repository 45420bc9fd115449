"""Approximate nearest neighbours on randomly rotated one-bit codes.

A vector is rotated by a random orthonormal matrix into a space of more dimensions and kept as its signs, with two
corrections: the factor that makes the product of a rotated query with the signs an unbiased estimate of the inner
product, and how far that estimate may be off. The codes decide which vectors are scored on the original numbers: those
whose estimate plus error reaches the k-th best estimate minus error. So the number scored follows the data, without a
cap. Every row is indexed; nothing is fitted to a sample, as the rotation doesn't depend on the data."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from webtally.llm import search
from webtally.llm.common import table

#: Bits for each dimension of a vector, at least; their number is a multiple of 64.
BITS_EACH, SEED = 2, 11
#: Standard deviations of the estimate that the error bound spans.
SPAN = 3.0
#: Vectors whose largest component is outside of these are always scored on the original numbers, as are all vectors for
#: such a query, because estimates in single precision could overflow or vanish.
SMALL, LARGE = 1e-12, 1e12


@functools.cache
def rotation(dimensions: int) -> np.ndarray:
    bits = -(-dimensions * BITS_EACH // 64) * 64
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, dimensions)))[0]


@dataclass
class Codes:
    packed: np.ndarray
    factor: np.ndarray
    error: np.ndarray
    rows: np.ndarray
    ids: np.ndarray


def wild(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1)
    return (largest < SMALL) | (largest > LARGE)


def build(rows: np.ndarray, ids: np.ndarray) -> Codes:
    odd = wild(rows)
    turned = np.where(odd[:, None], 1.0, rows) @ rotation(rows.shape[1]).T
    bits = turned.shape[1]
    norm = np.sqrt((turned * turned).sum(axis=1))
    along = np.abs(turned).sum(axis=1) / (norm * np.sqrt(bits))  # cosine of a vector and its signs
    error = norm * np.sqrt(np.maximum(1 - along**2, 0)) / along / np.sqrt(bits - 1)
    return Codes(
        np.packbits(turned > 0, axis=1), norm / (along * np.sqrt(bits)), np.where(odd, np.inf, error), rows, ids)


def find(codes: Codes, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int):
    odd = wild(queries)
    turned = np.where(odd[:, None], 1.0, queries) @ rotation(queries.shape[1]).T
    signs = np.unpackbits(codes.packed, axis=1).astype(np.float32) * 2 - 1
    estimates = (turned.astype(np.float32) @ signs.T) * codes.factor.astype(np.float32)
    spans = np.where(odd, np.inf, SPAN * np.sqrt((turned * turned).sum(axis=1)))
    out = []
    for i, own in enumerate(query_ids):
        error = spans[i] * np.maximum(codes.error, 1e-30)
        other = codes.ids != own
        sure = (estimates[i] - error)[other]
        reach = least[i]
        if len(sure) >= k:
            reach = max(reach, np.partition(sure, len(sure) - k)[len(sure) - k])
        rerank = np.flatnonzero(other & (estimates[i] + error >= reach))
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (codes.rows[rerank] * queries[i]).sum(axis=1)  # row by row: equal vectors get equal scores
        scores = np.where(np.isnan(scores), -np.inf, scores)
        keep = search.best(scores, codes.ids[rerank], k)
        out.append((np.full(len(keep), i), codes.ids[rerank][keep], scores[keep]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each vector of ``queries`` (vec_id, v) the ``k`` of ``vectors`` found nearest by inner product, with exact
    scores on the original numbers in double precision.

    Null ids and vectors, zero vectors and those with null or non-finite components take no part; see ``search.nearest``
    for repeated rows, ties, lengths and empty tables. Other columns are left out. Scores beyond double precision are
    infinite; where products of both signs are, the score is minus infinity."""
    def own(df: DataFrame) -> DataFrame:
        not_zero = F.exists("v", lambda x: x != 0)
        return df.select("vec_id", "v").where(F.col("vec_id").isNotNull() & search.usable(F.col("v")) & not_zero)

    return search.nearest(own(vectors), own(queries), k, build, find, np.float64, "double")


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: twenty neighbours of every 20th vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20)
