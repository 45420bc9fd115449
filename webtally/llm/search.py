"""Blockwise search of many query vectors in many shards of candidates.

Candidates are dealt out by hash into shards of bounded size, and each shard is indexed once. Queries are packed into
blocks. First every block visits one shard, which gives each query a score that its k-th best result cannot fall below;
with this bound every block then visits all other shards, and the k best of all visits remain. For that, groups of shards
meet groups of blocks, both of bounded size: shuffled are the index once for each group of blocks and the packed queries
once for each group of shards. No pair is a row before a group has chosen its best. Packed rows are never broadcast: Spark
can't know how large they are."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from webtally.llm.common import stored

SHARD_ROWS, BLOCK_ROWS = 4096, 256
#: Bytes of the vectors in a group of shards, and of the queries and results of a group of blocks; one of each at least.
GROUP_BYTES = 16 << 20
#: Groups of shards for each core, as long as there are so many shards.
GROUPS_A_CORE = 3
#: Spark's reader holds all of a file's at a time.
INDEXES_A_FILE = 4
FOUND = ["query_id", "vec_id", "score"]

#: (vectors, ids) of a shard to what is searched.
Build = Callable[[np.ndarray, np.ndarray], object]
#: (index, queries, query ids, score that a result must reach, k) to (query number, candidate id, score) arrays.
Find = Callable[[object, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, build: Build, find: Find, kind: type, score_type: str,
) -> DataFrame:
    """For each row of ``queries`` (vec_id, v) the ``k`` rows of ``vectors`` (vec_id, v) with the highest score, ties to
    the smaller vec_id: query_id, rank, vec_id, score. ``kind`` is the numpy type that vectors are searched as.

    Rows with a null id or vector must be left out before. A row never finds rows with its own id. Equal rows count once;
    an id with several vectors is a candidate with each and asks with the smallest. Vectors of other lengths than the
    query's are no candidates. Without candidates or queries the result is empty."""
    distinct = vectors.groupBy("vec_id", "v").agg(F.lit(1)).select("vec_id", "v", F.size("v").alias("dim"))
    shards = max(1, -(-distinct.count() // SHARD_ROWS))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("dim"))
    asked = stored(asked, "queries")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    vector_type = "bigint" if kind is np.int64 else "double"

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        built = build(np.array(frame["v"].tolist(), kind), frame["vec_id"].to_numpy())
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "shard": frame["shard"].iloc[:1], "built": [pickle.dumps(built)]})

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        return pd.DataFrame({
            "dim": frame["dim"].iloc[:1], "block": frame["block"].iloc[:1], "ids": [frame["vec_id"].to_numpy().tobytes()],
            "vectors": [np.array(frame["v"].tolist(), kind).tobytes()], "least": [frame["least"].to_numpy(np.float64).tobytes()],
        })

    def visit(built: object, block: NamedTuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(block.ids, np.int64)
        asking = np.frombuffer(block.vectors, kind).reshape(len(ids), -1)
        which, found, scores = find(built, asking, ids, np.frombuffer(block.least), k)
        return ids[which], found, scores

    def visit_home(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame(dict(zip(FOUND, visit(pickle.loads(row.built), row))))

    def visit_others(indexes: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` best that a group of shards has for each query of a group of blocks, home shards left out."""
        loaded = [(row.shard, pickle.loads(row.built)) for row in indexes.itertuples() if len(blocks)]
        out = [pd.DataFrame({name: np.zeros(0, np.int64) for name in FOUND})]
        for block in blocks.itertuples():
            visits = [visit(built, block) for shard, built in loaded if shard != block.home]
            if visits:
                out.append(pd.DataFrame(dict(zip(FOUND, best_each(*map(np.concatenate, zip(*visits)), k)))))
        return pd.concat(out[1:] or out)

    def in_blocks(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)"))
        return dealt.groupBy("dim", "block").applyInPandas(
            packed, "dim int, block int, ids binary, vectors binary, least binary")

    result = f"query_id long, vec_id long, score {score_type}"
    shard = F.expr(f"cast(pmod(xxhash64(vec_id, v), {shards}) as int)").alias("shard")
    built = distinct.select("vec_id", F.col("v").cast(f"array<{vector_type}>"), "dim", shard)
    built = stored(built.groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, built binary"), "index", INDEXES_A_FILE)
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = in_blocks(asked.withColumn("least", F.lit(float("-inf")))).withColumn("shard", home)
    homes = built.where(F.col("shard") < blocks).hint("merge")
    first = first.join(homes, ["dim", "shard"]).select("ids", "vectors", "least", "built")
    first = stored(first.mapInPandas(visit_home, result), "first")
    bound = first.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    again = asked.join(bound, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    again = in_blocks(again).withColumn("home", home)
    spread = max(1, shards // (GROUPS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism))
    # Of a dimension: shards in a group of shards, and blocks in a group of blocks, whose queries have k results of 24 bytes twice.
    shards_each = f"least({spread}, greatest(1, {GROUP_BYTES} div ({SHARD_ROWS} * 8L * dim)))"
    blocks_each = f"greatest(1, {GROUP_BYTES} div ({BLOCK_ROWS} * (8L * dim + {48 * k})))"
    built = built.withColumn("shards", F.expr(f"shard div {shards_each}")).withColumn(
        "blocks", F.expr(f"explode(sequence(0L, {blocks - 1} div {blocks_each}))"))
    again = again.withColumn("blocks", F.expr(f"block div {blocks_each}")).withColumn(
        "shards", F.expr(f"explode(sequence(0L, {shards - 1} div {shards_each}))"))
    keys = ["dim", "shards", "blocks"]
    again = built.groupBy(*keys).cogroup(again.groupBy(*keys)).applyInPandas(visit_others, result)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.unionByName(again).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, falling(scores)))[:k]


def best_each(which: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each query's rows the ``k`` with the highest scores, ties to the smaller id: queries, ids, scores and places from 0."""
    order = np.lexsort((ids, falling(scores), which))
    which, ids, scores = which[order], ids[order], scores[order]
    starts = np.ones(len(which), bool)
    starts[1:] = which[1:] != which[:-1]
    first = np.flatnonzero(starts)
    place = np.arange(len(which)) - np.repeat(first, np.diff(first, append=len(which)))
    keep = place < k
    return [which[keep], ids[keep], scores[keep], place[keep]]


def falling(scores: np.ndarray) -> np.ndarray:
    return ~scores if scores.dtype.kind == "i" else -scores  # the least long has no negative
