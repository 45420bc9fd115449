"""Exact top-k search by inner product with a k-d tree in every shard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from webtally.llm import search
from webtally.llm.common import table

LEAF_ROWS = 128
#: Products and sums of integers below this are exact in double precision.
EXACT = 2.0**53
#: Above this they may not fit into a long.
LONG = 2.0**62
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class Tree:
    """Nodes with tight boxes; a leaf's rows lie together. ``left`` and ``right`` are -1 in leaves."""

    rows: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: list[int]
    right: list[int]
    start: list[int]
    stop: list[int]


def build(rows: np.ndarray, ids: np.ndarray) -> Tree:
    """Splits at the median of the widest side until a part has at most ``LEAF_ROWS`` rows or only equal ones."""
    order = np.arange(len(ids))
    low, high, left, right, start, stop = [], [], [], [], [], []
    todo = [(0, len(ids), -1, False)]
    while todo:
        a, b, parent, is_right = todo.pop()
        me = len(start)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        part = rows[order[a:b]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        start.append(a)
        stop.append(b)
        left.append(-1)
        right.append(-1)
        widest = int((high[-1].astype(np.float64) - low[-1]).argmax())
        if b - a > LEAF_ROWS and high[-1][widest] > low[-1][widest]:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
            todo += [(a + middle, b, me, True), (a, a + middle, me, False)]
    return Tree(rows[order], ids[order], np.array(low), np.array(high), left, right, start, stop)


def find(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int):
    """Best-first: the leaf whose box allows the highest product comes next, until none reaches the k-th best so far. All
    queries go on in rounds, each visiting its next one, two, four, ... leaves; those that visit a leaf are one product."""
    low, high = tree.low.astype(np.float64), tree.high.astype(np.float64)
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    bounds = up @ high.T + down @ low.T
    size = up @ np.abs(high).T - down @ np.abs(low).T
    exact = size.max() < EXACT
    if not exact:  # rounded sums: widen by more than they can be off
        bounds += size * 1e-12 + 2048
    kind = np.float64 if exact else np.int64 if size.max() < LONG else object  # object: whole numbers of any size
    rows, asked = tree.rows.astype(kind), queries.astype(kind)
    leaves = np.flatnonzero(np.array(tree.left) < 0)
    bounds[bounds < least[:, None]] = np.nan  # neither reached nor any leaf below
    for node, (left, right) in enumerate(zip(tree.left, tree.right)):
        if left >= 0:
            bounds[np.ix_(np.isnan(bounds[:, node]), [left, right])] = np.nan
    bounds = bounds[:, leaves]
    turn = np.argsort(-bounds, axis=1, kind="stable")
    kth = least.astype(np.float64)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else np.int64)]
    done, step = 0, 1
    while done < len(leaves):
        now = turn[:, done:done + step]
        which, at = np.nonzero(np.take_along_axis(bounds, now, axis=1) >= kth[:, None])
        if not len(which):
            break
        visited = now[which, at]
        by_leaf = np.argsort(visited, kind="stable")
        which, visited = which[by_leaf], visited[by_leaf]
        starts = np.flatnonzero(np.diff(visited, prepend=-1))
        found = [best]
        for a, b in zip(starts, [*starts[1:], len(which)]):
            leaf, those = leaves[visited[a]], which[a:b]
            part = slice(tree.start[leaf], tree.stop[leaf])
            new = asked[those] @ rows[part].T
            if kind is object:
                new = np.clip(new, LEAST, MOST).astype(np.int64)
            i, j = np.nonzero((new >= kth[those, None]) & (tree.ids[part] != query_ids[those, None]))
            if len(i):
                found.append([those[i], tree.ids[part][j], new[i, j]])
        best = search.best_each(*map(np.concatenate, zip(*found)), k)
        full = np.flatnonzero(best[3] == k - 1)
        kth[best[0][full]] = np.maximum(kth[best[0][full]], best[2][full].astype(np.float64))
        best, done, step = best[:3], done + step, 2 * step
    return best[0], best[1], best[2].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each integer vector of ``queries`` (vec_id, v) the ``k`` of ``vectors`` with the largest inner product.

    Null ids and vectors, and vectors with null components, take no part; see ``search.nearest`` for repeated rows, ties,
    lengths and empty tables. Other columns are left out. A product that doesn't fit into a long counts as the nearest one."""
    def own(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "v").where(F.col("vec_id").isNotNull() & search.usable(F.col("v")))

    return search.nearest(own(vectors), own(queries), k, build, find, np.int64, "long")


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """Components times ``scale``, rounded down; those that don't fit into a long become the nearest one."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: five candidates for every 50th vector."""
    embeddings = table(spark, sf_dir, "embeddings").where(search.usable(F.col("embedding")))
    vectors = embeddings.select("vec_id", whole_numbers(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5
"""
