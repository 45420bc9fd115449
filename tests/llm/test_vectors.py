import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import differences, duck
from tests.llm import brute
from webtally.llm import kdtree, onebit, search
from webtally.llm.queries import ORACLES, QUERIES


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_op1_equals_sql(spark, folder):
    assert differences(QUERIES["op1_exact_top_k"](spark, folder), duck(folder), ORACLES["op1_exact_top_k"]) == []


def test_op5_finds_what_brute_force_finds(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    own = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    want = brute.nearest({i: v.tolist() for i, v in own.items()}, [i for i in own if i % 20 == 0], 20)
    got = listed(QUERIES["op5_one_bit_neighbours"](spark, folder))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q, found in got.items():
        for i, score in found:
            assert score == pytest.approx(float(own[q] @ own[i]), rel=1e-12)


@pytest.mark.parametrize("operator, kind", [(kdtree.top_k, "bigint"), (onebit.neighbours, "double")])
def test_many_shards_ties_nulls_and_repeated_rows(spark, monkeypatch, operator, kind):
    monkeypatch.setattr(search, "SHARD_ROWS", 30)
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    numbers = np.floor(8 * brute.vectors(120, 6, 1)).astype(int)
    numbers[40:80] = numbers[0]  # a third of all rows are equal
    numbers[(numbers == 0).all(axis=1)] = 1
    own = {i: v.tolist() for i, v in enumerate(numbers)}
    odd = [(200, None), (201, [1, None, 2, 3, 4, 5]), (None, [1] * 6), (202, []), (203, [9, 9])]
    rows = [*own.items(), *list(own.items())[:20], *odd]
    if kind == "double":
        rows = [(i, v and [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id bigint, v array<{kind}>, score string")
    want = brute.nearest(own, [i for i in own if i % 3 == 0], 5)
    got = listed(operator(df, df.where("vec_id % 3 = 0"), 5))
    assert {q: [(i, float(s)) for i, s in v] for q, v in got.items()} == {q: [(i, float(s)) for i, s in v] for q, v in want.items()}
    one = df.where("vec_id = 3")
    assert operator(one, one, 5).count() == 0
    assert operator(df.limit(0), df.limit(0), 5).columns == ["query_id", "rank", "vec_id", "score"]
    assert operator(df.limit(0), df.limit(0), 5).count() == 0
    assert len(listed(operator(df, one, 500))[3]) == len(own) - 1


def test_not_finite_and_zero_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [math.nan, 1.0]), (2, [math.inf, 1.0]), (3, [0.0, 0.0]), (4, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    assert listed(onebit.neighbours(df, df, 3)) == {0: [(4, 5.0)], 4: [(0, 5.0)]}
    whole = df.where(search.usable(F.col("v"))).withColumn("v", kdtree.whole_numbers(F.col("v")))
    assert listed(kdtree.top_k(whole, whole.where("vec_id = 0"), 3)) == {0: [(4, 5 * 65536), (3, 0)]}


def test_large_numbers_stay_exact():
    rows = np.array([[2**31, 1], [2**31, 2], [2**30, 5]], np.int64)
    tree = kdtree.build(rows, np.arange(3))
    which, ids, scores = kdtree.find(tree, np.array([[2**31 - 1, 1]]), np.array([9]), np.array([-np.inf]), 2)
    assert ids.tolist() == [1, 0] and scores.tolist() == [2**31 * (2**31 - 1) + 2, 2**31 * (2**31 - 1) + 1]


def test_extreme_components(spark):
    """Finite numbers of any size take part: whole numbers end at a long, estimates aren't used where they could fail."""
    rows = [(0, [1.0, 2.0]), (1, [-1e300, 1.0]), (2, [1e300, 1e300]), (3, [1e-300, 0.0]), (4, [3.0, 1.0]), (5, [-1e-200, -1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    got = listed(onebit.neighbours(df, df, 5))
    for q, v in rows:
        want = sorted((-(v[0] * w[0] + v[1] * w[1]), i) for i, w in rows if i != q)
        assert got[q] == [(i, -s) for s, i in want]
    whole = df.where(search.usable(F.col("v"))).withColumn("v", kdtree.whole_numbers(F.col("v")))
    most, least = 2**63 - 1, -(2**63)
    assert listed(kdtree.top_k(whole, whole.where("vec_id = 0"), 5)) == {
        0: [(2, most), (4, 5 * 65536), (3, 0), (5, -512 * 256 - 256), (1, least)]}
    assert listed(kdtree.top_k(whole, whole.where("vec_id = 2"), 2)) == {2: [(0, most), (4, most)]}


def below_broadcasts(plan):
    children = plan.children()
    under = [children.apply(i) for i in range(children.size())]
    if plan.nodeName() == "AdaptiveSparkPlan":
        under = [plan.initialPlan()]
    own = [plan.toString()] if plan.nodeName() == "BroadcastExchange" else []
    return own + [text for child in under for text in below_broadcasts(child)]


@pytest.mark.parametrize("operator, kind", [(kdtree.top_k, "bigint"), (onebit.neighbours, "double")])
def test_packed_rows_are_never_broadcast(spark, monkeypatch, operator, kind):
    """A block or an index is larger than Spark's estimate, and a block for each shard much larger: driver memory."""
    monkeypatch.setattr(search, "SHARD_ROWS", 30)
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    frames, write = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df, *how: (frames.append(df), write(df, *how))[1])
    rows = [(i, [i % 7 + 1, i % 5 + 1]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<int>").withColumn("v", F.col("v").cast(f"array<{kind}>"))
    frames.append(operator(df, df.where("vec_id % 3 = 0"), 5))
    found = [t for f in frames for t in below_broadcasts(f._jdf.queryExecution().executedPlan())]
    assert not [t for t in found if "InPandas" in t or "built" in t]


def test_a_file_has_few_indexes(spark, monkeypatch):
    """Spark's reader holds a batch of rows of a file, and an index is a row of some MB."""
    monkeypatch.setattr(search, "SHARD_ROWS", 3)
    paths, write = {}, search.stored

    def kept(df, kind, *how):
        paths[kind] = write(df, kind, *how)
        return paths[kind]

    monkeypatch.setattr(search, "stored", kept)
    df = spark.createDataFrame([(i, [i % 7, 1]) for i in range(300)], "vec_id bigint, v array<bigint>")
    kdtree.top_k(df, df.where("vec_id = 0"), 5)
    index = paths["index"].groupBy(F.input_file_name()).count()
    assert index.agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("size, cores", [(1, 1), (1000, 1), (1 << 24, 1), (1 << 24, 1000)])
@pytest.mark.parametrize("operator, kind", [(kdtree.top_k, "bigint"), (onebit.neighbours, "double")])
def test_groups_of_any_size(spark, monkeypatch, operator, kind, size, cores):
    """Ids with two vectors are candidates with both, also where their scores are equal."""
    monkeypatch.setattr(search, "SHARD_ROWS", 30)
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    monkeypatch.setattr(search, "GROUP_BYTES", size)
    monkeypatch.setattr(search, "GROUPS_A_CORE", cores)
    wide = [(1000 + i, [i % 5 + 1, 2, i % 3 + 1]) for i in range(60)]
    plain = [(i, [i % 4 + 1] * 2) for i in range(0, 90, 3)]
    twice = [(i, v) for i in range(1, 90, 3) for v in ([i % 7, 9 - i % 7], [9 - i % 7, i % 7])]
    df = spark.createDataFrame(wide + plain + twice, "vec_id bigint, v array<int>")
    df = df.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    got = listed(operator(df, df.where("vec_id % 3 = 0"), 7))
    want = {}
    for q, asked in (r for r in wide + plain if r[0] % 3 == 0):
        scores = [(-sum(a * b for a, b in zip(asked, v)), i) for i, v in wide + plain + twice if i != q and len(v) == len(asked)]
        want[q] = [(i, -s) for s, i in sorted(scores)[:7]]
    assert got == want


def test_the_tree_search_equals_brute_force():
    random = np.random.default_rng(4)
    for trial in range(60):
        largest = [2, 1000, 2**30, 2**50, 2**63 - 1][trial % 5]
        rows = random.integers(-largest, largest, (random.integers(1, 900), random.integers(1, 5)), endpoint=True)
        rows[: len(rows) // 3] = rows[0]
        queries, k = rows[random.integers(0, len(rows), 9)], int(random.integers(1, 20))
        ids, own = random.permutation(len(rows)), random.integers(0, len(rows), 9)
        exact = np.clip(queries.astype(object) @ rows.astype(object).T, kdtree.LEAST, kdtree.MOST)
        want = [sorted((-s, i) for s, i in zip(line, ids.tolist()) if i != me)[:k] for line, me in zip(exact.tolist(), own)]
        for least in (np.full(9, -np.inf), np.array([float(-w[-1][0]) if w else -np.inf for w in want])):
            which, found, scores = kdtree.find(kdtree.build(rows, ids), queries, own, least, k)
            assert list(zip(which.tolist(), (-scores.astype(object)).tolist(), found.tolist())) == [
                (q, s, i) for q, line in enumerate(want) for s, i in line]
