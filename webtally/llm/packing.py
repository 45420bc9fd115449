"""Best-fit packing of documents into training sequences.

Documents become pieces of at most ``capacity`` tokens. How many pieces of each length there are fits on the driver (at
most ``capacity`` numbers), and a configuration says how many pieces of each length share a sequence. The linear program
"as few configurations as cover the histogram" is solved by multiplicative weights: a length that lags behind the others
in coverage becomes worth exponentially more than its size, and a knapsack by dynamic programming prices configurations:
its table gives, for every length, the best one with a piece of that length. All that are worth nearly as much as the best
are used a little in each round, until all tokens but a stated share are covered; the prices also give a lower bound.
The program's fractions are rounded down; what is left then is packed best fit, largest first. Rows are then numbered
within their length in parallel and looked up in the plan."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from webtally.llm.bpe import SLICE_CHARS, codec
from webtally.llm.common import steps, stored, table

#: Rows numbered together by one task, about.
NUMBERED = 2_000


def pieces(df: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every text of ``df`` as pieces of at most ``capacity`` tokens, ``end_id`` after its last token: doc_id, piece,
    start, length, ids_crc32 and, if asked for, ids (packed). Of a longer document the first piece takes the odd rest.

    Null and empty texts give one piece of one token. Repeated rows give their pieces each. Other columns are left out."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in steps(batches, "text", SLICE_CHARS):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own_ids = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(own_ids), own_ids)[: 6 if with_ids else 5])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)],
                names=[f.split()[0] for f in schema.split(", ")])
        own.forget()

    return df.select("doc_id", "text").mapInArrow(run, schema)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity``: the most that items of ``sizes`` (ascending, each any number of times) in it can
    be worth, and the last item put in (an index into ``sizes``; -1: none, as one token less is worth as much)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fit[c]:
            value = best[c - sizes[:n]] + worth[:n]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], last[c] = value[k], k
    return best, last


def program(
    counts: np.ndarray, capacity: int, rounds: int = 250, rate: float = 0.1, step: float = 0.02, tolerance: float = 0.001,
) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """The linear program: configurations, as (length, number) pairs, with how often each is used, and a lower bound of
    what any packing takes.

    In each round a configuration whose worth is within ``tolerance`` of the best covers at most ``step`` of the length
    that it was priced for, and never more pieces than are left. It ends when pieces with at most ``tolerance`` of all
    tokens are left, or after ``rounds``. So its size follows the number of lengths, not of pieces: at most 1 / ``step``
    configurations for each, and some that end a length. The bound is the best of the rounds' dual solutions: prices
    divided by what the best configuration is worth."""
    every = np.arange(capacity + 1)
    left = counts.astype(np.float64)
    total = np.maximum(left, 1)
    used: dict[tuple[tuple[int, int], ...], float] = {}
    bound = 0.0
    for _ in range(rounds):
        sizes = np.flatnonzero(left > 1e-9)
        if left @ every <= tolerance * (counts @ every):
            break
        lag = (left / total)[sizes]
        worth = sizes / capacity * np.exp(rate * (lag - lag.max()))
        best, last = knapsack(sizes, worth, capacity)
        bound = max(bound, float(worth @ counts[sizes] / best[capacity]))
        near = worth + best[capacity - sizes] >= (1 - tolerance) * best[capacity]
        for i in np.argsort(-lag, kind="stable"):
            if not near[i]:
                continue
            need = {int(sizes[i]): 1}
            room = capacity - int(sizes[i])
            while room > 0:
                if last[room] < 0:
                    room -= 1
                    continue
                length = int(sizes[last[room]])
                need[length] = need.get(length, 0) + 1
                room -= length
            times = min(step * total[sizes[i]], *(left[length] / n for length, n in need.items()))
            if times > 1e-9:
                key = tuple(sorted(need.items()))
                used[key] = used.get(key, 0) + times
                for length, n in need.items():
                    left[length] -= n * times
    return used, bound


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (how many pieces of each length) and how often to use each, for ``counts`` pieces of each length
    0 to ``capacity``: the program's rounded down, and best fit, largest first, for what they leave."""
    out: list[tuple[dict[int, int], int]] = []
    rest = counts.astype(np.int64).copy()
    for key, share in program(counts, capacity)[0].items():
        if times := min(int(share + 1e-6), *(int(rest[length]) // n for length, n in key)):
            out.append((dict(key), times))
            for length, n in key:
                rest[length] -= n * times
    while len(there := np.flatnonzero(rest)):  # best fit
        need: dict[int, int] = {}
        room = capacity
        while (k := int(np.searchsorted(there, room, "right")) - 1) >= 0:
            length = int(there[k])
            n = min(int(rest[length]) - need.get(length, 0), room // length)
            if n:
                need[length] = need.get(length, 0) + n
                room -= n * length
            there = there[:k]
        times = min(int(rest[length]) // n for length, n in need.items())
        out.append((need, times))
        for length, n in need.items():
            rest[length] -= n * times
    return out


def slots(configurations: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as ranges of numbers within a length: which sequences and offsets they get."""
    rows, base = [], 0
    taken: dict[int, int] = {}
    for need, times in configurations:
        offset = 0
        for length in sorted(need, reverse=True):
            start = taken.get(length, 0)
            rows.append((length, start, base, need[length], offset))
            taken[length] = start + need[length] * times
            offset += length * need[length]
        base += times
    rows.sort()
    return dict(zip(("length", "start", "base", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(df: DataFrame, capacity: int) -> DataFrame:
    """``df`` (doc_id, piece, start, length between 1 and ``capacity``, ...) with sequence_id and offset: pieces of a
    sequence follow each other without gaps from 0, none over ``capacity``. Equal lengths are interchangeable; they are
    numbered by doc_id and piece, in parts of about ``NUMBERED`` rows, so a length that most pieces have spreads out too.

    Rows are stored first, so that counting and numbering see the same ones. An empty table gives an empty table; repeated
    rows are packed each; nulls in other columns and further columns are kept."""
    df = stored(df, "pieces")
    lengths = df.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in lengths:
        if not 1 <= row["length"] <= capacity:
            raise ValueError(f"a piece of {row['length']} tokens doesn't fit into {capacity}")
        counts[row["length"]] = row["n"]
    places = slots(plan(counts, capacity))
    parts = F.element_at(F.lit((1 + (counts - 1).clip(0) // NUMBERED).tolist()), F.col("length").cast("int") + 1)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "start"), parts))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n")).select(
        "length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start")
    numbered = dealt.withColumn("_rank", F.row_number().over(own)).join(offsets, ["length", "_part"]).select(
        *df.columns, (F.col("_before") + F.col("_rank") - 1).alias("_index"))
    width, names = int(counts.max()) + 1, df.columns
    keys = places["length"] * width + places["start"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, index = batch.column("length").to_numpy(), batch.column("_index").to_numpy()
            k = np.searchsorted(keys, length * width + index, "right") - 1
            nth = index - places["start"][k]
            sequence = places["base"][k] + nth // places["each"][k]
            offset = places["offset"][k] + nth % places["each"][k] * length
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(table(spark, sf_dir, "documents"), path, 2048), 2048)
