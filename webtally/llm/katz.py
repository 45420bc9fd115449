"""Bigram language model with Katz backoff: Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = (1 - 1/(c(h)+1)) d(c(h,w)) c(h,w) / c(h)    if the pair (h, w) occurs in training
             = alpha(h) P(w)                               otherwise; alpha is 1 for a history that doesn't occur
    P(w)     = (1 - 1/(N+1)) d(c(w)) c(w) / N              if w occurs in training, and what is left for all other words

alpha(h) shares what seen pairs leave among unseen words so that everything sums to one. The small reserved part keeps it
above zero where no count is low enough for a discount.

Documents are packed into batches. Each batch asks for the counts of its distinct words: the words of all batches are dealt
out by hash, added up in tables by part, and every batch is answered with a count and a short number for each of its words.
It then sends its distinct pairs, numbered, with the documents they stand in, to parts dealt out by history; a history with
many occurrences is split by the next word too, which its count tells without a list of such histories. A part adds up its
pairs and reduces them to sums for each document; weights of histories that are split, and the discounts, which depend on
all counts, enter when the sums are put together. So each pair is shuffled once, whatever its frequency in a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from webtally.llm.common import steps, stored, table
from webtally.llm.quality import held_out

#: Characters of a batch and of a part, about; occurrences of a history for each part that it is split into.
BATCH_CHARS, PART_CHARS, SPLIT = 4 << 20, 20 << 20, 1_000_000
#: Counts up to this one are discounted.
LOW = 5
END = 1  # hash and number of the end of a text; START and UNKNOWN are no words and have numbers only
UNKNOWN, START = 0, 2

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) | 1 << 63  # apart from END
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(20)


def _pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers, by byte planes; ascending ones as differences."""
    values = np.asarray(values, np.uint64)
    if ascending:
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def _tokens(blob: bytes, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a batch, each text followed by END, and how many tokens each text has."""
    hashes, sizes = [], []
    data = zstandard.decompress(blob)
    texts = int.from_bytes(data[:8], "little")
    ends = np.cumsum(np.frombuffer(data, "<u8", texts, 8)).tolist()
    body = memoryview(data)[8 + 8 * texts :]
    for a, b in zip([0, *ends], ends, strict=False):
        words = bytes(body[a:b]).lower().split()
        hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        hashes.append(np.array([END], np.uint64))
        sizes.append(len(words) + 1)
    return np.concatenate(hashes), np.array(sizes)


def batches_of(documents: DataFrame) -> DataFrame:
    """Batches of documents: batch, chars, ids and whether there is one, held, texts (compressed: their number, their sizes
    and the bytes of all of them, so that any byte may be part of a word)."""
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[bool] = []
        texts: list[bytes] = []
        size = count = 0

        def packed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array([int(xxhash.xxh3_64_intdigest(f"{part_of}-{count}") >> 1)]), pa.array([size], pa.int64()), pa.array([[i or 0 for i in ids]], pa.list_(pa.int64())), pa.array([[i is not None for i in ids]], pa.list_(pa.bool_())),
                pa.array([list(held)], pa.list_(pa.bool_())), pa.array([zstandard.compress(np.array([len(texts), *map(len, texts)], "<u8").tobytes() + b"".join(texts), 3)], pa.binary()),
            ], names=["batch", "chars", "ids", "named", "held", "texts"])
            ids.clear(), held.clear(), texts.clear()
            return out

        part_of = None
        for frame, found in steps(frames, "text"):
            part_of = frame.column("part")[0].as_py()
            for doc, out, text in zip(frame.column("doc_id").to_pylist(), frame.column("held").to_pylist(), found, strict=True):
                ids.append(doc), held.append(out), texts.append(text.encode("utf-8", "replace"))
                size += len(texts[-1]) + 1
                if size >= BATCH_CHARS:
                    yield packed()
                    size, count = 0, count + 1
        if ids:
            yield packed()

    rows = documents.select("doc_id", "text", held_out(F.col("doc_id"), 10, 0).alias("held"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "batch long, chars long, ids array<long>, named array<boolean>, held array<boolean>, texts binary")


def word_counts(batches: DataFrame, parts: int) -> DataFrame:
    """Answers to batches (batch, part, counts, numbers: packed, in the order of the word hashes of that part), and for each
    part a row with batch -1: training tokens, distinct words and how many words occur 1 to LOW + 1 times."""
    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for frame in frames:
            for row in frame.itertuples():
                hashes, sizes = _tokens(row.texts, known)
                words, where = np.unique(hashes, return_inverse=True)
                train = np.bincount(where[np.repeat(~np.array(row.held, bool), sizes)], minlength=len(words))
                part = (_mix(words) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    own = order[a:b]
                    yield pd.DataFrame({"batch": [row.batch], "part": [part[own[0]]], "words": [_pack(words[own], True)], "train": [_pack(train[own])]})

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        asked = [_unpack(w, True) for w in frame["words"]]
        words, where = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(where, np.concatenate([_unpack(t) for t in frame["train"]])).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -total))] = np.arange(len(words))
        if 3 + len(words) * parts >= 2**32:
            raise ValueError("words have 32-bit numbers here; that many distinct ones don't fit")
        number = np.where(words == END, END, np.where(total > 0, 3 + rank * parts + part, UNKNOWN))  # frequent words: small numbers
        rows, a = [], 0
        for batch, own in zip(frame["batch"], asked, strict=True):
            at = where[a : a + len(own)]
            rows.append((batch, part, _pack(total[at]), _pack(number[at]), 0, 0, None))
            a += len(own)
        low = np.bincount(np.minimum(total, LOW + 2), minlength=LOW + 3)[1 : LOW + 2]
        rows.append((-1, part, None, None, int(total.sum()), int((total > 0).sum()), low.tolist()))
        return pd.DataFrame(rows, columns=["batch", "part", "counts", "numbers", "tokens", "words", "low"])

    asked = batches.select("batch", "held", "texts").mapInPandas(ask, "batch long, part int, words binary, train binary")
    return asked.groupBy("part").applyInPandas(
        count, "batch long, part int, counts binary, numbers binary, tokens long, words long, low array<long>")


def discounts(low: list[int]) -> np.ndarray:
    """Katz's d(1) to d(LOW) from how many things occur 1 to LOW + 1 times; 1, no discount, where that isn't between 0 and 1."""
    d = np.ones(LOW)
    if low[0] and low[LOW]:
        tail = (LOW + 1) * low[LOW] / low[0]
        for r in range(1, LOW + 1):
            if low[r - 1] and tail < 1:
                value = ((r + 1) * low[r] / (r * low[r - 1]) - tail) / (1 - tail)
                d[r - 1] = value if 0 < value < 1 else 1
    return d


class Unigrams:
    """P(w) by the count of w in training."""

    def __init__(self, tokens: int, words: int, low: list[int]):
        self.tokens, self.words, self.d = tokens, words, discounts(low)
        seen = sum((1 - self.d[r - 1]) * r * low[r - 1] for r in range(1, LOW + 1))
        self.keep = tokens / (tokens + 1)
        self.unknown = 1 - self.keep * (1 - seen / tokens) if tokens else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        factor = np.concatenate([[1.0], self.d, [1.0]])[np.minimum(count, LOW + 1)]
        return np.where(count > 0, self.keep * factor * count / self.tokens, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


#: Rows of ``pair_sums``: of a document, of its sums in a part, of what a document's unseen pairs after a history need,
#: of a split history in a part, and of a part.
DOCUMENT, SUMS, BACKOFF, HISTORY, PART = range(5)
FIELDS = (
    "kind int, batch long, doc int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, sum double, "
    "history long, n long, count long, low1 long, low2 long, low3 long, low4 long, low5 long, low6 long, lower double")


def pair_sums(batches: DataFrame, answers: DataFrame, parts: int, training_texts: int, unigrams: Unigrams, split: int = SPLIT) -> DataFrame:
    """What scores are put together from; see ``FIELDS`` and the kinds of rows."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, FIELDS.split(", "))])
    names = ["batch", "part", "docs", "pairs", "train", "next", "histories", "times", "sizes", "at"]

    def send(key, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in texts.itertuples():
            hashes, sizes = _tokens(row.texts, _Hashes())
            words, where = np.unique(hashes, return_inverse=True)
            part = (_mix(words) % np.uint64(parts)).astype(np.int64)
            counts, numbers = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for answer in found.itertuples():
                own = part == answer.part
                counts[own], numbers[own] = _unpack(answer.counts).astype(np.int64), _unpack(answer.numbers).astype(np.int64)
            count, number = counts[where], numbers[where]
            starts = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(sizes)), sizes)
            history, times = np.roll(number, 1), np.roll(count, 1)
            history[starts], times[starts] = START, training_texts
            base = np.add.reduceat(unigrams.base(count), starts)
            # After an unknown history the word's own probability counts; all else goes to the parts.
            alone = np.bincount(doc, np.where(times == 0, np.log10(unigrams.p(count)), 0.0), len(sizes))
            docs = pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row.ids, pa.int64(), mask=~row.named.astype(bool)), "held": pa.array(row.held.tolist()), "n": pa.array(sizes),
                "known": pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), "base": pa.array(base), "alone": pa.array(alone)})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, docs.schema) as stream:
                stream.write_batch(docs)
            rows.append((row.batch, int(row.batch % parts), out.getvalue().to_pybytes(), *[None] * 7))
            use = np.flatnonzero(times > 0)
            pair = history[use].astype(np.uint64) << np.uint64(32) | number[use].astype(np.uint64)
            ways = 1 + times[use] // split
            to = ((_mix(history[use]) + _mix(number[use]) % ways.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((doc[use], pair, to))
            to, pair, use = to[order], pair[order], use[order]
            train = ~np.array(row.held, bool)[doc[use]]
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=False):
                first = np.flatnonzero(np.diff(pair[a:b], prepend=pair[a] + np.uint64(1)))
                runs = np.diff(first, append=b - a)
                own = use[a:b][first]
                begins = np.flatnonzero(np.diff(history[own], prepend=-1))
                rows.append((
                    row.batch, int(to[a]), None, _pack(pair[a:b][first], True), _pack(np.add.reduceat(train[a:b].astype(np.int64), first)),
                    _pack(count[own]), _pack(history[own][begins]), _pack(times[own][begins]), _pack(runs), _pack(doc[use[a:b]])))
        return pd.DataFrame(rows, columns=names)

    def add(table_: pa.Table) -> pa.Table:
        out: list[pa.Table] = []

        def put(kind: int, rows: int, low: np.ndarray | None = None, **columns) -> None:
            columns |= {} if low is None else {f"low{r + 1}": low[:, r] for r in range(low.shape[1])}
            columns["kind"] = np.full(rows, kind)
            out.append(pa.table([
                pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema))

        frame = table_.to_pandas()
        for batch, blob in zip(frame["batch"], frame["docs"], strict=True):
            if blob is not None:
                docs = pa.ipc.open_stream(blob).read_all()
                n = docs.num_rows
                put(DOCUMENT, n, batch=np.full(n, batch), doc=np.arange(n), doc_id=docs["doc_id"].combine_chunks(), held_out=docs["held"].combine_chunks(),
                    n_tokens=docs["n"].to_numpy(), n_known=docs["known"].to_numpy(), base_score=docs["base"].to_numpy(), sum=docs["alone"].to_numpy())
        frame = frame[frame["docs"].isna()]
        if len(frame):
            asked = [_unpack(p, True) for p in frame["pairs"]]
            pairs, where = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(where, np.concatenate([_unpack(t) for t in frame["train"]])).astype(np.int64)
            after = np.zeros(len(pairs), np.int64)
            after[where] = np.concatenate([_unpack(n) for n in frame["next"]]).astype(np.int64)
            histories, of = np.unique((pairs >> np.uint64(32)).astype(np.int64), return_inverse=True)
            times = np.zeros(len(histories), np.int64)
            times[np.searchsorted(histories, np.concatenate([_unpack(h) for h in frame["histories"]]).astype(np.int64))] = np.concatenate(
                [_unpack(t) for t in frame["times"]]).astype(np.int64)
            low = np.stack([np.bincount(of[total == r], minlength=len(histories)) for r in range(1, LOW + 1)], 1)
            lower = np.bincount(of, np.where(total > 0, unigrams.p(after), 0.0), len(histories))
            many = times >= split
            put(HISTORY, int(many.sum()), low[many], history=histories[many], lower=lower[many])
            put(PART, 1, np.bincount(np.minimum(total, LOW + 2), minlength=LOW + 3)[None, 1 : LOW + 2])
            seen = np.log10(np.maximum(total, 1)) - np.log10(times[of] + 1)  # (1 - 1/(c+1)) / c = 1 / (c+1)
            value = np.where(total > 0, seen, np.log10(unigrams.p(after)))
            a = 0
            for batch, keys, sizes, at in zip(frame["batch"], asked, frame["sizes"], frame["at"], strict=True):
                own = np.repeat(where[a : a + len(keys)], _unpack(sizes).astype(np.int64))
                doc = _unpack(at).astype(np.int64)
                a += len(keys)
                docs, place = np.unique(doc, return_inverse=True)
                counted = total[own]
                each = np.stack([np.bincount(place[counted == r], minlength=len(docs)) for r in range(1, LOW + 1)], 1)
                put(SUMS, len(docs), each, batch=np.full(len(docs), batch), doc=docs, sum=np.bincount(place, value[own]))
                unseen = np.flatnonzero(counted == 0)
                both, n = np.unique(doc[unseen] * len(histories) + of[own[unseen]], return_counts=True)
                for chosen, inside in ((~many, True), (many, False)):
                    use = chosen[both % len(histories)]
                    h = both[use] % len(histories)
                    stats = {"low": low[h], "lower": lower[h]} if inside else {}
                    put(BACKOFF, len(h), batch=np.full(len(h), batch), doc=both[use] // len(histories), history=histories[h], n=n[use],
                        count=times[h], **stats)
        return pa.concat_tables(out)

    asked = batches.select("batch", "ids", "named", "held", "texts").groupBy("batch").cogroup(
        answers.where("batch >= 0").select("batch", "part", "counts", "numbers").groupBy("batch")).applyInPandas(
        send, "batch long, part int, docs binary, pairs binary, train binary, next binary, histories binary, times binary, sizes binary, at binary")
    return asked.groupBy("part").applyInArrow(add, FIELDS)


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of ``documents``
    (doc_id, text, ...), learnt from those whose id isn't held out.

    Null and empty texts have the end as their one token. A null id is not held out. Repeated rows are learnt from and
    scored each. Very long texts are scored whole, within a batch of their own at most. Words are compared by 64-bit
    hashes. Without training texts every probability is 1. Other columns are left out; an empty table stays empty."""
    batches = stored(batches_of(documents), "batches")
    of_batches = F.aggregate("held", F.lit(0), lambda n, h: n + F.when(h, 0).otherwise(1))
    chars, training = batches.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum(of_batches), F.lit(0))).first()
    parts = 1 + chars // PART_CHARS
    answers = stored(word_counts(batches, parts), "words")
    known = answers.where("batch < 0").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), *[F.coalesce(F.sum(F.get("low", F.lit(r))), F.lit(0)) for r in range(LOW + 1)]).first()
    unigrams = Unigrams(known[0], known[1], list(known[2:]))
    sums = stored(pair_sums(batches, answers, parts, training, unigrams), "sums")
    low = sums.where(F.col("kind") == PART).agg(*[F.coalesce(F.sum(f"low{r}"), F.lit(0)) for r in range(1, LOW + 2)]).first()
    d = discounts(list(low))
    seen = sums.where(F.col("kind") == SUMS).select("batch", "doc", (F.col("sum") + _weighed(np.log10(d))).alias("sum"))
    lows = [f"low{r}" for r in range(1, LOW + 1)]
    split = sums.where(F.col("kind") == HISTORY).groupBy("history").agg(*[F.sum(c).alias(c) for c in (*lows, "lower")])
    back = sums.where(F.col("kind") == BACKOFF).select("batch", "doc", "history", "n", "count", *lows, "lower")
    late = back.where("low1 IS NULL").drop(*lows, "lower").join(split, "history").select(*back.columns)
    kept = F.col("count") / (F.col("count") + 1)
    left = 1 - kept * (1 - _weighed((1 - d) * np.arange(1, LOW + 1)) / F.col("count"))
    weights = back.where("low1 IS NOT NULL").unionByName(late).select(
        "batch", "doc", (F.col("n") * F.log10(left / (1 - F.col("lower")))).alias("sum"))
    documents_ = sums.where(F.col("kind") == DOCUMENT)
    total = seen.unionByName(weights).groupBy("batch", "doc").agg(F.sum("sum").alias("rest"))
    return documents_.join(total, ["batch", "doc"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.tokens).cast("bigint").alias("train_tokens"), "base_score",
        (F.col("sum") + F.coalesce("rest", F.lit(0.0))).alias("score"))


def _weighed(weights: np.ndarray) -> Column:
    return sum((F.col(f"low{r}") * float(w) for r, w in enumerate(weights, 1)), F.lit(0.0))


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: the score of every document."""
    return score(table(spark, sf_dir, "documents"))
