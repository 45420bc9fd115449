"""Quality rules: plain counts of a text, and a linear-chain conditional random field over its lines.

The field marks every line that has a word as content or boilerplate. A line's features are shares and sizes that follow
from its characters, whether it repeats a line of its text, and where it stands; weights of features, of the four
transitions and of both ends are trained together in numpy, by gradient ascent on the likelihood (forward-backward), on a
bounded sample of labelled documents whose features Spark extracts. Viterbi decoding marks the lines of every document, and
the share of words in content lines decides whether it is kept.

Labels are of documents, not of lines. Lines of good documents count as content. Lines of bad ones count as boilerplate at
first, while only the weights of features are trained; what these then take for content line by line, although the document
is bad, is content in the second training, that of the whole field, unless that leaves the document without boilerplate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from webtally.llm.common import steps, table
from webtally.llm.quality import held_out

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Words in repeated windows, of a hundred, beyond which a document fails.
MAX_REPEATED_PERCENT = 50
WINDOW = 3

#: Documents of each label that training takes at most: those whose ids have the smallest hashes.
CLASS_ROWS = 500
#: Training cuts longer sequences into pieces of this many lines; decoding never does.
PIECE_LINES = 64
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
#: A document is kept if at least this share of its words is in content lines.
KEEP_SHARE = 0.5
#: Characters whose lines a worker holds at a time.
SLICE_CHARS = 1 << 20

BOILERPLATE, CONTENT = 0, 1


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(characters)] = 1
    return out


_SPACE = _table(b" \t\n\x0b\x0c\r")
_SYMBOL = _table(SYMBOLS)
_MARK = _table(b"!?")
_DIGIT = _table(b"0123456789")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_STOP = _table(b".!?:;\"')")


def _steps_of(values: np.ndarray, borders: list[float]) -> list[np.ndarray]:
    """One 0/1 column for each border that a value reaches."""
    return [(values >= b).astype(np.float32) for b in borders]


NAMES = [
    "bias", *[f"words>={b}" for b in (2, 4, 8, 16, 32, 64, 128)], *[f"symbols>={b}" for b in (0.02, 0.1, 0.3, 0.6)],
    *[f"upper>={b}" for b in (0.2, 0.4, 0.7)], *[f"marks>={b}" for b in (0.1, 0.5)], *[f"digits>={b}" for b in (0.1, 0.4)],
    "stop at the end", "repeats a line", "repeated later", "first line", "last line", "after a blank line",
    *[f"word length>={b}" for b in (3, 8, 15)],
]


@dataclass
class Slice:
    """Texts of a slice, line by line. Arrays over lines with a word: ``text`` (which text), ``line`` (its number in the
    text), ``words``, ``features``. Arrays over texts: the rest."""

    text: np.ndarray
    line: np.ndarray
    words: np.ndarray
    features: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray


def analysed(texts: list[str]) -> Slice:
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    of = np.searchsorted(text_ends, starts, "right")
    first_line = np.searchsorted(of, np.arange(n))
    space = _SPACE[data]
    inside = 1 - space

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    begins = inside.copy()
    begins[1:] &= space[:-1]
    words = per_line(begins)
    characters = per_line(inside & ((data & 0xC0) != 0x80))
    symbols = per_line(_SYMBOL[data])
    solid = np.flatnonzero(words)

    repeats = np.zeros(len(solid), np.float32)
    later = np.zeros(len(solid), np.float32)
    before: dict[bytes, int] = {}
    own = -1
    whole = data.tobytes()
    for k, i in enumerate(solid.tolist()):
        if of[i] != own:
            own, before = of[i], {}
        line = whole[starts[i] : ends[i]]
        if line in before:
            repeats[k] = later[before[line]] = 1
        before[line] = k

    def total(values: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.bincount(which, values, minlength=n).astype(np.int64)

    w, c, texts_of = words[solid], np.maximum(characters[solid], 1), of[solid]
    letters = np.maximum(per_line(_LETTER[data])[solid], 1)
    seen = np.where(space[:-1], 0, np.arange(1, len(data))) if len(data) > 1 else np.zeros(0, np.int64)
    last = np.maximum.reduceat(np.append(seen, 0), starts)[solid] - 1  # the last character that isn't white space
    firsts = np.concatenate([[True], texts_of[1:] != texts_of[:-1]]) if len(solid) else np.zeros(0, bool)
    finals = np.concatenate([texts_of[1:] != texts_of[:-1], [True]]) if len(solid) else np.zeros(0, bool)
    blank = (solid > 0) & (words[np.maximum(solid - 1, 0)] == 0) & ~firsts
    columns = [
        np.ones(len(solid), np.float32), *_steps_of(w, [2, 4, 8, 16, 32, 64, 128]),
        *_steps_of(symbols[solid] / c, [0.02, 0.1, 0.3, 0.6]),
        *_steps_of(per_line(_UPPER[data])[solid] / letters, [0.2, 0.4, 0.7]),
        *_steps_of(per_line(_MARK[data])[solid] / np.maximum(w, 1), [0.1, 0.5]),
        *_steps_of(per_line(_DIGIT[data])[solid] / c, [0.1, 0.4]),
        _STOP[data[last]].astype(np.float32), repeats, later, firsts.astype(np.float32), finals.astype(np.float32),
        blank.astype(np.float32), *_steps_of(c / np.maximum(w, 1), [3, 8, 15]),
    ]
    return Slice(
        texts_of, solid - first_line[texts_of], w, np.stack(columns, 1), total(words, of), total(characters, of),
        total(symbols, of), total(repeats, texts_of))


def repeated_words(texts: list[str], size: int = WINDOW) -> np.ndarray:
    """For each text, the words that are in a window of ``size`` words found twice or more in the text."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()).cast(pa.large_binary()).cast(pa.large_string()))
    flat, parents = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    kept = pc.not_equal(flat, "")
    coded = flat.filter(kept).dictionary_encode()
    ids, of = coded.indices.to_numpy().astype(np.int64), parents[kept.to_numpy(zero_copy_only=False)].astype(np.int64)
    marked = np.zeros(len(ids), bool)
    count = len(ids) - size + 1
    if count > 0:
        # A window's number: text and first word, then word by word, numbered anew each time so that it stays small.
        kinds, code = len(coded.dictionary), of[:count] * len(coded.dictionary) + ids[:count]
        for k in range(1, size):
            code = np.unique(code, return_inverse=True)[1] * kinds + ids[k : count + k]
        whole = np.flatnonzero(of[:count] == of[size - 1 :])  # windows within one text
        _, which, often = np.unique(code[whole], return_inverse=True, return_counts=True)
        found = whole[often[which] > 1]
        for k in range(size):
            marked[found + k] = True
    return np.bincount(of[marked], minlength=len(texts)).astype(np.int64)


@dataclass
class Model:
    """Log weights: of features towards content, of transitions [from, to], of the first and of the last line."""

    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Score of both states for every line; boilerplate's is the origin."""
        content = features.astype(np.float64) @ self.weights
        return np.stack([np.zeros(len(content)), content], 1)

    def decode(self, features: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """The best states of all lines; lines of a sequence follow each other. Step t handles the t-th line of all
        sequences that have one, longest first, so what is held is two numbers a line."""
        lines = len(features)
        states = np.zeros(lines, np.int8)
        if not lines:
            return states
        score = self.emissions(features)
        begins = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
        sizes = np.diff(np.append(begins, lines))
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        back = np.zeros((lines, 2), np.int8)
        best = score[begins] + self.first
        final = np.zeros((len(begins), 2))
        alive = len(begins)
        for t in range(1, int(sizes[0]) + 1):
            more = int(np.searchsorted(-sizes, -t, "left"))  # sequences longer than t
            final[more:alive] = best[more:alive]
            alive = more
            if not alive:
                break
            at = begins[:alive] + t
            ways = best[:alive, :, None] + self.transitions
            back[at] = ways.argmax(1)
            best = ways.max(1) + score[at]
        now = (final + self.last).argmax(1).astype(np.int8)
        for t in range(int(sizes[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-sizes, -t, "left"))
            at = begins[:alive] + t
            states[at] = now[:alive]
            now[:alive] = back[at, now[:alive]]
        return states


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(model: Model, features: np.ndarray, begins: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
    """Log likelihood of the labels and its gradient, by forward-backward over sequences sorted longest first."""
    score = model.emissions(features)
    longest, n = int(sizes[0]), len(sizes)
    alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest)]  # sequences that have a line t
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    value = score[begins] + model.first
    ahead[begins] = value
    for t in range(1, longest):
        at = begins[: alive[t]] + t
        value = _logsum(value[: alive[t], :, None] + model.transitions, 1) + score[at]
        ahead[at] = value
    finals = begins + sizes - 1
    behind[finals] = model.last
    for t in range(longest - 2, -1, -1):
        on = alive[t + 1]
        at = begins[:on] + t
        behind[at] = _logsum(model.transitions + (score[at + 1] + behind[at + 1])[:, None, :], 2)
    norm = _logsum(ahead[finals] + model.last, 1)
    per_line = np.zeros(len(score))
    order = np.argsort(begins)
    per_line[:] = np.repeat(norm[order], sizes[order])
    share = np.exp(ahead + behind - per_line[:, None])
    joined = np.ones(len(score), bool)
    joined[begins] = False
    at = np.flatnonzero(joined)
    pairs = np.exp(
        ahead[at - 1][:, :, None] + model.transitions + (score[at] + behind[at])[:, None, :] - per_line[at][:, None, None])
    given = np.eye(2)[labels]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    total = (
        score[np.arange(len(score)), labels].sum() + (seen * model.transitions).sum() + model.first[labels[begins]].sum()
        + model.last[labels[finals]].sum() - norm.sum())
    gradient = (
        features.T @ (given[:, 1] - share[:, 1]), seen - pairs.sum(0),
        given[begins].sum(0) - share[begins].sum(0), given[finals].sum(0) - share[finals].sum(0))
    return total / n, [g / n for g in gradient]


def untrained() -> Model:
    """Every line is content."""
    weights = np.zeros(len(NAMES))
    weights[0] = 1
    return Model(weights, np.zeros((2, 2)), np.zeros(2), np.zeros(2))


def train(features: np.ndarray, sequence: np.ndarray, good: np.ndarray) -> Model:
    """Field from the lines of labelled documents (``sequence`` numbers them, ``good`` says which label a line's has)."""
    model = Model(np.zeros(features.shape[1]), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    if not len(features):
        return model
    opens = np.concatenate([[True], sequence[1:] != sequence[:-1]])
    begins = np.flatnonzero(opens)
    nth = np.arange(len(features)) - np.repeat(begins, np.diff(np.append(begins, len(features))))
    pieces = np.flatnonzero(nth % PIECE_LINES == 0)
    sizes = np.diff(np.append(pieces, len(features)))
    order = np.argsort(-sizes, kind="stable")
    pieces, sizes = pieces[order], sizes[order]
    labels = good.astype(np.int64)
    for whole in (False, True):
        parts = [model.weights, model.transitions, model.first, model.last] if whole else [model.weights]
        means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, STEPS + 1):  # gradient ascent with a step size for every weight
            _, gradient = likelihood(model, features, pieces, sizes, labels)
            for p, g, m, s in zip(parts, gradient, means, squares, strict=False):
                g = g - PENALTY * p
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        decoded = model.decode(features, sequence).astype(np.int64)
        clean = np.minimum.reduceat(decoded, begins) == CONTENT  # nothing is left as boilerplate
        decoded[np.repeat(clean, np.diff(np.append(begins, len(features))))] = BOILERPLATE
        labels = np.where(good, CONTENT, decoded)
    return model


FEATURES = "doc_id long, good boolean, features binary"


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Field from labelled documents (1: good, 0: bad) that aren't held out, at most ``CLASS_ROWS`` of each label, those
    with the smallest hash of the id. An id with several labels counts with the smallest, one with several texts with the
    smallest text; null labels and ids are left out. Where a label has no documents nothing can be learnt: every line is
    content. What the training task receives is the lines of at most ``2 * CLASS_ROWS`` documents."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLASS_ROWS) for k in (0, 1)]
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "text", SLICE_CHARS):
            lines = analysed(texts)
            cuts = np.searchsorted(lines.text, np.arange(len(texts) + 1))
            rows = [lines.features[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            good = pc.equal(part.column("label"), 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), good, pa.array(rows, pa.binary())], names=["doc_id", "good", "features"])

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        lines = [np.frombuffer(f, np.float32).reshape(-1, len(NAMES)) for f in rows.column("features").to_pylist()]
        sizes = [len(f) for f in lines]
        good = np.array(rows.column("good").to_pylist(), bool)
        model = untrained()
        if good.any() and not good.all():
            model = train(np.concatenate(lines), np.repeat(np.arange(len(lines)), sizes), np.repeat(good, sizes))
        return pa.table({k: [v.ravel().tolist()] for k, v in vars(model).items()})

    learnt = sample.mapInArrow(extract, FEATURES).groupBy().applyInArrow(
        learn, "weights array<double>, transitions array<double>, first array<double>, last array<double>").collect()
    if not learnt:
        return untrained()
    row = learnt[0]
    return Model(
        np.array(row["weights"]), np.array(row["transitions"]).reshape(2, 2), np.array(row["first"]), np.array(row["last"]))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [
    *[(c, T.LongType()) for c in COUNTS], ("content_share", T.DoubleType()),
    ("boilerplate_lines", T.ArrayType(T.LongType())),
]


def assess(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``df`` with the counts of its texts, ``content_share`` (words in content lines over all words; null without
    words) and ``boilerplate_lines`` (numbers of the lines marked as boilerplate, from 0, ascending).

    Words are parted by the ASCII white space, lines by newlines; lines without a word have no mark. Null and empty texts
    have no words. Whole texts are read, a slice of a batch, or one longer text, at a time; repeated rows and equal texts
    get equal results; columns of ``df`` named like an output are replaced, others stay; an empty table stays empty. No
    shuffle."""
    names = {n for n, _ in ADDED}
    kept = [f for f in df.schema if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in ADDED)])
    given = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias("_text_"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text_", SLICE_CHARS):
            lines = analysed(texts)
            states = model.decode(lines.features, lines.text)
            content = np.bincount(lines.text, lines.words * (states == CONTENT), minlength=len(texts))
            share = pa.array(content / np.maximum(lines.n_words, 1), mask=lines.n_words == 0)
            bad = states == BOILERPLATE
            ends = np.concatenate([[0], np.cumsum(np.bincount(lines.text[bad], minlength=len(texts)))])
            marked = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lines.line[bad], pa.int64()))
            counts = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, repeated_words(texts)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in kept), *map(pa.array, counts), share, marked], names=schema.names)

    return given.mapInArrow(run, schema)


def base_failed() -> Column:
    """The plain rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def kept() -> Column:
    return ~base_failed() & (F.coalesce(F.col("content_share"), F.lit(0.0)) >= KEEP_SHARE)


def op13(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    assessed = assess(documents, fit(documents, table(spark, sf_dir, "labels")))
    return assessed.select("doc_id", *COUNTS, base_failed().alias("base_failed"), kept().alias("kept"), "content_share")
