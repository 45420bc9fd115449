"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

A text whose white space is single spaces and runs of newlines, never side by side, is cut before every space. No match
of the splitting pattern crosses such a place, and its one lookahead sees the same next character on both sides of the
cut, so encoding chunk by chunk gives the ids of the whole text; any other text is encoded in one piece. Arrow finds the
distinct chunks of a slice, and each task keeps a bounded dictionary of chunks already encoded."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from webtally.llm.common import steps

#: Texts with white space other than single spaces and runs of newlines, or with these side by side.
ODD_SPACE = (
    r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |^ | $"
)
#: Chunks that a worker remembers during a task; about 60 MB.
REMEMBERED = 400_000
#: Characters that a worker encodes at a time.
SLICE_CHARS = 2 << 20
#: Chunks encoded by one call of the library.
TOGETHER = 256


@functools.cache
def byte_table() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves,
    the others for characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def from_ranks(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A ``tokenizers`` model that merges by rank: a pair merges if its joined bytes have a rank, lowest rank first. So
    every way to split a token into two tokens is a merge rule, in the order of the joined token's rank."""
    table = byte_table()

    def name(token: bytes) -> str:
        return "".join(table[b] for b in token)

    merges = [
        (name(token[:i]), name(token[i:]))
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(False, use_regex=False),
    ])
    return tokenizer


@functools.lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; special tokens, which have no bytes of a text, are written as their names. This is all that
    decoding needs."""
    if path.endswith(".json"):
        back = {c: b for b, c in enumerate(byte_table())}
        named = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        ranks = {bytes(back[c] for c in t) if all(c in back for c in t) else t.encode(): i for t, i in named.items()}
    else:
        ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def joined(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _strings(array: pa.StringArray) -> list[str]:
    """The values of an array none of which has a space, faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(array)], array), " ")[0].as_py().split(" ")


def _spread(
    flat: np.ndarray, sizes: np.ndarray, which: np.ndarray, room: np.ndarray | int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, whose lengths are ``sizes``, in the order ``which``, and their lengths; ``room`` is 1 where the
    run gets a free place at its end."""
    starts = np.cumsum(sizes) - sizes
    own = sizes[which]
    long = own + room
    stops = np.cumsum(long)
    at = np.repeat(starts[which] - stops + long, long) + np.arange(stops[-1])
    return flat[np.minimum(at, len(flat) - 1)], long


class Codec:
    """Encodes texts to packed ids (little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
        else:
            self.tokenizer = from_ranks(read_ranks(path), public_tokenizers.PATTERN)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.tokens = token_bytes(path)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encoded]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Many chunks, all of which begin with a space, in one text; the bytes of the ids tell where each ends."""
        found = []
        sizes = pc.binary_length(pa.array(chunks, pa.string())).to_numpy()
        groups = ["".join(chunks[i : i + TOGETHER]) for i in range(0, len(chunks), TOGETHER)]
        for i, ids in enumerate(self._encode(groups)):
            ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
            bounds = np.cumsum(sizes[TOGETHER * i : TOGETHER * (i + 1)])
            cuts = (4 * (1 + np.searchsorted(ends, bounds))).tolist()
            found += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return found

    def _ids_of(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks that follow a space, all in a row, and how many each has. A comma or stop after a letter is a
        match of its own, so it is left to the end: words repeat more often without."""
        ends_in = pc.match_substring_regex(chunks, r"\pL[,.]$")
        bare = pc.if_else(ends_in, pc.utf8_slice_codeunits(chunks, 0, -1), chunks).dictionary_encode()
        words = _strings(bare.dictionary)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        self.known.update(zip(new, self._encode_chunks([f" {w}" for w in new]), strict=True))
        ids = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        marked = ends_in.to_numpy(zero_copy_only=False)
        which = bare.indices.to_numpy().astype(np.int64)
        flat, counts = _spread(np.frombuffer(b"".join(ids), "<u4"), sizes, which, marked)
        places = np.cumsum(counts)[marked] - 1
        comma = pc.ends_with(chunks, ",").to_numpy(zero_copy_only=False)[marked]
        marks = [np.frombuffer(i, "<u4")[0] for i in self._encode([",", "."])]
        flat[places] = np.where(comma, *marks)
        return flat, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        array = pa.array(texts, pa.string())
        odd = pc.or_(pc.equal(array, ""), pc.match_substring_regex(array, ODD_SPACE)).to_numpy(zero_copy_only=False)
        whole = iter(self._encode([texts[i] for i in np.flatnonzero(odd)]))
        if not odd.all():
            lists = pc.split_pattern(array.filter(pa.array(~odd)), " ")
            coded = lists.flatten().dictionary_encode()
            ends = lists.offsets.to_numpy()
            which = coded.indices.to_numpy().astype(np.int64)
            parts = coded.dictionary
            flat, sizes = self._ids_of(parts)
            first = self._encode(_strings(parts.take(pa.array(which[ends[:-1]]))))
            which[ends[:-1]] = len(parts) + np.arange(len(first))  # a text's first chunk has no space before it
            flat = np.concatenate([flat, np.frombuffer(b"".join(first), "<u4")])
            sizes = np.concatenate([sizes, np.array([len(i) // 4 for i in first], np.int64)])
            flat, own = _spread(flat, sizes, which)
            bounds = np.concatenate([[0], np.cumsum(own)])[ends].tolist()
            spread = (flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True))
        return [next(whole) if o else next(spread) for o in odd.tolist()]

    def decode(self, ids: bytes) -> bytes:
        return joined(self.tokens, ids)

    def forget(self) -> None:
        """Lets go of the chunks, as a worker outlives its tasks and other operators need its memory."""
        self.known.clear()
        pa.default_memory_pool().release_unused()

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the character after its last one. A character whose bytes are split over
        several tokens belongs to each of them."""
        pieces = [self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if not len(data):
            return starts[:0], starts[:0]
        return character[starts], character[ends - 1] + 1


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One per worker and vocabulary, kept between tasks without its chunks; Spark, not the library, spreads the work over the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path)


def _plus(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    names = {f for f, _ in fields}
    return T.StructType([f for f in df.schema if f.name not in names] + [T.StructField(f, t) for f, t in fields])


def encode(df: DataFrame, path: str, column: str = "text", with_offsets: bool = True) -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit numbers) of ``column`` and, if asked for,
    ``token_starts`` and ``token_ends`` (arrays of character offsets).

    Null and empty texts: no ids. Very long texts are encoded whole. Every row is encoded by itself, so repeated rows,
    ties and nulls in other columns make no difference. A column of ``df`` named like an output is replaced; other
    columns stay. An empty table gives an empty table. No shuffle; memory is bounded by a slice of a batch."""
    extra = [("token_starts", T.ArrayType(T.IntegerType())), ("token_ends", T.ArrayType(T.IntegerType()))] if with_offsets else []
    schema = _plus(df, ("ids", T.BinaryType()), *extra)
    kept = [f.name for f in schema][: len(schema) - 1 - len(extra)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in steps(batches, column, SLICE_CHARS):
            ids = own.encode(texts)
            arrays = [part.column(k) for k in kept] + [pa.array(ids, pa.binary())]
            if with_offsets:
                pairs = [own.offsets(i) for i in ids]
                arrays += [pa.array([p[k].astype(np.int32) for p in pairs], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])
        own.forget()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes that the packed ids of ``column`` stand for. Ids that end within a
    character give the bytes as they are; ``F.col("decoded").cast("string")`` is the text of whole ones. Null: no bytes."""
    schema = _plus(df, ("decoded", T.BinaryType()))
    kept = [f.name for f in schema][:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                bytes_ = [joined(tokens, i.as_py() or b"") for i in part.column(column)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in kept] + [pa.array(bytes_, pa.binary())], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of the ids of every document and of the bytes decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode(documents, path, with_offsets=False).select("doc_id", "ids")
    return decode(encoded, path).select(
        "doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
