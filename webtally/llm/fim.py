"""Fill-in-the-middle transformation of documents, in ``pyarrow.compute`` over Arrow slices.

A text is split into units (runs of the letters A to Z and a to z, any other character alone). The units of a slice are one
list array; flattened, each unit knows its parent and so its ordinal in its text, and two cuts per text give it a role:
prefix, middle or suffix. The units of a role are filtered out, built into lists again and joined to one piece per text, and
the pieces are joined with their marks. Nothing is done unit by unit in Python.

All of it works on UTF-8 bytes, as one byte that no UTF-8 text holds can then part the units."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from webtally.llm.common import steps, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many keep their text as it is; of a hundred others, so many get the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

#: A unit in bytes: letters, another ASCII character, or the bytes of one further character.
_UNIT = r"([A-Za-z]+|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
_END = b"\xff"


def draws(key: Column) -> list[Column]:
    """Four numbers below 2^32 that follow from ``key`` alone; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text (binary), as a list array."""
    ended = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=b"\\1" + _END)
    lists = pc.split_pattern(ended, pattern=_END)  # one empty piece after each text's last unit
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.flatten()
    kept = np.ones(len(values), bool)
    kept[offsets[1:] - 1] = False
    return pa.ListArray.from_arrays(
        pa.array(offsets - np.arange(len(offsets)), pa.int32()), values.filter(pa.array(kept)))


def cut(lists: pa.ListArray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: the units before ``first``, up to ``second``, and the rest."""
    parents = pc.list_parent_indices(lists).to_numpy()
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    ordinals = np.arange(len(flat)) - (starts[:-1] - starts[0])[parents]
    roles = (ordinals >= first[parents]).astype(np.int8) + (ordinals >= second[parents])
    counts = np.diff(starts)
    pieces = []
    for role, size in enumerate((first, second - first, counts - second)):
        own = flat.filter(pa.array(roles == role))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        pieces.append(pc.binary_join(pa.ListArray.from_arrays(ends, own), b""))
    return pieces


def _join(*parts: pa.Array | str) -> pa.Array:
    whole = [pa.scalar(p.encode()) if isinstance(p, str) else p for p in parts]
    return pc.binary_join_element_wise(*whole, pa.scalar(b""))


def _characters(pieces: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_length(pieces.cast(pa.string())), pa.int64())


def _arranged(texts: pa.Array, draw: list[np.ndarray]) -> list[pa.Array]:
    """n_units, form, prefix_chars, middle_chars and output of a slice."""
    lists = units(texts)
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    one, two = draw[0] % (n + 1), draw[1] % (n + 1)
    prefix, middle, suffix = cut(lists, np.minimum(one, two), np.maximum(one, two))
    marked = [pc.match_substring(texts, m.encode()).to_numpy(zero_copy_only=False) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (n == 0) | np.logical_or.reduce(marked) | (draw[2] % 100 >= 100 - PLAIN_PERCENT)
    spm = pa.array(draw[3] % 100 < SPM_PERCENT)
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(spm, "spm", "psm"))
    moved = pc.if_else(
        spm, _join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), _join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    none = pa.nulls(len(texts), pa.int64())
    return [
        pa.array(n), form, pc.if_else(pa.array(plain), none, _characters(prefix)),
        pc.if_else(pa.array(plain), none, _characters(middle)), pc.if_else(pa.array(plain), texts, moved).cast(pa.string()),
    ]


FIELDS = [
    ("n_units", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
    ("output", T.StringType()),
]


def _with(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> tuple[list[str], T.StructType]:
    names = {f for f, _ in fields}
    kept = [f for f in df.schema if f.name not in names]
    return [f.name for f in kept], T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)])


def transform(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with ``n_units``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    The cuts and the form follow from ``key`` alone, so a lost task gives the same rows again and repeated rows are
    treated alike. Null and empty texts, and texts that hold one of the marks, stay plain; plain rows have no lengths of
    prefix and middle. A null key counts as an empty one. Very long texts are cut whole: a slice of a batch, or one text
    if it is longer, is in memory at a time. Columns of ``df`` named like an output are replaced, others stay; an empty
    table stays empty. No shuffle."""
    kept, schema = _with(df, FIELDS)
    helpers = [f"_draw{k}_" for k in range(4)]
    drawn = df.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("_text_"),
        *[d.alias(h) for d, h in zip(draws(F.col(f"`{key}`")), helpers, strict=True)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text_"):
            done = _arranged(
                pa.array([t.encode() for t in texts], pa.binary()), [part.column(h).to_numpy() for h in helpers])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *done], names=schema.names)

    return drawn.mapInArrow(run, schema)


def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """Texts from outputs: each mark occurs once in an output that isn't plain, as its text holds none."""

    def split(values: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
        """What comes before and after ``mark``; rows without it, which another form has, give themselves and nothing."""
        lists = pc.split_pattern(values, pattern=mark.encode(), max_splits=1)
        found = pc.greater(pc.list_value_length(lists), 1)
        ends = lists.offsets.to_numpy()
        flat = lists.flatten()
        return flat.take(pa.array(ends[:-1])), pc.if_else(found, flat.take(pa.array(ends[1:] - 1)), b"")

    before, middle = split(outputs, MIDDLE)
    # psm: <P> prefix <S> suffix; spm: <S> suffix <P> prefix
    psm_prefix, psm_suffix = split(split(before, PREFIX)[1], SUFFIX)
    spm_suffix, spm_prefix = split(split(before, SUFFIX)[1], PREFIX)
    psm = _join(psm_prefix, middle, psm_suffix)
    spm = _join(spm_prefix, middle, spm_suffix)
    return pc.if_else(pc.equal(forms, "plain"), outputs, pc.if_else(pc.equal(forms, "spm"), spm, psm))


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``df`` with ``restored``: the exact text, rebuilt from the columns ``output`` and ``form`` alone. Null outputs
    give an empty text, a null form counts as plain; otherwise as ``transform``."""
    kept, schema = _with(df, [("restored", T.StringType())])
    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{output}`").alias("_text_"),
                      F.coalesce(F.col(f"`{form}`"), F.lit("plain")).alias("_form_"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text_"):
            done = _restored(pa.array([t.encode() for t in texts], pa.binary()), part.column("_form_").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), done.cast(pa.string())], names=schema.names)

    return given.mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of every document's transformed text and of the text restored from it."""
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return restore(done).select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::varchar, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::bigint % (len(u) + 1) AS one, ('0x' || h[9:16])::bigint % (len(u) + 1) AS two,
         ('0x' || h[17:24])::bigint % 100 AS three, ('0x' || h[25:32])::bigint % 100 AS four
  FROM cut
), parts AS (
  SELECT doc_id, t, n,
         CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                   OR three >= {100 - PLAIN_PERCENT} THEN 'plain' WHEN four < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(one, two)], '') AS p,
         array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
         array_to_string(u[greatest(one, two) + 1:n], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m)
              ELSE concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
