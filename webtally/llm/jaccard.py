"""Near-duplicate texts: all pairs whose sets of word n-grams have a Jaccard similarity from a threshold on.

Texts with equal words are one text with a weight. A text's MinHash signature is cut into bands; as many as give a pair at
the threshold the wished chance to agree in one. Texts that agree in a band hash are linked to the least of them, and the
components of these links are the candidates: all pairs in a component, so no more than the bands miss can be missed.
Pairs are verified on full n-gram sets in blocks: a component that is too large for one task is cut into parts, texts with
equal band hashes side by side, and two parts meet in a task of their own if they have a band hash in common. Within a
part every text is connected with the least text it is linked to, its root; where parts meet, roots stand for their texts.
What leaves a task is a row for each text, with its links, and one for each root that is connected with another one there,
never a row for each pair."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from webtally.llm.common import numbered, steps, stored, table

WORDS, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold agrees in a band, and hashes in a band.
RECALL, BAND_ROWS = 0.9995, 5
#: Texts and characters of a part of a component, and texts of small components that one task verifies, about.
PART_ROWS, PART_CHARS, BIN_ROWS = 2048, 8 << 20, 512
#: Characters whose signatures a worker computes at a time, and words it remembers during a task.
SLICE_CHARS, REMEMBERED = 1 << 20, 200_000
SEED = 5

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def raw_hash() -> Column:
    """Hash of a text as it is."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("raw")


class _Hashes(dict):
    """Word hashes, kept up to a number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, known: _Hashes) -> np.ndarray:
    """Of lower-case words between white space."""
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of ``n`` words; of fewer words the one run they make."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ words[k : len(words) - n + 1 + k]) * _STEP
            h ^= h >> np.uint64(29)
    return np.unique(h)


def signatures(documents: DataFrame, threshold: float) -> DataFrame:
    """doc_id, raw (hash of the text), key (hash of the words, null without words) and the band hashes."""
    bands = bands_for(threshold)
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**63, bands * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**64, bands * BAND_ROWS, np.uint64)

    def signature(grams: np.ndarray) -> np.ndarray:
        least = np.full(bands * BAND_ROWS, 2**64 - 1, np.uint64)
        x = grams >> np.uint64(32)
        for a in range(0, len(x), 512):
            least = np.minimum(least, (x[a : a + 512, None] * factors + shifts).min(axis=0))
        band = np.arange(bands, dtype=np.uint64)
        for row in (least >> np.uint64(16)).reshape(bands, BAND_ROWS).T:
            band = (band ^ row) * _STEP
            band ^= band >> np.uint64(31)
        return band.astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part, texts in steps(batches, "text", SLICE_CHARS):
            keys, rows = [], []
            for text in texts:
                words = word_hashes(text, known)
                keys.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
                rows.append(signature(shingles(words)) if len(words) else None)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("raw"),
                pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64())),
            ], names=["doc_id", "raw", "key", "bands"])

    return documents.select("doc_id", "text", raw_hash()).mapInArrow(run, "doc_id long, raw binary, key binary, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b) between binary ids: every id and the least id of its component, by spreading the least label over
    links and then jumping from a label to that label's own, until nothing changes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("jumped"))
        spread = stored(spread.join(jump, "label").select("a", "old", F.least("label", "jumped").alias("label")), "labels")
        labels = spread.select("a", "label")
        if spread.where("old != label").isEmpty():
            return labels


def _verify(texts: pd.DataFrame, known: _Hashes, threshold: float) -> pd.DataFrame:
    """Links among texts (key, root, part, other, weight, text): with those of the other part where parts meet, else of the
    same part. Rows (a, b, links): a text and its links, itself as b; where roots are connected, one and the least of
    them."""
    sets = [shingles(word_hashes(t, known)) for t in texts["text"]]
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    part = texts["part"].to_numpy()[order]
    weight = texts["weight"].to_numpy()[order]
    across = bool((texts["part"] != texts["other"]).any())
    links = np.zeros(len(sets), np.int64)
    roots = texts["root"].to_numpy()[order]
    least: dict[bytes, int] = {}
    root = np.array([least.setdefault(r, i) for i, r in enumerate(roots)])  # texts of a root are connected
    has = np.zeros(int(flat.max()) + 1, bool)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(sets) - 1):
        stop = np.searchsorted(sizes, sizes[i] / threshold + 1e-9, "right")
        if stop <= i + 1:
            continue
        own = flat[starts[i] : ends[i]]
        has[own] = True
        shared = np.add.reduceat(has[flat[ends[i] : ends[stop - 1]]].astype(np.int32), starts[i + 1 : stop] - ends[i])
        has[own] = False
        similar = shared >= threshold * (sizes[i] + sizes[i + 1 : stop] - shared) - 1e-9
        if across:
            similar &= part[i + 1 : stop] != part[i]
        found = i + 1 + np.flatnonzero(similar)
        links[i] += weight[found].sum()
        links[found] += weight[i]
        for j in np.unique(root[found]).tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    keys = texts["key"].to_numpy()[order]
    if not across:
        return pd.DataFrame({"a": keys, "b": [keys[top(i)] for i in range(len(sets))], "links": links})
    counted = pd.DataFrame({"a": keys, "b": keys, "links": links})[links > 0]
    joined = sorted({(roots[i], roots[top(i)]) for i in range(len(sets)) if roots[i] != roots[top(i)]})
    return pd.concat([counted, pd.DataFrame({"a": [a for a, _ in joined], "b": [b for _, b in joined], "links": 0})])


def classes(
    documents: DataFrame, threshold: float = THRESHOLD, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS,
) -> DataFrame:
    """doc_id, raw (hash of the text), class_id and n_links of every row of ``documents`` (doc_id, text, ...).

    Linked are rows whose sets of ``WORDS``-word n-grams have a Jaccard similarity of ``threshold`` or more; n_links counts
    the other rows a row is linked with, copies included; a class is a component of links, named by its smallest doc_id
    (null if all are). Texts of fewer words have the one n-gram they make. Texts without words, null ones included, are
    linked with nothing and are each a class of their own; so is a text that is like no other. Repeated rows count each.
    Very long texts are compared whole. Other columns are left out; an empty table gives an empty table. A part has at
    most ``part_rows`` texts and, but for one text, ``part_chars`` characters."""
    rows = stored(signatures(documents, threshold), "signatures")
    texts = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.count("*").alias("weight"), F.min("doc_id").alias("least_id"), F.min(F.struct("raw", "doc_id")).alias("at"), F.first("bands").alias("bands"))
    texts = stored(texts, "texts")
    banded = texts.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    shared = stored(shared, "bands")  # so that adaptive execution can split a common band in the join
    # A text links the least it agrees with to the others and to itself: as connected as the text's link to each of them, but
    # these are few texts, the least of some band, where a large group has many texts with many bands.
    least = banded.join(shared, "band").groupBy("key").agg(F.collect_set("b").alias("found"))
    least = least.select(F.array_min("found").alias("b"), F.explode(F.array_union("found", F.array("key"))).alias("a"))
    groups = components(least.where("a != b").distinct()).withColumnRenamed("a", "key")
    kept = texts.join(groups, "key").select(
        "key", "weight", "label", "bands", "at.raw", F.coalesce("at.doc_id", F.lit(-1)).alias("id"))
    named = documents.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "text", raw_hash())
    named = named.join(kept, ["raw", "id"]).groupBy("key", "weight", "label").agg(
        F.min("text").alias("text"), F.first("bands").alias("bands"))
    size = f"greatest({part_chars // part_rows}, length(text))"
    named = stored(named.withColumn("size", F.expr(size).cast("bigint")), "candidates")
    bins = max(1, named.count() // BIN_ROWS)
    sized = named.groupBy("label").agg((F.sum("size") > part_chars).alias("large"))
    named = named.join(sized, "label")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        known = _Hashes()
        return pd.concat([_verify(own, known, threshold) for _, own in frame.groupby("label")])

    def verified(dealt: DataFrame) -> DataFrame:
        columns = ["unit", "label", "key", "root", "part", "other", "weight", "text"]
        return dealt.select(*columns).groupBy("unit").applyInPandas(verify, "a binary, b binary, links long")

    # Small components share units; a large one is cut into parts, neighbours in the order of their band hashes.
    small = named.where("NOT large").withColumn("unit", F.expr(f"concat('bin ', pmod(xxhash64(label), {bins}))")).withColumn("part", F.lit(0))
    placed = numbered(named.where("large").select("label", "key", "bands", "size"), "label", ["bands", "key"], "place", "size")
    placed = stored(placed.select("label", "key", "bands", F.expr(f"cast(place div {part_chars} as int)").alias("part")), "parts")
    large = named.where("large").select("label", "key", "weight", "text").join(placed.select("key", "part"), "key")
    within = small.select("unit", "label", "key", "part", "weight", "text").unionByName(
        large.select(F.concat_ws(" ", F.hex("label"), "part").alias("unit"), "label", "key", "part", "weight", "text"))
    within = stored(verified(within.withColumn("other", F.col("part")).withColumn("root", F.col("key"))), "within")
    # Two parts meet if a band hash occurs in both; a text stands for the texts it is connected with in its part.
    spread = placed.select("label", "part", F.explode("bands").alias("band")).distinct()
    spread = spread.groupBy("label", "band").agg(F.collect_list("part").alias("others")).where("size(others) > 1")
    meet = spread.withColumn("part", F.explode("others")).withColumn("other", F.explode("others")).where("part != other")
    meet = meet.select("label", "part", "other").distinct().groupBy("label", "part").agg(F.collect_list("other").alias("others"))
    rooted = large.join(within.select(F.col("a").alias("key"), F.col("b").alias("root")), "key")
    dealt = rooted.join(meet, ["label", "part"]).withColumn("other", F.explode("others")).withColumn(
        "unit", F.concat_ws(" ", F.hex("label"), F.least("part", "other"), F.greatest("part", "other")))
    across = stored(verified(dealt), "across")
    met = within.unionByName(across)
    linked = met.where("links > 0").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    whole = components(met.where("a != b")).withColumnRenamed("a", "key")
    of_texts = texts.select("key", "weight", "least_id").join(linked, "key", "left").join(whole, "key", "left").withColumn(
        "label", F.coalesce("label", "key"))
    least = of_texts.groupBy("label").agg(F.min("least_id").alias("class_id"))
    of_texts = of_texts.join(least, "label").select(
        "key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    of_texts = stored(of_texts, "classes")  # as above, for common texts
    return rows.drop("bands").join(of_texts, "key", "left").select(
        "doc_id", "raw", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def op2(spark, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest doc_id of each class. Rows that repeat doc_id and text are one
    document and stay or go alike; rows without an id stay."""
    gone = classes(docs).where("doc_id != class_id").select("doc_id", "raw").distinct()
    return docs.withColumn("raw", raw_hash()).join(gone, ["doc_id", "raw"], "left_anti").select(*docs.columns)
