"""Deterministic sharded WARC archives.

Pages are range-sorted by page_id, payload digest and url into shards whose borders follow from the data alone: every
record's shard is what the records before it weigh, a running total over sampled ranges of their keys without the
payloads, divided by a shard's size. A task writes its shards as gzip members, rolls files by
compressed size under temporary names, renames them and hands back their manifest. Bytes depend on the rows only (fixed
gzip header, dates and record ids derived from the page), so a repeated or speculative task puts the same files in the
same places. The manifest of all files is written last; a folder without it isn't an archive."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webtally.llm.common import numbered, stored, table
from webtally.sources.writers import new_folder

#: Smaller payloads are never revisits.
REVISIT_BYTES = 1000
#: Payload bytes of a shard and compressed bytes of a file, about.
SHARD_BYTES, FILE_BYTES = 16 << 20, 4 << 20
MANIFEST = "manifest.parquet"
#: All records bear this date, as the pages have none.
DATE = "2020-01-01T00:00:00Z"


def placed(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Where distinct rows (page_id, url, payload) of ``pages`` go: key (of the row), page_id, digest, refers_to, n (equal
    rows), size (about, of one), before (what all rows sorted before them weigh).

    Of records with equal payloads of at least ``revisit_bytes`` the one with the largest page_id is the response and the
    others refer to it. Rows that repeat a page_id and payload are all responses then, as they refer to nothing else; a
    null page_id refers to the largest other one and is referred to by none."""
    rows = keyed(pages).select("key", "page_id", "url", "digest", F.length("payload").alias("length"))
    names = ["key", "page_id", "url", "digest", "length"]
    rows = stored(rows.groupBy(*names).agg(F.count("*").alias("n")), "keys")
    large = rows.where(F.col("length") >= revisit_bytes)
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.sum("n").alias("times")).where("times > 1").drop("times")
    last = stored(last, "repeated")  # so that adaptive execution can split a common payload in the join
    found = rows.join(last, "digest", "left")
    earlier = F.col("last").isNotNull() & F.coalesce(F.col("page_id") < F.col("last"), F.lit(True))
    found = found.select(*names, "n", F.when(earlier, F.col("last")).alias("refers_to"), (F.col("length") + 400).alias("size"), F.lit(0).alias("all"))
    ordered = numbered(found, "all", ["page_id", "digest", "url"], "before", "n * size")
    return ordered.select("key", "page_id", "digest", "refers_to", "n", "size", "before")


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null html: empty), digest and a key that equal rows share."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    text = F.concat("digest", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.concat(F.lit("="), "url"), F.lit("-")))
    return rows.withColumn("key", F.unhex(F.sha2(text, 256)))


def planned(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) as records to write: shard, page_id, url, digest, refers_to, length (of the payload),
    member (the response record; null for revisits), copies (equal rows of the shard, which are one row here).

    A shard is ``shard_bytes`` of all records in their order, so an id, a null one too, may hold any share of them, and
    equal rows are dealt out by arithmetic. Shard numbers follow from the rows alone; very long records leave gaps. Records
    are compressed before they are shuffled: by key to meet their places, and by shard."""
    places = stored(placed(pages), "places").drop("page_id", "digest")
    step = F.lit(shard_bytes).cast("bigint")
    spans = F.sequence(F.expr(f"before div {shard_bytes}"), F.expr(f"(before + (n - 1) * size) div {shard_bytes}"))
    members = keyed(pages).mapInArrow(_members, "key binary, page_id long, url string, digest string, length long, member binary")
    dealt = members.dropDuplicates(["key"]).join(places, "key").withColumn("shard", F.explode(spans))

    def first(shard: Column) -> Column:
        """Number of the first of equal rows that begins in ``shard`` or later."""
        return F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((shard * step - F.col("before")) / F.col("size"))))

    copies = first(F.col("shard") + 1) - first(F.col("shard"))
    return dealt.withColumn("copies", copies).where("copies > 0").select(
        F.col("shard").cast("int"), "page_id", "url", "digest", "refers_to", "length",
        F.when(F.col("refers_to").isNull(), F.col("member")).alias("member"), "copies")


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, ids, urls, payloads, digests = (batch.column(c) for c in ("key", "page_id", "url", "payload", "digest"))
        for a in range(0, batch.num_rows, 256):
            own = [c.slice(a, 256) for c in (ids, urls, payloads, digests)]
            values = [(i.as_py(), u.as_py(), p.as_py(), d.as_py()) for i, u, p, d in zip(*own, strict=True)]
            yield pa.RecordBatch.from_arrays([
                key.slice(a, 256).cast(pa.binary()), own[0].cast(pa.int64()), own[1].cast(pa.string()), own[3].cast(pa.string()), pa.array([len(p) for _, _, p, _ in values], pa.int64()),
                pa.array([record(i, u, p, d, None, len(p)) for i, u, p, d in values], pa.binary())],
                names=["key", "page_id", "url", "digest", "length", "member"])


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id, url, block: bytes, digest: str, refers_to, length: int) -> bytes:
    """One record as a gzip member. A revisit has no block; its headers give what it refers to and its payload's ``length``."""
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": _base32(digest),
        "WARC-Block-Digest": _base32(hashlib.sha1(block).hexdigest()), "X-Payload-Length": length,
    }
    if refers_to is not None:
        headers["WARC-Refers-To"] = _urn(refers_to)
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    headers |= {"Content-Type": "text/html", "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without name and time
    return press.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + press.flush()


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes an archive of ``pages`` to ``folder``, a URI that all executors reach, and returns its manifest: file, shard,
    records, bytes, sha1.

    Pages with a null id come first. An empty table gives an archive without files. Very long pages make a file of their
    own at worst. Other columns are left out. For nulls and repeated rows see ``placed``."""
    spark = pages.sparkSession
    records = planned(pages, shard_bytes)
    target = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    target = target.replace("file:/", "file:///", 1) if target.startswith("file:/") and not target.startswith("file://") else target

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        attempt = uuid.uuid4().hex
        store.create_dir(f"{root}/_temporary", recursive=True)
        shard = roll = None
        size = 0
        parts: list[bytes] = []

        def rolled() -> pa.RecordBatch:
            data = b"".join(parts)
            name = f"shard-{shard:06d}-{roll:05d}.warc.gz"
            own = f"{root}/_temporary/{attempt}-{name}"
            with store.open_output_stream(own, compression=None) as out:
                out.write(data)
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([
                pa.array([name]), pa.array([shard], pa.int32()), pa.array([len(parts)]), pa.array([len(data)]),
                pa.array([hashlib.sha1(data).hexdigest()])], names=["file", "shard", "records", "bytes", "sha1"])
            parts.clear()
            return row

        for batch in batches:
            for own_shard, page_id, url, digest, refers_to, length, member, copies in zip(
                    *(column.to_pylist() for column in batch.columns), strict=True):
                member = member if refers_to is None else record(page_id, url, b"", digest, refers_to, length)
                for _ in range(copies):
                    if own_shard != shard or size >= file_bytes:
                        if parts:
                            yield rolled()
                        roll = roll + 1 if own_shard == shard else 0
                        shard, size = own_shard, 0
                    parts.append(member)
                    size += len(member)
        if parts:
            yield rolled()

    dealt = records.repartitionByRange("shard").sortWithinPartitions("shard", "page_id", "digest", "url")
    manifest = dealt.mapInArrow(
        run, "file string, shard int, records long, bytes long, sha1 string")
    manifest.write.parquet(f"{folder}/{MANIFEST}")  # committed when all shards are in place
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes,
    payload_digest (lower-case hex). Only files of the manifest are read; one that is missing is an error, a file or
    payload that doesn't match its digest is one, and so is a folder without a manifest."""
    manifest = spark.read.parquet(f"{folder}/{MANIFEST}").select("file", "sha1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    missing = manifest.join(files.select("file"), "file", "left_anti")  # by names, so that no content is moved
    files = files.join(manifest, "file").unionByName(missing.withColumn("content", F.lit(None).cast("binary")))
    fields = ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")

    def number(urn: str | None):
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def parse(content: bytes) -> Iterator[tuple]:
        while content:
            member = zlib.decompressobj(31)
            data = member.decompress(content)
            content = member.unused_data
            head, _, body = data.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = body[: int(headers["Content-Length"])]
            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            kind = headers["WARC-Type"]
            if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
            yield (
                number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, number(headers.get("WARC-Refers-To")),
                block if kind == "response" else None, int(headers["X-Payload-Length"]), digest)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content, sha1 in zip(frame["file"], frame["content"], frame["sha1"], strict=True):
                if content is None:
                    raise ValueError(f"{name} of the manifest is missing")
                if hashlib.sha1(content).hexdigest() != sha1:
                    raise ValueError(f"{name} doesn't match the manifest")
                rows = pd.DataFrame(list(parse(content)), columns=list(fields), dtype=object)
                yield rows

    return files.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload binary, "
                                  "payload_bytes long, payload_digest string")


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: writes all pages and returns what the archives say."""
    folder = new_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), l AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM l
"""
