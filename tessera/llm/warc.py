"""WARC archives: one gzip member a record, read back in order by incremental decompression.

write_archives packs records into archives of a bounded size, a binary column, so that any store Spark can write
holds them (files named *.warc.gz from elsewhere come through spark.read.format("binaryFile")). read_archives goes through
an archive member by member with zlib's decompressor, holding one record at a time; a record's header ends at the empty
line, its block has Content-Length bytes, and its digests are computed again and compared.

Of records with equal payloads of LEAST bytes or more, the one with the smallest page_id is the response; the others are revisits that
name it and carry the HTTP header alone, whose Content-Length is the full payload's.

Defined results: null html is an empty payload; rows with a null page_id are records without an id and never the one
referred to, if another has the payload; of repeated page_ids with the same payload, one (whichever) is the response; no rows give no
archives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, stored, table

#: Payload bytes from which equal payloads are revisits; bytes in an archive before the next begins; gzip level; parts of a hot digest.
LEAST, ARCHIVE, LEVEL, SALT = 100, 4 << 20, 5, 16
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


class Broken(ValueError):
    """An archive that can't be read: a cut member, a wrong length or a wrong digest."""


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{digest}").urn
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}", f"WARC-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one gzip member each."""
    at, view = 0, memoryview(content)
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise Broken("the archive ends within a member")
            parts.append(inflate.decompress(view[at : at + step]))
            at += min(step, len(view) - at) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record whose length and block digest hold."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        raise Broken("no WARC header")
    head = {k.strip().lower().decode(): v.decode() for k, v in _LINE.findall(raw, raw.index(b"\r\n") + 2, end + 2)}
    n = int(head["content-length"])
    block = raw[end + 4 : end + 4 + n]
    if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
        raise Broken("the block's length is not Content-Length")
    if (want := head.get("warc-block-digest")) and want != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise Broken("the block's digest differs")
    return head, block


def with_duplicates(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to); refers_to is null for responses.

    Digests are counted by partial aggregates; those that repeat, and no others, are what rows are joined with, by digest and salt. Where
    they are too many to be broadcast, rows are dealt with their payloads for it.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.filter(F.length("payload") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).drop("n")
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    p = p.join(first, ["digest", "salt"], "left")
    return p.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content): gzip members of with_duplicates' rows, packed to about ARCHIVE bytes."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_pydict({"archive": [f"{hashlib.sha256(content).hexdigest()[:24]}.warc.gz"], "content": pa.array([content], pa.binary())})

        for b in it:
            for page_id, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                pack_ = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack_.compress(record("response" if refers is None else "revisit", page_id, url, payload, digest, refers)) + pack_.flush()
                held.append(member)
                size += len(member)
                if size >= ARCHIVE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return mapped(pages, pack, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of (…, content): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in it:
            for value in b.column("content"):
                rows, held = [], 0
                for raw in members(value.as_buffer().to_pybytes()):
                    head, block = parse(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise Broken("the payload's length or digest differs")
                    page, refers = head.get("warc-page-id"), head.get("warc-refers-to-page")
                    rows.append((int(page) if page else None, head.get("warc-target-uri"), size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None))
                    held += len(payload)
                    if held > ARCHIVE:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return mapped(archives, read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    pages = with_duplicates(table(spark, sf_dir, "pages"))
    return read_archives(stored(write_archives(pages), "warc")).drop("url", "payload")


OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
