"""Zstandard WARC archives: writing them and reading them back.

An archive is a skippable frame that holds a dictionary, then one Zstandard
frame per record, with an empty skippable frame between records, which readers
skip. Each archive's dictionary is trained on its first records, a bounded
sample, so an archive is complete in itself. A task starts another archive when
one has reached ARCHIVE_BYTES, so archives hold that and one record more at
most, however the rows are dealt out. Each is a row of Spark's text sink and a
file of its own in any store that Spark writes, committed by Spark's committer:
a lost task leaves nothing behind.

Reading takes whole archives (`binaryFile`), whose size is bounded as above. The
end of a frame follows from its block headers, so an archive is read in one pass
and each record is decoded alone. The rows that meet in the join that finds
revisits are narrow; where these are too many to broadcast, Spark shuffles the
pages once to meet them.

The reader checks: the leading frame and its dictionary; that each frame
decodes to its declared content size; the version line; the header lines and
mandatory headers; that the block has the length its header states and ends in
two line ends; that a response's payload has the stated digest; that a
revisit's response exists and has the same digest. A fault raises WarcError.

Defined results: a null payload is empty; a null id has no header, reads back as
null, and counts as larger than any id (responses where no other id has their
payload); rows that share id and
payload are all alike, so those with the smallest id of their payload are all
responses; a page longer than an archive is an archive of its own; an empty table gives no archives and an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, whole_text, written

DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that leads an archive
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)  # an empty skippable frame, all ASCII
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_BYTES = 32_768
TRAIN_BYTES, TRAIN_RECORDS = 4_000_000, 400
ARCHIVE_BYTES = 32 * 2**20
LEAST_BYTES = 100
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"  # records of one input are the same bytes in every run


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def record(kind: str, page_id: int | None, url: str, digest: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record: header lines, an empty line, the block, two line ends."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    name = hashlib.sha256(f"{page_id}\n{url}\n{digest}".encode()).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:sha256:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of a record's bytes."""
    top, sep, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC record: {data[:40]!r}")
    head: dict[str, str] = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"no header line: {x[:80]!r}")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"a record lacks {name}")
    if not head["content-length"].isdigit() or len(rest) != int(head["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{head['warc-record-id']}: its length is not Content-Length")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise WarcError(f"{head['warc-record-id']}: no HTTP response")
    return head, payload


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(archive: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at byte `at` ends: RFC 8878, 3.1.1."""
    try:
        descriptor = archive[at + 4]
        single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
        pos = at + 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[descriptor >> 6]
        last = 0
        while not last:
            block = archive[pos] | archive[pos + 1] << 8 | archive[pos + 2] << 16
            last, kind = block & 1, block >> 1 & 3
            if kind == 3:
                raise WarcError(f"the frame at byte {at} has a block of no known kind")
            pos += 3 + (1 if kind == 1 else block >> 3)
        pos += 4 * checksum
    except IndexError:
        pos = len(archive) + 1
    if pos > len(archive):
        raise WarcError(f"the frame at byte {at} is cut off")
    return pos


def frames(archive: bytes | memoryview) -> Iterator[bytes]:
    """The records of an archive, decoded frame by frame."""
    import zstandard

    archive = memoryview(archive).cast("B")
    if len(archive) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC or 8 + size > len(archive):
        raise WarcError("no dictionary frame leads the archive")
    raw = bytes(archive[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + size
    while at < len(archive):
        if at + 8 > len(archive):
            raise WarcError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            if at > len(archive):
                raise WarcError("a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        end = frame_end(archive, at)
        try:
            data = codec.decompress(archive[at:end])
            declared = zstandard.frame_content_size(bytes(archive[at : at + 18]))
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} does not decode: {e}") from e
        if declared != len(data):
            raise WarcError(f"the frame at byte {at} has not the size it declares")
        at = end
        yield data


def _train(samples: list[bytes]) -> bytes:
    import zstandard

    if len(samples) >= 8 and sum(map(len, samples)) > 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # samples too much alike to train on
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]  # a raw content dictionary


def archives(records: Iterable[bytes], most: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """The records as archives; another one starts when one has `most` bytes."""
    import zstandard

    records = iter(records)
    while True:
        first: list[bytes] = []
        size = 0
        for r in records:
            first.append(r)
            size += len(r)
            if size >= TRAIN_BYTES or len(first) >= TRAIN_RECORDS:
                break
        if not first:
            return
        dictionary = _train(first)
        codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        out = bytearray(leading_frame(dictionary))
        for n, r in enumerate(chain(first, records), 1):
            out += SEPARATOR
            out += codec.compress(r)
            # records that the dictionary was trained on stay with it
            if n >= len(first) and len(out) >= most:
                break
        yield bytes(out)


def roles(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the revisits: records whose payload of at
    least LEAST_BYTES bytes also has a smaller id. Only narrow rows of payloads
    that occur twice are joined."""
    x = pages.select("page_id", F.sha2(whole_text("html").cast("binary"), 256).alias("digest"), F.octet_length(whole_text("html")).alias("bytes")).where(f"bytes >= {LEAST_BYTES}").select("page_id", "digest")
    many = written(x.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeats")
    return x.join(many, "digest").where("refers_to is not null and coalesce(page_id > refers_to, true)").distinct()


def write_archives(pages: DataFrame, path: str, most: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row into archives under path."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), whole_text("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    again = written(roles(pages), "warc-revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for i, url, html, digest, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    yield record("response" if refers.as_py() is None else "revisit", i.as_py(), url.as_py(), digest.as_py(), html.as_py().encode(), refers.as_py())

        for a in archives(records(), most):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary())], ["archive"])

    # a cast keeps the bytes as they are, and the sink writes them as they are, a row to a file
    rows = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(packed, "archive binary").select(F.col("archive").cast("string").alias("value"))
    rows.write.option("lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of every record of the archives under path, each validated by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content")):
                out = []
                try:
                    for data in frames(content.as_buffer()):
                        head, payload = parse(data)
                        kind, digest, size = head["warc-type"], head.get("warc-payload-digest", ""), head.get("x-payload-length", "")
                        if kind not in ("response", "revisit") or not digest.startswith("sha256:") or not size.isdigit():
                            raise WarcError(f"{head['warc-record-id']}: a header has no such value")
                        if kind == "response" and (digest[7:] != hashlib.sha256(payload).hexdigest() or int(size) != len(payload)):
                            raise WarcError(f"{head['warc-record-id']}: the payload is another")
                        whole = lambda h: int(head[h]) if h in head else None  # noqa: B023, E731
                        out.append((whole("x-page-id"), head.get("warc-target-uri"), kind, int(size), digest[7:], whole("x-refers-to-page-id")))
                except WarcError as e:
                    raise WarcError(f"{name.as_py()}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    # an archive's file may hold nothing: a task without rows writes an empty one
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, FIELDS)


def resolved(records: DataFrame) -> DataFrame:
    """The records; a revisit whose response is missing or has another payload raises. Each revisit meets one
    row, so nothing is gathered after the join, and one that very many copies refer to can be split."""
    response = records.where("record_type = 'response'")
    target = response.where("page_id is not null").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_of"), F.col("payload_bytes").alias("_size")).distinct().withColumn("_there", F.lit(True))
    same = (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_of")) & (F.col("payload_bytes") == F.col("_size"))
    revisit = records.where("record_type = 'revisit'").join(target, same, "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("boolean")
    return response.unionByName(revisit.where(F.coalesce(F.col("_there"), lost)).select(*records.columns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(written(read_archives(spark, path), "warc-records")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return """
    WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id OR page_id IS NULL AND first IS NOT NULL THEN first END AS refers_to
    FROM f
    """
