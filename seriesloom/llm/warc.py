"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive is a value of a binary column, so it can be written to and read from any store that Spark knows;
its bytes are what a .warc.zst file holds.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: The skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Bounds of the sample that a dictionary is trained on, of the dictionary and of an archive before compression.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 256, 4096, 32 << 10, 16 << 20
#: Payloads below this are always responses.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = re.compile(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)+)\r\n")


def page_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    return int(uri[12:-1]) if uri and len(uri) > 13 else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record. A revisit has no block; its payload's length is a header of its own."""
    block = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '', url or 'urn:x-unknown')}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_uri(refers_to)}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and block; raises ValueError where the version, a header, the length or the digest is wrong."""
    m = _HEAD.match(data)
    if not m:
        raise ValueError("a record doesn't begin with WARC/1.1 and headers")
    head: dict[str, str] = {}
    for line in m[1].decode().split("\r\n")[:-1]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in head:
            raise ValueError(f"a bad or repeated header: {line[:80]}")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-payload-length"):
        if name not in head:
            raise ValueError(f"a record has no {name}")
    block, tail = data[m.end() : -4], data[-4:]
    if tail != b"\r\n\r\n" or len(block) != int(head["content-length"]):
        raise ValueError("a record's length is not its Content-Length")
    if head["warc-type"] == "response":
        if head["warc-payload-digest"] != "sha256:" + hashlib.sha256(block).hexdigest() or int(head["warc-payload-length"]) != len(block):
            raise ValueError("a response's payload is not that of its digest")
    elif head["warc-type"] != "revisit" or "warc-refers-to" not in head or block:
        raise ValueError("a record is neither response nor revisit")
    return head, block


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the first samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def archive(records: list[bytes], words: bytes, level: int = 3) -> bytes:
    packed = zstandard.ZstdCompressor(level=level).compress(words)
    pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed + b"".join(map(pack.compress, records))


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame each, decoded with the dictionary of its leading frame (plain or compressed)."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise ValueError("no leading dictionary frame")
    words = data[8 : 8 + size]
    if words[:4] == FRAME_MAGIC:
        words = zstandard.ZstdDecompressor().decompress(words)
    pack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = pack.decompressobj()
        out = one.decompress(rest)
        if not one.eof:
            raise ValueError("a frame is cut short")
        yield out
        rest = rest[len(rest) - len(one.unused_data) :]


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest and first, the smallest id with that payload where others share it.

    Only ids and digests are grouped, with partial minima first. A null id is never the smallest: such a row revisits the
    others' smallest id, and where all ids of a payload are null, none is a revisit.
    """
    told = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    again = (
        told.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .drop("n")
    )
    return told.join(again, "digest", "left")


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes Parquet rows (records, archive) of about ARCHIVE_BYTES of records each; one dictionary, trained on a bounded sample, serves all.

    The sample is what a hash of payloads takes, in proportion to the number of rows, of equal payloads one: it is not sorted
    and is as large for any table.

    Null html: an empty payload. Null urls: an unknown URI. Null page ids are kept as such; their rows revisit the smallest
    id with their payload if there is one. Repeated rows each get a record, all of them responses if theirs is the smallest
    id. An empty table gives no archive. Other columns are ignored.
    """
    told = with_revisits(pages, **columns)
    html = F.coalesce(F.col(columns.get("html_col", "html")), F.lit(""))
    share = min(1.0, SAMPLE_PAGES / max(1, pages.count()))
    taken = pages.select(html.alias("p")).where("p <> ''").where(F.xxhash64("p") / F.lit(2.0**64) + 0.5 <= share)
    sample = taken.select(F.substring(F.col("p").cast("binary"), 1, SAMPLE_BYTES).alias("p")).distinct().collect()
    words = dictionary(sorted(bytes(r["p"]) for r in sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([archive(held, words)], pa.binary())], ["records", "archive"])

        for b in batches:
            for i, url, payload, digest, first in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                i, first = i.as_py(), first.as_py()
                held.append(record(i, url.as_py(), payload.as_py(), digest.as_py(), first, first is not None and i != first))  # a null id too
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    told.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "records long, archive binary").write.parquet(path)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of a column `archive`, validated: page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload, null for revisits)."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("archive"):
                rows, size = [], 0
                for one in records(data.as_py()):
                    head, block = parse(one)
                    url = head.get("warc-target-uri")
                    row = (
                        _page_id(head["warc-record-id"]), None if url == "urn:x-unknown" else url, head["warc-type"], _page_id(head.get("warc-refers-to")),
                        int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:"),
                    )
                    rows.append(row + ((block if head["warc-type"] == "response" else None),) * payloads)
                    size += len(block) * payloads
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return archives.select("archive").mapInArrow(run, schema + ", payload binary" * payloads)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes the archives to the shared folder, reads them back and returns their records without payloads."""
    path = f"{shared_dir(pages.sparkSession)}/seriesloom/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession.read.parquet(path), payloads=False)
