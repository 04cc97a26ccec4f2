"""Archives of fetched feed pages: dictionary-compressed WARC files, written and read by Spark."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.sampling import bounded_sample
from runwarden.session import ensure_checkpoint_dir, materialize

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
SAMPLE_PAGES = 1000
LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64_000_000
#: Tasks that read archives; with more files each reads several.
MOST_READERS = 10_000
ARCHIVE_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:runwarden:page:"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all workers share, local path or URI."""
    if not urlparse(folder).scheme:
        folder = "file://" + folder
    return fs.FileSystem.from_uri(folder)


def build_dictionary(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, size: int = DICTIONARY_BYTES) -> bytes:
    """Zstandard dictionary from the archived records of at most ``sample_pages`` pages.

    Records are taken as they are written, headers and whole payload; the sample is bounded in
    bytes.  Where there is too little to train on, the first bytes of the sample serve as they are.
    """
    rows = bounded_sample(pages.select("page_id", "url", "document"), "document", sample_pages).collect()
    samples = sorted(format_record(r["page_id"], r["url"], (r["document"] or "").encode(), "response", None) for r in rows)
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def format_record(page_id, url: str | None, payload: bytes, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers only and says whose payload it had."""
    digest = hashlib.sha1(payload).digest()
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {ARCHIVE_DATE}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c >= ' ')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/octet-stream",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines.insert(6, f"WARC-Refers-To: <{_URN}{refers_to}>")
        lines.insert(7, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and hashlib.sha1(body).digest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    name = lambda key: fields[key][1:-1].removeprefix(_URN) or None if key in fields else None
    return {
        "page_id": name("WARC-Record-ID"),
        "payload_bytes": int(fields["Payload-Length"]),
        "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": name("WARC-Refers-To"),
        "document": body if fields["WARC-Type"] == "response" else None,
    }


def read_archive(data: bytes):
    """Records of one archive: the dictionary frame first, then a frame for each record."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with its dictionary")
    dictionary, at = _dictionary(data[8 : 8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        unit, parts = reader.decompressobj(), []
        while not unit.eof:  # in pieces, so that the end of a frame is found early
            piece = data[at : at + (1 << 16)]
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(unit.decompress(piece))
            at += len(piece)
        at -= len(unit.unused_data)
        yield parse_record(b"".join(parts))


def plan_records(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``: of equal long payloads the largest id is archived."""
    payload = F.encode(F.coalesce("document", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "document", F.sha1(payload).alias("_digest"), F.octet_length("document").alias("_size"))
    # Digests found more than once; partial maxima are made before the shuffle.
    firsts = (
        rows.where(F.col("_size") >= least_bytes)
        .groupBy(F.col("_digest").alias("_same"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    joined = rows.join(materialize(firsts), F.col("_digest") == F.col("_same"), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "document",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages to ``.warc.zst`` files in ``folder``; returns ``path, records`` of each file.

    Every file starts with a skippable frame that holds the dictionary; each record is a frame
    of its own.  A file is written under a passing name and then renamed, so a task that is
    repeated leaves the same files; only files in the returned manifest count.
    """
    dictionary = build_dictionary(pages)
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def work(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        trained = _dictionary(shared.value)
        packer = zstandard.ZstdCompressor(level=3, dict_data=trained)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(shared.value)) + shared.value
        partition, number, records, out = TaskContext.get().partitionId(), 0, 0, io.BytesIO()

        def close():
            path = f"{base}/part-{partition:06d}-{number:04d}.warc.zst"
            passing = f"{base}/.{uuid.uuid4().hex}"
            with system.open_output_stream(passing) as file:
                file.write(lead)
                file.write(out.getbuffer())
            system.move(passing, path)
            return pa.record_batch({"path": [path], "records": pa.array([records], pa.int64())})

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "document", "record_type", "refers_to")), strict=True):
                page_id, url, document, kind, refers_to = row
                out.write(packer.compress(format_record(page_id, url, (document or "").encode(), kind, refers_to)))
                records += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    number, records, out = number + 1, 0, io.BytesIO()
        if records:
            yield close()

    return materialize(plan_records(pages).mapInArrow(work, "path string, records bigint"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the archives in a manifest: ids as text, sizes, digests, types, documents."""

    def work(batches):
        system, _ = file_system(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                with system.open_input_stream(path, compression=None) as file:
                    data = file.read()
                held, size = [], 0
                for record in read_archive(data):
                    held.append(record)
                    size += len(record["document"] or b"")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    schema = pa.schema(
        [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.string()), ("document", pa.binary())]
    )
    # A given number, so that adaptive execution leaves a task for each file, up to MOST_READERS.
    readers = max(1, min(manifest.count(), MOST_READERS))
    files = manifest.select("path").repartition(readers)
    return files.mapInArrow(
        work,
        "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, document binary",
    )


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive fetched pages as dictionary-compressed WARC and read the archives back.

    ``pages``: ``page_id, url, document`` (text; null is empty).  Files go to ``folder``, by default
    a new folder under the shared checkpoint folder.  Returns ``page_id, payload_bytes,
    payload_digest`` (hex SHA-1), ``record_type, refers_to, document`` of every record.

    Of records with equal payloads of at least 1000 bytes, that with the largest ``page_id`` is a
    response and the others are revisits of it; shorter ones are all responses.  The dictionary
    is trained on a bounded sample of pages; every page is written with it.

    Defined cases: null and empty documents are records with an empty payload; a repeated row
    that has the largest id is a response each time; a null id is smaller than any other, and
    when all ids of a payload are null all are responses; ids are returned in their own type;
    an empty table writes no file and gives no rows; other columns are ignored.
    """
    pages = pages.select("page_id", "url", "document")
    kind = pages.schema["page_id"].dataType
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    found = read_archives(write_archives(pages, folder), folder)
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
