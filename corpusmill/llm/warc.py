"""WARC archives, written and read through an index.

Writing: every page becomes one gzip member holding one WARC record. Of pages with equal payloads the one with the largest
page_id is a ``response``; the others are ``revisit`` records that name it and carry only the HTTP header. Each task
streams its records into one archive under a name of its own and hands Spark a row per record: file, offset, length, URL,
digest. The index is those rows, so an archive that a lost or repeated attempt left behind is never read.

Reading: the selected index rows are sorted by file and offset, adjoining byte ranges are fetched together, and each record
is parsed from its bytes alone.

A null html is an empty payload, a null url an empty target. Rows that share a page_id are written each; between equal
payloads the largest page_id wins, and of several rows with that page_id each is a response. A null page_id counts as the
smallest. Payloads below ``least`` bytes are never revisits. A record's id is made of its page_id, so rows that share one
share it. A payload of any length is one record. Other columns of ``pages``, whatever their names, are neither read nor kept.
An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder

LEVEL = 4
#: Byte ranges are fetched together while the gap is at most GAP and the whole at most READ bytes.
GAP, READ = 64 << 10, 4 << 20
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI that Spark uses too. Spark's names of stores that Arrow knows by another name are mapped
    (s3a and s3n: s3; dbfs: the mounted folder); a store that Arrow can't open is an error."""
    name, _, rest = uri.partition(":")
    if name in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif name == "dbfs":
        uri = "file:///dbfs/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError) as e:
        raise ValueError(f"no archives at {uri}: they need a folder on file, hdfs, s3 (s3a), gs, abfs or dbfs") from e


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; without a payload a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_of(value: str | None) -> int | None:
    digits = value[len("<urn:page:") : -1] if value else ""
    return int(digits) if digits else None


def parse(data: bytes) -> dict:
    """The fields of ``RECORD`` of one record. A response's size and digest are those of the payload that was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": len(payload) if response else int(http_fields["Content-Length"]),
        "payload_digest": base32_sha1(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else _page_of(fields.get("WARC-Refers-To")),
        "payload": payload if response else None,
    }


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with the columns of a record to write. Only ids and digests meet by digest; bodies aren't shuffled by it."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    skinny = pages.select("page_id", F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"))
    owners = skinny.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("sha", "owner")
    # Most payloads are unique, so few rows are left of either side before the bodies are joined, and those by page_id.
    revisits = skinny.where(F.col("size") >= least).join(owners, "sha").where(~F.col("page_id").eqNullSafe(F.col("owner"))).select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "owner").distinct()
    sha = F.sha1(body.cast("binary"))
    return (
        pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.cast("binary").alias("body"), sha.alias("sha"))
        .join(revisits, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")
        .select("page_id", "url", "body", F.col("__sha").isNotNull().alias("revisit"), "owner")
    )


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the archives into ``folder`` (a URI that executors reach) and returns the index, itself written there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name, offset, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            rows = []
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            for page_id, url, body, revisit, owner in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, body, revisit, owner = page_id.as_py(), url.as_py(), body.as_py(), revisit.as_py(), owner.as_py()
                digest = base32_sha1(body)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, None if revisit else body, len(body), digest, owner)) + packer.flush()
                out.write(member)
                rows.append((page_id, url, digest, "revisit" if revisit else "response", f"{folder}/{name}", offset, len(member)))
                offset += len(member)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    file_system(folder)  # fails here, before any task, where the folder can't be opened
    return materialize(plan(pages, least).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows, with the columns of ``RECORD``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, file = None, None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORD.split(", ")]

        def ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
            run_: list[tuple[int, int]] = []
            last = None
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if run_ and (name != last or offset - sum(run_[-1]) > GAP or offset + length - run_[0][0] > READ):
                    yield last, run_
                    run_ = []
                last = name
                run_.append((offset, length))
            if run_:
                yield last, run_

        for batch in batches:
            for name, found in ranges(batch):
                if name != open_name:
                    system, path = file_system(name)
                    open_name, file = name, system.open_input_file(path)
                start, end = found[0][0], sum(found[-1])
                data = file.read_at(end - start, start)
                rows = [parse(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in found]
                if not payloads:
                    for r in rows:
                        r["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)

    tasks = index.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes archives of all pages, then reads every record back; payloads are checked and dropped."""
    index = write(pages, new_folder(pages.sparkSession, "warc"), least)
    return read(index, payloads=False).drop("payload")
