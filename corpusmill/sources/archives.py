"""HTML members of zip archives: first an index of members from the archives' central directories, then byte ranges dealt over tasks.

Archives lie where both Spark and pyarrow's file systems reach them (file, hdfs, s3, gs, abfs). A task holds one member at a time, whatever the size of
the archive; members of one archive are read by many tasks.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import materialize

ENDINGS = (".html", ".htm")
_LOCAL, _ENCRYPTED = b"PK\x03\x04", 1
INDEX = "archive string, name string, offset long, packed long, size long, method int, flags int, crc long"


def opened(uri: str):
    """A file of a store for reading at any place."""
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)
    return store.open_input_file(path)


def members(spark: SparkSession, path: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """archive, name, offset, packed, size, method, flags, crc of the members that end so (in any case). Only central directories are read. A
    file that is no zip archive has one row without a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with opened(archive) as f:
                    try:
                        found = [(archive, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.flag_bits, m.CRC) for m in zipfile.ZipFile(f).infolist() if m.filename.lower().endswith(endings)]
                    except (zipfile.BadZipFile, OSError, ValueError):  # pyarrow says of a file too short that its position is invalid
                        found = [(archive, *[None] * 7)]
                for k in range(0, len(found), 10_000):
                    columns = zip(*found[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")
    return files.repartition("path").mapInArrow(run, INDEX)


def _content(f, m: dict) -> tuple[bytes | None, str | None]:
    """The bytes of a member, or why there are none."""
    if m["flags"] & _ENCRYPTED:
        return None, "encrypted"
    head = f.read_at(30, m["offset"])
    if head[:4] != _LOCAL:
        return None, "no member at its offset"
    begin = m["offset"] + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    data = f.read_at(m["packed"], begin)
    try:
        data = data if m["method"] == zipfile.ZIP_STORED else zlib.decompress(data, -15) if m["method"] == zipfile.ZIP_DEFLATED else None
    except zlib.error as e:
        return None, str(e)
    if data is None:
        return None, f"method {m['method']}"
    return (data, None) if zlib.crc32(data) == m["crc"] and len(data) == m["size"] else (None, "checksum")


def read_members(index: DataFrame) -> DataFrame:
    """archive, name, html and, where a member can't be read, error, of an index's members, and further columns of the index. Members are dealt by ranges of archive and offset, so tasks
    get neighbours and a large archive is spread over many; each is read alone."""

    own = [c.split()[0] for c in INDEX.split(", ")]
    more = [f for f in index.schema if f.name not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f = None, None
        for batch in batches:
            rest = [batch.column(len(own) + k) for k in range(len(more))]
            for i, m in enumerate(batch.to_pylist()):
                if m["name"] is None:
                    html, error = None, "no zip archive"
                else:
                    if m["archive"] != at:
                        at, f = m["archive"], opened(m["archive"])
                    data, error = _content(f, m)
                    html = None if data is None else data.decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in (m["archive"], m["name"], html, error)), *(c.slice(i, 1) for c in rest)], names=["archive", "name", "html", "error", *(x.name for x in more)])

    dealt = index.select(*own, *(x.name for x in more)).repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, ", ".join(["archive string, name string, html string, error string", *(f"{x.name} {x.dataType.simpleString()}" for x in more)]))


def read_html(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, errors). pages: page_id (from 0, in order of archive and name across all archives), archive, url (the member's name), html."""
    index = materialize(members(spark, path), "members")
    ids = materialize(numbered(index.where("name is not null").select("archive", "name").distinct(), ["archive", "name"], "_n"), "member-ids")
    # Numbers meet the index before a member is read, so no page is shuffled; by a merge, as a table of all names is small in a file and large in the driver.
    found = read_members(index.join(ids.hint("merge"), ["archive", "name"], "left"))
    good = found.where("error is null")
    return good.select((F.col("_n") - 1).cast("long").alias("page_id"), "archive", F.col("name").alias("url"), "html"), found.where("error is not null").select("archive", "name", "error")


def write_archives(pages: DataFrame, folder: str, name: str = "archive", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as zip archives, one for each value of ``name``, members streamed in order of their urls: archive, members. What a lost task leaves
    is written over by its next attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, z, done, n = None, None, None, [], 0
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close() -> None:
            if z is not None:
                z.close()
                out.close()
                done.append((f"{folder}/{now}.zip", n))

        for batch in batches:
            for key, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    close()
                    now, n = key, 0
                    out = store.open_output_stream(f"{base}/{key}.zip")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(at), (text or "").encode(), zipfile.ZIP_DEFLATED)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "members"])

    rows = pages.select(F.col(name).cast("string").alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    return rows.repartition("k").sortWithinPartitions("k", "u").mapInArrow(run, "archive string, members long")
