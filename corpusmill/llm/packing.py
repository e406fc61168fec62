"""Conflict-constrained best-fit packing of documents into training sequences.

Bins are kept in order of residual space. Each carries two bitmaps: the sources and the duplicate clusters that it holds.
For the next item (longest first) the search starts at the smallest residual that fits and goes to the successor until a
bin is found in which neither its source is full nor its cluster present; if there is none, a bin is opened. So an item
lands in the tightest compatible bin.

A document longer than a bin is cut into windows of ``capacity`` words; full windows are bins of their own, the rest is an
item. Documents are dealt to shards by a hash of the row, ``shard_rows`` to a shard on average, so that no task holds more
than a shard however skewed sources or clusters are. Documents without words take no space: they get no bin (bin_id null).
A null source or cluster conflicts with nothing. Rows that repeat are packed each for itself. Items of one size are taken in
the order of their ids, parts, sources and clusters. An empty table gives no rows. ``docs`` may have other columns of any name.
``sequences`` then gives every item the part of its document's text that it stands for.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts

CAPACITY, SHARD_ROWS, PER_SOURCE = 2048, 8192, 4
SCHEMA = "row long, doc_id long, part int, begin int, n_words int, shard long, bin long, position int, bin_words int"


class Bins:
    """The open bins of a shard, in order of (residual, number)."""

    def __init__(self, per_source: int):
        self.per_source = per_source
        self.open: list[tuple[int, int]] = []
        self.sources: list[list[int]] = []  # of each bin one bitmap for each time a source may occur
        self.clusters: list[int] = []
        self.filled: list[int] = []
        self.items: list[int] = []

    def place(self, size: int, source: int, cluster: int, capacity: int) -> tuple[int, int]:
        """Bin and position of the next item; ``source`` and ``cluster`` are single bits, or 0."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            residual, number = self.open[at]
            if not self.clusters[number] & cluster and not (source and self.sources[number][-1] & source):
                break
            at += 1
        if at < len(self.open):
            del self.open[at]
        else:
            number, residual = len(self.filled), capacity
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
            self.filled.append(0)
            self.items.append(0)
        carried = source
        for k, bits in enumerate(self.sources[number]):  # the first level at which the source is still missing
            if not bits & carried:
                self.sources[number][k] = bits | carried
                break
        self.clusters[number] |= cluster
        position = self.items[number]
        self.items[number] += 1
        self.filled[number] += size
        if residual > size:
            insort(self.open, (residual - size, number))
        return number, position


def pack_shard(rows: list[tuple[int | None, int, str | None, int | None]], capacity: int, per_source: int) -> list[tuple]:
    """rows: (doc_id, words, source, cluster). Returns (number of the row, part, begin, words, bin, position, bin's words)."""
    items = []
    for number, (doc_id, words, source, cluster) in enumerate(rows):
        full, rest = divmod(words, capacity)
        items += [(capacity, doc_id, part, part * capacity, source, cluster, number) for part in range(full)]
        if rest:
            items.append((rest, doc_id, full, full * capacity, source, cluster, number))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[4] or "", x[5] or 0)
    items.sort(key=key)
    bits: dict[object, int] = {}
    counts = {"s": 0, "c": 0}

    def bit(kind: str, value: object) -> int:
        if value is None:
            return 0
        if (kind, value) not in bits:
            bits[kind, value] = 1 << counts[kind]
            counts[kind] += 1
        return bits[kind, value]

    repeated: dict[object, int] = {}
    for x in items:
        repeated[x[5]] = repeated.get(x[5], 0) + 1
    bins, placed = Bins(per_source), []
    for size, _, part, begin, source, cluster, row in items:
        # A cluster with one item in the shard conflicts with nothing and needs no bit.
        number, position = bins.place(size, bit("s", source), bit("c", cluster) if repeated[cluster] > 1 else 0, capacity)
        placed.append((row, part, begin, size, number, position))
    return [(*p, bins.filled[p[4]]) for p in placed]


def row_of() -> F.Column:
    """A hash of a document's id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(F.col("doc_id").cast("long"), F.length(text), F.xxhash64(text))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster: F.Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per item: row (a hash of its document), doc_id, part, begin and n_words (the window of words), bin_id, position,
    bin_words.

    ``cluster``: a long column of the duplicate cluster; by default documents with equal texts are a cluster.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(words).alias("n"),
        F.col("source").cast("string").alias("source"),
        (F.xxhash64(text) if cluster is None else cluster).alias("cluster"),
        row_of().alias("row"),
    )
    return pack_sized(sized, capacity, per_source, shard_rows)


def pack_sized(sized: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pack`` for documents whose words are counted already: doc_id, n (words), source, cluster, row; texts are not needed."""
    shards = max(1, -(-sized.count() // shard_rows))
    sharded = sized.withColumn("shard", F.pmod("row", F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        rows = list(zip(*(table[c].to_pylist() for c in ("doc_id", "n", "source", "cluster")), strict=True))
        placed = pack_shard(rows, capacity, per_source)
        empty = [(k, 0, 0, 0, None, None, 0) for k, (_, n, _, _) in enumerate(rows) if not n]
        names = [x.split() for x in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32()}
        keys = table["row"].to_pylist()
        rows = [(keys[a], rows[a][0], b, c, d, shard, e, f, g) for a, b, c, d, e, f, g in placed + empty]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])

    packed = sharded.groupBy("shard").applyInArrow(run, SCHEMA)
    bin_id = F.col("shard") * F.lit(1 << 32) + F.col("bin")
    return packed.select("row", "doc_id", "part", "begin", "n_words", bin_id.alias("bin_id"), "position", "bin_words")


WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def cut(text: bytes, capacity: int) -> list[bytes]:
    """A text in windows of ``capacity`` words, each from its first word's begin to its last word's end; one of no words is empty."""
    ends = [m.span() for m in WORD.finditer(text)]
    return [text[ends[a][0] : ends[min(a + capacity, len(ends)) - 1][1]] for a in range(0, len(ends), capacity)] or [b""]


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``packed`` with the text of each item. Full repeats of a document bring their text once; texts are cut where they lie and
    meet their items by row and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                parts = cut(text, capacity)
                for start in range(0, len(parts), 1024):
                    some = parts[start : start + 1024]
                    columns = [pa.array([row] * len(some), pa.int64()), pa.array(range(start, start + len(some)), pa.int32()), pa.array([x.decode("utf-8", "replace") for x in some], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "part", "text"])

    once = docs.select(row_of().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["row"])
    return packed.join(once.mapInArrow(run, "row long, part int, text string"), ["row", "part"], "left").select(*packed.columns, "text")
