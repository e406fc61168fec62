"""Line dedup by pairwise alignment.

Two documents overlap when they share a block: a run of lines of at least ``least_words`` words. A document is a sequence of
line hashes; a line of fewer words is hashed together with as many lines after it, or before it, as the block needs (its
least window), so that each line of a common block has a hash of its own that lies wholly in the block.

Documents meet through rare hashes: one that at most ``RARE`` documents hold makes a pair of every two of them. A hash of
more documents pairs each of them with its first holder (smallest doc_id), so a line of thousands of documents, or of
thousands of copies, gives each of them one partner and never all pairs, and still is never passed over. A pair brings all
hashes that lead to it, with all their places in both documents; patience diff aligns them on those unique in both, and the
blocks of aligned lines are deleted from the later document. A hash's first holder never loses it, unless as part of a block
of a still earlier document, so one copy of every line stays in the corpus.

Lines end at newlines. Lines without a word take part in no block, but a block may reach across them. Null and empty texts
have no lines. Rows that repeat a doc_id are told apart by a hash of the text; full repeats of a row count as one document and
share its fate. A null doc_id counts as the latest. Texts that lose nothing come back unchanged. A text of any length is taken
whole, in time in proportion to its lines. Columns of ``docs`` that are named like a result (text, n_lines, removed_lines)
give way to it; all others are kept, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, materialize

LEAST_WORDS = 8
#: A hash of at most so many rows is rare.
RARE = 4
#: Windows of an Arrow batch that goes back to the JVM.
BATCH_WINDOWS = 50_000


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (position in the later, position in the earlier document), sorted by the first, a longest run rising in both."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(pairs[i])
        i = back[i]
    return run[::-1]


def least_windows(words: list[int], least_words: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs with ``least_words`` words from each line forward and backward."""
    ends = [0, *accumulate(words)]
    found = set()
    for i in range(len(words)):
        j = bisect_left(ends, ends[i] + least_words)
        if j < len(ends):
            found.add((i, j))
        k = bisect_right(ends, ends[i + 1] - least_words) - 1
        if k >= 0:
            found.add((k, i + 1))
    return sorted(found)


def keys_of(text: bytes, least_words: int) -> dict[tuple[int, int, int], list[int]]:
    """(128-bit hash as two longs, lines) of each least window -> the ranks at which it begins. Ranks leave out lines without a word."""
    lines, words = [], []
    for line in text.split(b"\n"):
        if n := len(line.split()):
            lines.append(line)
            words.append(n)
    out: dict[tuple[int, int, int], list[int]] = {}
    for i, j in least_windows(words, max(1, least_words)):
        key = xxhash.xxh3_128_digest(lines[i] if j == i + 1 else b"\n".join(lines[i:j]))
        out.setdefault((int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), j - i), []).append(i)
    return out


def windows(docs: DataFrame, least_words: int) -> DataFrame:
    """d, e (of ``docs``), h, g (key), n (lines) and at array<int> (ranks): a row for each document and least window."""
    names = ("d", "e", "h", "g", "n", "at")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for d, e, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)), strict=True):
                out.extend((d, e, *key, at) for key, at in keys_of(text, least_words).items())
                if len(out) >= BATCH_WINDOWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return docs.mapInArrow(run, "d long, e long, h long, g long, n int, at array<int>")


def aligned(later: list[tuple[int, int]], earlier: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place in later, place in earlier) of a common subsequence, by patience diff; between its places no key is common.

    Equal heads and tails of a gap are taken, then keys that are unique in both sides of it are anchors, and the gaps between
    anchors are treated alike. Where no key is unique, the first of the one side meets the first of the other, and so on.
    """
    out, gaps = [], [(0, len(later), 0, len(earlier))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and later[a] == earlier[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and later[a_end - 1] == earlier[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        mine: dict[tuple[int, int], list[int]] = {}
        theirs: dict[tuple[int, int], list[int]] = {}
        for k in range(a, a_end):
            mine.setdefault(later[k], []).append(k)
        for k in range(b, b_end):
            if earlier[k] in mine:
                theirs.setdefault(earlier[k], []).append(k)
        met = [(mine[key][0], at[0]) for key, at in theirs.items() if len(at) == len(mine[key]) == 1] or [x for key, at in theirs.items() for x in zip(mine[key], at, strict=False)]
        run = patience(sorted(met))
        out.extend(run)
        if run:
            for (x, y), (x_end, y_end) in zip([(a - 1, b - 1), *run], [*run, (a_end, b_end)], strict=True):
                gaps.append((x + 1, x_end, y + 1, y_end))
    return sorted(out)


def shared_lines(rows: list[tuple[int, int, int, list[int], list[int]]]) -> list[int]:
    """Ranks to delete from the later document of a pair; rows: (h, g, lines, ranks in the later, ranks in the earlier)."""
    if len(rows) == 1 and len(rows[0][3]) == 1:
        return list(range(rows[0][3][0], rows[0][3][0] + rows[0][2]))
    later = sorted((at, n, (h, g)) for h, g, n, ranks, _ in rows for at in ranks)
    earlier = sorted((at, n, (h, g)) for h, g, n, _, ranks in rows for at in ranks)
    gone: set[int] = set()
    for k, _ in aligned([x[2] for x in later], [x[2] for x in earlier]):
        gone.update(range(later[k][0], later[k][0] + later[k][1]))
    return sorted(gone)


def without(text: str, ranks: list[int]) -> tuple[str, list[int]]:
    """A text without its lines of these ranks (lines without a word have none), and the positions of those lines."""
    gone, kept, removed, rank = set(ranks), [], [], -1
    for at, line in enumerate(text.split("\n")):
        solid = bool(line.encode().split())
        rank += solid
        if solid and rank in gone:
            removed.append(at)
        else:
            kept.append(line)
    return "\n".join(kept), removed


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed_lines", T.ArrayType(T.IntegerType()))]))
def deleted(text: pd.Series, ranks: pd.Series) -> pd.DataFrame:
    found = [without(t, r) if r is not None else (None, []) for t, r in zip(text, ranks, strict=True)]
    return pd.DataFrame({"text": [t for t, _ in found], "removed_lines": [r for _, r in found]})


def overlaps(found: DataFrame) -> DataFrame:
    """Pairs of documents with the hashes that lead to them: d, e (the later one), od, oe (the earlier), h, g, n, at, oat."""
    holders = found.groupBy("h", "g").agg(F.count("*").alias("holders")).where("holders > 1")
    # Written, so that the joins read both sides from shuffles of their own and a frequent hash's rows can be split.
    shared = materialize(found.join(materialize(holders, "line-holders"), ["h", "g"]), "shared-lines")
    rare, frequent = shared.where(F.col("holders") <= RARE), shared.where(F.col("holders") > RARE)
    earlier = rare.select("h", "g", F.col("d").alias("od"), F.col("e").alias("oe"), F.col("at").alias("oat"))
    first = frequent.groupBy("h", "g").agg(F.min(F.struct("d", "e", "at")).alias("o")).select("h", "g", F.col("o.d").alias("od"), F.col("o.e").alias("oe"), F.col("o.at").alias("oat"))
    columns = ("d", "e", "od", "oe", "h", "g", "n", "at", "oat")
    before = F.struct(F.col("od").alias("d"), F.col("oe").alias("e")) < F.struct("d", "e")
    of_rare = rare.join(earlier, ["h", "g"]).where(before).select(*columns)
    of_frequent = frequent.join(materialize(first, "line-owners"), ["h", "g"]).where(before).select(*columns)
    return of_rare.unionByName(of_frequent).distinct()


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs``, text without the deleted lines, and n_lines, removed_lines array<int> (positions from 0).

    Only hashes, places and counts are shuffled by hash and by pair; texts move once, to meet their deletions.
    """
    others = [c for c in docs.columns if c not in ("text", "n_lines", "removed_lines")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text).alias("e"))
    pairs = overlaps(materialize(windows(docs.select(*ids, text.alias("text")), least_words), "line-hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_pairs() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple[int, int, list[int]]] = []
        for (d, e, _, _), rows in groupby(of_pairs(), key=lambda r: r[:4]):
            gone = shared_lines([r[4:] for r in rows])
            if gone:
                out.append((d, e, gone))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["d", "e", "gone"])

    gone = (
        pairs.repartition("d", "e", "od", "oe")
        .sortWithinPartitions("d", "e", "od", "oe")
        .mapInArrow(run, "d long, e long, gone array<int>")
        .groupBy("d", "e")
        .agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("ranks"))
    )
    packed = docs.select(*ids, text.alias("whole"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0), *(F.col(f"`{c}`") for c in others)).alias("row"))
    edited = packed.join(gone, ["d", "e"], "left").withColumn("new", deleted(F.when(F.col("ranks").isNotNull(), F.col("whole")), "ranks"))
    fresh = {
        "text": F.when(F.col("ranks").isNull(), F.col("text")).otherwise(F.col("new.text")),
        "n_lines": F.when(F.col("whole") == "", 0).otherwise(F.length("whole") - F.length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1),
        "removed_lines": F.coalesce("new.removed_lines", F.array().cast("array<int>")),
    }
    names = [*docs.columns, *(c for c in ("n_lines", "removed_lines") if c not in docs.columns)]
    return edited.select(*((fresh[c] if c in fresh else F.col("row").getField(c)).alias(c) for c in names))
