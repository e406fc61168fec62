"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it: XXH64 (seed 42) of the UTF-8 bytes
of every run of three words, joined by spaces, repeats included; ASCII letters are lower-cased. A text of fewer words is one shingle,
one without words has the fingerprint zero and is linked like any other. Documents link at ``RADIUS`` or fewer differing bits.

Equal fingerprints are one. The others are dealt to tiles by their population counts in equal blocks of the 64 bits. Fingerprints
within the radius have counts that differ by no more, summed over the blocks, so a tile is compared only with those of such
counts, by exclusive-or and bit counts of whole arrays; all other pairs of tiles are skipped. Blocks are as many as keep tiles at
about ``TILE`` fingerprints, so the work a fingerprint is bounded at any size; fingerprints of one combination of counts beyond that are
dealt over several tiles. A comparison of tiles sends on at most a link a fingerprint, enough to keep together what is linked, and never
all pairs; links then become connected components.

Null and empty texts are texts without words. Rows that repeat a doc_id are fingerprinted each for itself. A component's id is its
smallest doc_id (nulls ignored; null if there is none). A text of any length is taken whole. Other columns, whatever their names,
are neither read nor kept. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, materialize
from .components import components

WIDTH, HASH_SEED, RADIUS = 3, 42, 2
#: Fingerprints of a tile, about, and of a block of one that is compared at once.
TILE, BLOCK = 4096, 64
#: Shingles whose bits are counted at once.
SHINGLES = 100_000


def hashes(text: bytes, width: int = WIDTH, seed: int = HASH_SEED) -> list[bytes]:
    """Big-endian XXH64 of each shingle."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = partial(xxhash.xxh64_digest, seed=seed)
    if len(words) <= width:
        return [digest(joined)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b]) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(found: list[list[bytes]]) -> np.ndarray:
    """Of each list of hashes the bits that more than half of them have, as signed longs; zero of an empty one."""
    sizes = np.array([len(x) for x in found], np.int64)
    out = np.zeros(len(found), np.uint64)
    solid = np.flatnonzero(sizes)
    if len(solid):
        bits = np.unpackbits(np.frombuffer(b"".join(h for x in found for h in x), np.uint8)).reshape(-1, 64)
        ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[solid], dtype=np.int64)
        out[solid] = np.packbits(2 * ones > sizes[solid, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, waiting, n = [], [], 0
            for text in byte_texts(batch.column(1)):
                waiting.append(hashes(text))
                n += len(waiting[-1])
                if n >= SHINGLES:
                    done.append(majority(waiting))
                    waiting, n = [], 0
            done.append(majority(waiting))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(done))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks_for(n: int, tile: int = TILE) -> int:
    """The least number of blocks of bits for which n fingerprints with fair bits make tiles of about ``tile``: a block of w bits has equal
    counts in two of them about once in sqrt(pi w)."""
    return next((m for m in (1, 2, 4, 8) if n * (math.pi * 64 / m) ** (-m / 2) <= tile), 16)


def counts_key(fp: F.Column, m: int) -> F.Column:
    """Population counts of m blocks of the bits as digits of one number, with room for neighbours on either side of each."""
    width, key = 64 // m, F.lit(0).cast("long")
    for k in range(m):
        block = F.shiftrightunsigned(fp, k * width)
        count = F.bit_count(block.bitwiseAND((1 << width) - 1) if m > 1 else block)
        key = key * (width + 2 * RADIUS + 1) + count + RADIUS
    return key.cast("long")


def neighbours(m: int) -> list[int]:
    """What to add to a key for the counts within the radius, without those that come before it (the other tile has them) and itself."""
    base = 64 // m + 2 * RADIUS + 1
    steps = {0}
    for _ in range(RADIUS):
        steps |= {s + sign * base**k for s, k, sign in product(steps, range(m), (-1, 1))}
    return sorted(s for s in steps if s > 0)


def tiles(distinct: DataFrame, m: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(key, part, parts, fps: the fingerprints of a tile), and (key, parts) of all combinations of counts."""
    keyed = distinct.select("fp", counts_key(F.col("fp"), m).alias("key"))
    kinds = materialize(keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "simhash-kinds")
    dealt = keyed.join(kinds, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    return materialize(dealt.groupBy("key", "part", "parts").agg(F.collect_list("fp").alias("fps")), "simhash-tiles"), kinds


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after a[i] and b[i] have become one, for all i."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != (lower := labels[labels])).any():
            labels = lower


def close(home: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of others: where each begins, and the places (in the block, in home) of what lies within the radius."""
    for start in range(0, len(others), BLOCK):
        near = np.bitwise_count(others[start : start + BLOCK, None] ^ home[None, :]) <= radius
        if near.any():
            yield start, *np.nonzero(near)


def linked_fingerprints(distinct: DataFrame, m: int, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """a, b: links that hold together all that are within the radius of each other. distinct: fp, each once."""
    made, kinds = tiles(distinct, m, tile)
    own = F.sequence(F.lit(0), F.col("parts") - 1)
    home = made.select("key", "part", F.lit(0).alias("role"), "fps")
    same = made.where("part + 1 < parts").select("key", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "fps")
    steps = F.array(*(F.lit(s).cast("long") for s in neighbours(m)))
    sent = made.select(F.explode(F.transform(steps, lambda s: F.col("key") + s)).alias("key"), "fps").join(kinds, "key").select("key", F.explode(own).alias("part"), F.lit(1).alias("role"), "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, labels, first = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def links() -> Iterator[pa.RecordBatch]:
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            a = np.concatenate([mine[moved], *(x for x, _ in first)]).view(np.int64)
            b = np.concatenate([mine[labels[moved]], *(y for _, y in first)]).view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys, parts, roles, arrays = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for k, (key, part, role) in enumerate(zip(keys, parts, roles, strict=True)):
                fps = arrays[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if not role:  # a tile begins; it comes before what it is compared with
                    yield from links()
                    now, mine, labels, first = (key, part), fps, np.arange(len(fps)), []
                    for start, i, j in close(mine, fps, radius):
                        labels = merged(labels, i + start, j)
                    continue
                assert now == (key, part)
                for start, i, j in close(mine, fps, radius):
                    at = np.concatenate(([True], i[1:] != i[:-1]))
                    first.append((fps[start + i[at]], mine[j[at]]))
                    labels = merged(labels, j, np.repeat(j[at], np.diff(np.append(np.flatnonzero(at), len(i)))))
        yield from links()

    dealt = home.unionByName(same).unionByName(sent).repartition("key", "part").sortWithinPartitions("key", "part", "role")
    return dealt.select("key", "part", "role", "fps").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    printed = materialize(fingerprints(docs), "fingerprints")
    smallest = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct-fingerprints")
    found = components(linked_fingerprints(smallest.select("fp"), blocks_for(smallest.count(), tile), tile))
    linked = found.select(F.col("id").alias("fp"), "component")
    least = materialize(linked.join(smallest, "fp").groupBy("component").agg(F.min("smallest").alias("least")), "simhash-least")
    # Written, so that a join with a fingerprint of very many documents is split.
    named = materialize(smallest.join(linked.join(least, "component"), "fp", "left").select("fp", F.coalesce("least", "smallest").alias("component_id")), "simhash-named")
    return printed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
