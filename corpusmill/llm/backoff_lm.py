"""Language-model scoring with a weighted backoff automaton over words.

Model: word pairs smoothed by words, ``p(v|u) = (c(u,v) + M p(v)) / (c(u) + M)``: M tokens of the lower order are added to every
context. The lower order adds a half to every count and has one further word for all that training lacks.

As an automaton: a root and a state for every word that training saw as a context. The root has an arc for every word; the
state of u has an arc for every v that training saw after u, weight log p(v|u), and a failure arc to the root, weight
log M / (c(u) + M). A text is read once from left to right, from the root: a token takes its arc; if the state has none, the
failure arc is taken first. The arc leads to the token's own state, or to the root where training lacks the word. The texts of
a block are traversed side by side, each carrying its state and its sum. A text of more than ``LANE`` tokens is traversed in
several lanes, each of which starts in the state that the token before it leads to.

Work: scanned texts are cut into blocks of about ``BLOCK`` tokens. A block sends its distinct words and pairs, with their
training counts, as sorted arrays to the buckets by hash that hold some of them; a bucket sums the counts of each key over all
blocks and answers each block in the block's own order. So an n-gram costs a row element per block and not per occurrence, a
frequent one is no more than one element per block, rows are no more than distinct n-grams, the model is never in one place, and
a block receives just the part of the automaton that its texts can reach. N and V are sums over the buckets.

Words and pairs are told apart by 64-bit hashes. Null and empty texts have one token, the end. Rows that repeat count and are
scored each for itself, so rows with one text tie. A null doc_id counts as the empty text for the fold. Without training tokens
both models have one word only, the unknown one. A text of any length is scored whole; one longer than a block is a block of
its own. Other columns, whatever their names, are neither read nor kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, byte_texts, fold, materialize

BLOCK, LANE = 2_000_000, 2048
#: M, the tokens of the lower order that are added to a context.
PRIOR = 4.0
#: The hash of the end token, which no word has for practical purposes.
END = 0x5DEECE66D
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ROW = "kind string, block long, bucket int, keys binary, counts binary, docs binary"


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (u.view(np.uint64) * _A) ^ (v.view(np.uint64) + _B)
        h = (h ^ (h >> np.uint64(32))) * _B
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin and end in a sorted array: buckets are equal ranges of hashes."""
    edges = np.array([(k << 64) // buckets - (1 << 63) for k in range(1, buckets)], np.int64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane, compressed: small numbers and small differences take little."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(8 * n, 1))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising numbers by their differences, which wrap around."""
    return pack(np.diff(x, prepend=np.int64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def gather(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of each block: kinds 'word' and 'pair' (keys, training counts) by bucket, and 'docs': its texts as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = WordHash(), TaskContext.get().partitionId() << 32
        ids, lengths, train, tokens, held = [], [], [], [], 0
        names = [x.split()[0] for x in ROW.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            flat, size, trained = np.concatenate(tokens), np.array(lengths), np.array(train)
            learnt = np.repeat(trained, size)
            word, local = np.unique(flat, return_inverse=True)
            order = np.argsort(-np.bincount(local), kind="stable")  # frequent words get small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            given = np.array([i is not None for i in ids], np.int64)
            parts = [pack(x) for x in (given, np.array([i or 0 for i in ids], np.int64), size, trained.astype(np.int64), order, rank[local])]
            payload = b"".join(len(x).to_bytes(8, "little") + x for x in parts)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(("docs", block, (block ^ block >> 32) % buckets, None, None, payload), kinds, strict=True)], names=names)
            del payload, parts, rank
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(size) - size] = False  # a text's first token has no context
            train_words = np.bincount(local[learnt], minlength=len(word))
            del local
            pairs, at = np.unique(pair_keys(flat[:-1], flat[1:])[inner[1:]], return_inverse=True)
            for kind, keys, counts in (("word", word, train_words), ("pair", pairs, np.bincount(at[learnt[1:][inner[1:]]], minlength=len(pairs)))):
                edges = bucket_bounds(keys, buckets)
                cuts = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
                n = len(cuts)
                columns = ([kind] * n, [block] * n, [k for k, _, _ in cuts], [pack_sorted(keys[a:b]) for _, a, b in cuts], [pack(counts[a:b]) for _, a, b in cuts], [None] * n)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            block += 1
            held = 0
            for x in (ids, lengths, train, tokens):
                x.clear()

        for batch in batches:
            for i, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)), strict=True):
                found = text.lower().split()
                h = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                ids.append(i)
                train.append(learn)
                lengths.append(len(h) + 1)
                tokens.append(np.append(h, END))
                held += len(h) + 1
                if held >= BLOCK:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), (fold("doc_id") != 1).alias("learn"), F.col("text").cast("string")).mapInArrow(run, ROW)


def answer(table: pa.Table) -> pa.Table:
    """Replaces the counts of a bucket's blocks by sums over all blocks; texts pass through."""
    kinds, keys, counts = (table[c].to_pylist() for c in ("kind", "keys", "counts"))
    out: list[bytes | None] = [None] * len(kinds)
    totals = [[0, 0] for _ in kinds]
    for kind in ("word", "pair"):
        rows = [i for i, k in enumerate(kinds) if k == kind]
        if not rows:
            continue
        ks = [unpack_sorted(keys[i]) for i in rows]
        _, start, at = np.unique(np.concatenate(ks), return_index=True, return_inverse=True)
        sums = np.zeros(len(start), np.int64)
        np.add.at(sums, at, np.concatenate([unpack(counts[i]) for i in rows]))
        sums, first = sums[at], np.zeros(len(at), bool)
        first[start] = True
        ends = np.cumsum([len(k) for k in ks])
        for i, n, end in zip(rows, map(len, ks), ends, strict=True):
            out[i] = pack(sums[end - n : end])
            if kind == "word":  # the first block that names a word carries it for the totals
                own = sums[end - n : end][first[end - n : end]]
                totals[i] = [int(own.sum()), int((own > 0).sum())]
    keep = pa.array([k if kind == "word" else None for k, kind in zip(keys, kinds, strict=True)], pa.binary())
    columns = [table["kind"], table["block"], table["bucket"], keep, pa.array(out, pa.binary()), table["docs"], pa.array(totals, pa.list_(pa.int64()))]
    return pa.table(columns, names=[x.split()[0] for x in ANSWER.split(", ")])


ANSWER = "kind string, block long, bucket int, keys binary, counts binary, docs binary, totals array<long>"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Automaton:
    """The part of the automaton that a block's texts can reach. State 0 is the root, state 1 + w that of local word w."""

    def __init__(self, word_count: np.ndarray, pairs: np.ndarray, pair_count: np.ndarray, n: int, v: int):
        """``pairs``: rising numbers u * (number of words) + v of the local pairs."""
        self.words = len(word_count)
        p = (word_count + 0.5) / (n + 0.5 * (v + 1))
        self.root = np.log10(p)
        seen = pair_count > 0
        self.arcs = pairs[seen] + self.words  # state * words + word
        u, w = pairs[seen] // self.words, pairs[seen] % self.words
        self.weights = np.log10((pair_count[seen] + PRIOR * p[w]) / (word_count[u] + PRIOR))
        self.failure = np.append(0.0, np.log10(PRIOR / (word_count + PRIOR)))  # the root fails to itself, at no cost
        self.state = np.where(word_count > 0, 1 + np.arange(self.words), 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and next state of one token of each lane."""
        weight = self.failure[state] + self.root[word]
        if len(self.arcs):
            key = state * self.words + word
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            weight = np.where(self.arcs[at] == key, self.weights[at], weight)
        return weight, self.state[word]

    def traverse(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum of the weights of every text from left to right."""
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin, length = starts[text] + part * LANE, np.minimum(sizes[text] - part * LANE, LANE)
        order = np.argsort(-length, kind="stable")
        begin, length, total = begin[order], length[order], np.zeros(len(order))
        state = np.where(part[order] > 0, self.state[tokens[np.maximum(begin - 1, 0)]], 0)
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -t, side="left"))
            weight, state = self.step(state[:active], tokens[begin[:active] + t])
            total[:active] += weight
        return np.bincount(text[order], total, len(sizes))


def walk(table: pa.Table, n: int, v: int) -> pa.Table:
    """Scores the texts of a block."""
    kinds, buckets, keys, counts, docs = (table[c].to_pylist() for c in ("kind", "bucket", "keys", "counts", "docs"))
    rows = sorted(zip(kinds, buckets, range(len(kinds)), strict=True))
    column = lambda c, kind, read: np.concatenate([np.zeros(0, np.int64), *(read(c[i]) for k, _, i in rows if k == kind)])
    word, word_count, answers = column(keys, "word", unpack_sorted), column(counts, "word", unpack), column(counts, "pair", unpack)
    data, at, parts = next(d for d in docs if d is not None), 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(unpack(data[at + 8 : at + 8 + size]))
        at += 8 + size
    given, ids, sizes, trained, order, rank = parts
    del parts, keys, counts, docs, data
    tokens = order[rank]
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(tokens), bool)
    inner[starts] = False  # a text's first token has no context
    where = np.flatnonzero(inner)
    pairs = np.unique(tokens[where - 1] * len(word) + tokens[where])
    # Answers come in the order of the pairs' hashes.
    pair_count = np.zeros(len(pairs), np.int64)
    pair_count[np.argsort(pair_keys(word[pairs // len(word)], word[pairs % len(word)]))] = answers
    automaton = Automaton(word_count, pairs, pair_count, n, v)
    total = lambda x: np.add.reduceat(x, starts)
    columns = [pa.array(ids, mask=given == 0), pa.array(trained == 0), pa.array(sizes), pa.array(total((word_count[tokens] > 0).astype(np.int64))), pa.array(total(automaton.root[tokens])), pa.array(automaton.traverse(tokens, starts, sizes))]
    return pa.table(columns, names=[x.split()[0] for x in SCORE.split(", ")])


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    # Buckets follow the shuffle partitions, which a user sets to the input; each then holds a part of all keys.
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    answered = materialize(gather(docs, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, ANSWER), "lm")
    sums = answered.agg(*(F.coalesce(F.sum(F.get("totals", F.lit(k))), F.lit(0)) for k in range(2))).first()
    n, v = (int(x) for x in sums)

    def run(table: pa.Table) -> pa.Table:
        return walk(table, n, v)

    scored = answered.drop("totals").groupBy("block").applyInArrow(run, SCORE)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
