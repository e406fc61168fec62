"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic when at least one of them is. Sentence i has probability
``p_i = sigmoid(bias + sum over its distinct words)``, where a word counts with its own weight and those of its beginnings,
so that a new form of an insult is known by its stem; the document's is the noisy-or ``1 - prod(1 - p_i)``. Only
documents carry labels: the gradient of the bag's likelihood decides which sentences, and so which words, are to blame.
``locate`` then gives the sentences that offend.

Null and empty texts have no sentence and get score 0. Labels that are null or of no document take no part. A row that
repeats is scored each time alike, and rows with one text tie. A text of any length is scored whole, sentence by sentence; one
without an end mark is one sentence. An empty table gives no rows. Other columns, whatever their names, are neither read nor
kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, fold, with_text
from .sampling import first_whole, labelled_sample

#: At most so many labelled documents are fitted on, whole ones in hash order for as long as they have at most so many words'
#: features; features of fewer than LEAST_DOCS of them get no weight.
SAMPLE, MOST_FEATURES, LEAST_DOCS = 6000, 20_000_000, 5
#: Features are hashed into so many buckets; the bias has a key of its own.
BUCKETS, BIAS = 1 << 22, -1
#: Sentences end at these bytes.
ENDS = re.compile(rb"[.!?\n]+")
PREFIXES = (5, 6, 7, 8)
STRIP = b".,;:!?\"'()[]{}*#$%&|<>"


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Spans of bytes of the sentences that hold a word."""
    out, start = [], 0
    for m in ENDS.finditer(text):
        if text[start : m.start()].strip():
            out.append((start, m.start()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def words_of(sentence: bytes) -> set[bytes]:
    found = set(sentence.lower().split())
    return {w.strip(STRIP) for w in found} if any(w[-1] in STRIP or w[0] in STRIP for w in found) else found


def features(word: bytes) -> list[int]:
    """Hashes of the word, and of its beginnings (marked by a star) of 5 to 8 bytes that are shorter than it."""
    return [xxhash.xxh32_intdigest(f) % BUCKETS for f in (word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k))]


class WordWeights(dict):
    """word -> sum of the weights of its features, remembered for up to ``most`` words."""

    def __init__(self, weights: dict[int, float], most: int = 200_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(STRIP)
        value = sum(self.weights.get(f, 0.0) for f in features(bare)) if bare else 0.0
        if len(word) <= 64:
            self[word] = value
        return value


def bag(text: bytes) -> tuple[list[int], list[int]]:
    """Features of every sentence (of its distinct words), one after the other, and how many each sentence has."""
    found, sizes = [], []
    for a, b in sentences(text):
        of = [f for w in words_of(text[a:b]) if w for f in features(w)]
        found += of
        sizes.append(len(of))
    return found, sizes


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300) -> dict[int, float]:
    """feature -> weight; BIAS holds the bias, which is all that a sentence without known words gets."""
    if not len(labels) or len(set(labels.tolist())) < 2:
        return {BIAS: -50.0 if not len(labels) or not labels.max() else 0.0}
    found, toxic = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for (f, _), y in zip(bags, labels, strict=True):
        f = np.unique(f)
        found[f] += 1
        toxic[f] += y
    # What is no likelier in toxic documents can't raise a sentence's probability above the bias.
    base = labels.mean()
    vocabulary = np.flatnonzero((found >= LEAST_DOCS) & ((toxic + base) / (found + 1) > 1.5 * base))
    index = np.full(BUCKETS, -1, np.int32)
    index[vocabulary] = np.arange(len(vocabulary))
    row, column, first, n = [], [], [], 0
    for f, sizes in bags:
        first.append(n)
        at = index[f]
        row.append(np.repeat(np.arange(len(sizes)), sizes)[at >= 0] + n)
        column.append(at[at >= 0])
        n += max(len(sizes), 1)  # a bag without a sentence keeps a place
    row, column, first = np.concatenate(row), np.concatenate(column), np.array(first)
    size = np.diff(np.append(first, n))
    y = labels.astype(np.float64)
    p = np.zeros(len(vocabulary) + 1)
    p[-1] = -6.0
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        z = np.bincount(row, p[column], n) + p[-1]
        q = 1 / (1 + np.exp(-np.minimum(z, 60.0)))
        clean = np.add.reduceat(np.log1p(-np.minimum(q, 1 - 1e-9)), first)  # log of prod(1 - p)
        lift = np.exp(clean) / np.maximum(1 - np.exp(clean), 1e-6)
        slope_s = q * np.repeat(np.where(y > 0, -np.minimum(lift, 50.0), 1.0), size)
        slope = np.append(np.bincount(column, slope_s[row], len(vocabulary)), slope_s.sum()) / len(y)
        slope[:-1] += 3e-6 * p[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        p -= 0.15 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        p[:-1] = np.maximum(p[:-1], 0.0)
    return {int(f): float(x) for f, x in zip(vocabulary, p[:-1], strict=True) if x > 0.2} | {BIAS: float(p[-1])}


def sentence_scores(text: bytes, weights: dict[int, float]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    spans, bias, of = sentences(text), weights[BIAS], WordWeights(weights)
    z = np.array([bias + sum(map(of.__getitem__, words_of(text[a:b]))) for a, b in spans])
    return 1 / (1 + np.exp(-np.clip(z, -60, 60))), spans


def score_text(text: bytes, of: WordWeights, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or of the sentences, and those of at least ``least``: first byte, byte after the last, probability."""
    bias, total, n, loud, offending = of.weights[BIAS], 0.0, 0, 0, {}
    for s in ENDS.split(text.lower()):
        words = s.split()
        if not words:
            continue
        # A word with different punctuation around it counts once, as one word.
        if any(z := list(map(of.__getitem__, words))):
            loud += 1
            z = sum({w.strip(STRIP): x for w, x in zip(words, z, strict=True) if x}.values())
            p = 1 / (1 + np.exp(-min(bias + z, 60.0)))
            total += np.log1p(-min(p, 1 - 1e-12))
            if p >= least:
                offending[n] = float(p)
        n += 1
    spans = sentences(text) if offending else []
    return float(-np.expm1(total + (n - loud) * np.log1p(-1 / (1 + np.exp(-bias))))) if n else 0.0, [(*spans[k], p) for k, p in offending.items()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> dict[int, float]:
    """Fits on at most ``sample`` labelled documents outside the held-out fold; their hashed words come to the driver. The sample
    is cut in hash order where it would have more than ``most_features`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t) for t in byte_texts(batch.column(2))]
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x[0]) for x in found], pa.int32()), *lists], names=["place", "label", "n", "words", "sizes"])

    found = labelled_sample(docs, labels, "toxic", sample).mapInArrow(run, "place struct<hash: long, id: string>, label int, n int, words array<int>, sizes array<int>")
    rows = first_whole(found, "n", most_features)
    column = lambda c: [x.values.to_numpy(zero_copy_only=False) for chunk in rows[c].chunks for x in chunk]
    return train(list(zip(column("words"), column("sizes"), strict=True)), np.array(rows["label"].to_pylist(), np.int64))


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, weights: dict[int, float], keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """Columns ``keep``, then score, and offending: spans of bytes of the sentences of at least ``least``, with their
    probabilities; one row per row of ``docs``. Only the text is looked at."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("offending", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordWeights(weights)
        for batch in batches:
            found = [score_text(t, of, least) for t in byte_texts(batch.column(len(keep)))]
            spans = pa.array([[dict(zip(("begin", "end", "score"), x, strict=True)) for x in spans] for _, spans in found], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.float64()), spans], names=schema.names)

    return with_text(docs, keep).mapInArrow(run, schema)


def locate(docs: DataFrame, weights: dict[int, float], least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, begin and end (bytes), sentence, score; those of at least ``least``."""
    scored = score(docs.select("doc_id", "text"), weights, keep=("doc_id", "text"), least=least)
    spans = scored.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), F.explode("offending").alias("x"))
    sentence = F.expr("substring(text, x.begin + 1, x.end - x.begin)").cast("string")
    return spans.select("doc_id", "x.begin", "x.end", sentence.alias("sentence"), "x.score")


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, offending (spans of the sentences to blame)."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "offending")
