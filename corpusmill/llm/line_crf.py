"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. Its evidence is a vector of features of the line and of both neighbours; the chain
ties adjoining lines. Training takes the document's label for each of its lines (a bounded sample of labelled documents).
The score is the mean, weighted by line length, of the forward-backward marginals of "good".

Null and empty texts are one empty line. A row that repeats is scored each time alike, and rows with one text tie. A text of
any length is scored whole, in time in proportion to its lines. Labels that are null or of no document take no part; without
labels every score is 0.5. An empty table gives no rows. Other columns, whatever their names, are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, fold, with_text
from .sampling import first_whole, labelled_sample

#: Features of one line.
WIDTH = 14
#: At most so many labelled documents are fitted on, whole ones in hash order for as long as they have at most so many lines.
SAMPLE, MOST_LINES = 6000, 300_000
#: In training, a longer chain counts as several of so many lines, which only leaves out the ties between those.
CHAIN = 512
LETTERS_UP, LETTERS_LOW, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, and the lines' lengths (1 at least)."""
    lines = text.split(b"\n")
    out, lengths = np.zeros((len(lines), WIDTH), np.float32), np.empty(len(lines), np.float64)
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        n, words = len(line), line.split()
        lengths[i] = max(n, 1)
        k = len(words)
        if not k:
            out[i, 0] = 1
            continue
        count = lambda kind, line=line, n=n: n - len(line.translate(None, kind))
        up, low = count(LETTERS_UP), count(LETTERS_LOW)
        out[i] = (
            0,
            np.log1p(k) / 5,
            k < 4,
            count(b"#*$%&^~@") / k,
            up / (up + low + 1),
            up > low,
            line.count(b"!!") / k,
            line.count(b"|") / k,
            count(DIGITS) / n,
            count(b"<>{}[]=/\\_") / k,
            1 - len(set(words)) / k,
            line in seen,
            (n - k) / k / 10,
            count(b".,") / k,
        )
        seen.add(line)
    return np.clip(out, 0, 3), lengths


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and the line after within its document, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts] = 0
    after[np.append(starts[1:], len(x)) - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, sizes: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and P(two adjoining lines differ) at each line but a document's first.

    ``unary``: log-odds of good. ``pair``: log weight of (bad bad, good good, differing) neighbours. All documents advance
    together, a line at a time, longest first.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    begin, length = starts[order], sizes[order]
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    alpha[starts, 1] = unary[starts]
    longest = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest + 1)]  # documents with more than t lines
    for t in range(1, longest):
        at = begin[: active[t]] + t
        bad, good = alpha[at - 1, 0], alpha[at - 1, 1]
        alpha[at, 0] = _log_add(bad + pair[0], good + pair[2])
        alpha[at, 1] = _log_add(good + pair[1], bad + pair[2]) + unary[at]
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        bad, good = beta[at, 0], beta[at, 1] + unary[at]
        beta[at - 1, 0] = _log_add(bad + pair[0], good + pair[2])
        beta[at - 1, 1] = _log_add(good + pair[1], bad + pair[2])
    total = alpha + beta
    good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    whole = _log_add(total[:, 0], total[:, 1])
    differ = np.zeros(len(unary))
    later = np.setdiff1d(np.arange(len(unary)), starts, assume_unique=True)
    if len(later):
        one = alpha[later - 1, 0] + pair[2] + unary[later] + beta[later, 1]
        two = alpha[later - 1, 1] + pair[2] + beta[later, 0]
        differ[later] = np.exp(_log_add(one, two) - whole[later])
    return good, differ


def train(features: list[np.ndarray], labels: np.ndarray, rounds: int = 120, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Fits weights of the features and the neighbours' tie by Adam on the conditional likelihood of the lines' labels."""
    if len(set(labels.tolist())) < 2:
        rate = float(labels.mean()) if len(labels) else 0.5
        return {"w": np.zeros(3 * WIDTH + 1), "pair": np.zeros(3), "rate": np.array(rate)}
    sizes = np.array([len(x) for x in features])
    starts, documents = np.concatenate(([0], np.cumsum(sizes)[:-1])), len(sizes)
    x = with_neighbours(np.vstack(features), starts).astype(np.float64)
    y = np.repeat(labels, sizes).astype(np.float64)
    weight = np.repeat(1 / sizes**0.5, sizes)  # a long document counts for more than a short one, but not in full
    sizes = np.array([min(CHAIN, n - at) for n in sizes.tolist() for at in range(0, n, CHAIN)])
    p = np.zeros(x.shape[1] + 1)
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        tie = p[-1]
        good, differ = marginals(x @ p[:-1], sizes, np.array([0.0, 0.0, -tie]))
        slope = np.append(x.T @ ((good - y) * weight), -(differ * weight).sum()) / documents + l2 * p
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        p -= 0.15 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        p[-1] = min(max(p[-1], 0.0), 4.0)
    return {"w": p[:-1], "pair": np.array([0.0, 0.0, -p[-1]]), "rate": np.array(-1.0)}


def score_texts(texts: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    """Score of each text: 0 to 1, higher: label 1 likelier."""
    if model["rate"] >= 0 or not texts:
        return np.full(len(texts), float(model["rate"]))
    found = [line_features(t) for t in texts]
    sizes = np.array([len(x) for x, _ in found])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    good, _ = marginals(with_neighbours(np.vstack([x for x, _ in found]), starts) @ model["w"], sizes, model["pair"])
    lengths = np.concatenate([n for _, n in found])
    return np.clip(np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MOST_LINES) -> dict[str, np.ndarray]:
    """Fits on at most ``sample`` labelled documents outside the held-out fold, all lines of each; their features come to the
    driver. The sample is cut in hash order where it would have more than ``most_lines`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [line_features(t)[0] for t in byte_texts(batch.column(2))]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(v.size for v in x)]).astype(np.int32)), pa.array(np.concatenate([v.ravel() for v in x]) if x else np.zeros(0, np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v) for v in x], pa.int32()), flat], names=["place", "label", "lines", "x"])

    found = labelled_sample(docs, labels, "quality", sample).mapInArrow(run, "place struct<hash: long, id: string>, label int, lines int, x array<float>")
    rows = first_whole(found, "lines", most_lines)
    features = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float32).reshape(-1, WIDTH) for chunk in rows["x"].chunks for x in chunk]
    return train(features, np.array(rows["label"].to_pylist(), np.int64))


def score(docs: DataFrame, model: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """Columns ``keep``, then the score; one row per row of ``docs``. Only the text is looked at."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(score_texts(list(byte_texts(part.column(len(keep)))), model))], names=schema.names)

    return with_text(docs, keep).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))

