"""Quality rules whose cutoffs are risk-controlled.

Each rule is a number that grows with junk. Labelled good documents are the holdout: within a stratum (a class of length)
the rules' cutoffs are tightened step by step along one path, from rejecting nothing, for as long as an exact binomial test
says that the rules together reject less than the allowed ``risk`` of good documents. A path goes down rule after rule, the
rule with the highest mean among labelled bad documents first; bad documents are no part of the tests, so the path is fixed
before they begin. The tests are corrected for their number: Bonferroni over strata, a fixed sequence over the steps of a
path. With probability ``1 - delta`` no stratum then loses more than ``risk`` of its good documents.

A stratum with fewer good labels than a first step needs (``least_labels``) is joined with a neighbour, by the numbers of
labels alone (``joined``); what is said of a stratum then holds for the joined one, whose path also ends where one of its
strata would lose more than ``risk`` of the good documents labelled there. Only where all labels together are too few
nothing is rejected.

Null texts count as empty. Rows that repeat are measured each for itself, and rows with one text tie. A text of any length is
measured whole. Labels that are null, or of no document, take no part; of a document with several labels the largest counts.
An empty table gives no rows. Other columns, whatever their names, are neither read nor kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, materialize, with_text

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shout")
SPACES, SYMBOLS, UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
#: Upper ends of the strata, in words.
STRATA = (100, 500, 2000)
STEPS = 200
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(index) == len(words):
        return 0
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    size, key, span = len(index), ids[:n], len(index)
    for j in range(1, window):
        if span > (1 << 62) // size:
            _, key = np.unique(key, return_inverse=True)
            span = n
        key = key * size + ids[j : j + n]
        span *= size
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = text.split()
    bare = text.translate(None, SPACES)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return (
        len(words),
        len(bare.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        text.count(b"!!"),
    )


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then the counts of each whole text."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts_of(x) for x in byte_texts(batch.column(len(keep)))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=schema.names)

    return with_text(df, keep, text).mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, F.Column]:
    """Rule -> its value, 0 to 1, higher for junk."""
    share = lambda a, b: F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "shouts": share("n_shout", "n_words"),
    }


def stratum() -> F.Column:
    return reduce(lambda a, x: a + (F.col("n_words") >= x).cast("int"), STRATA, F.lit(0))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed exactly from the log terms."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def least_labels(risk: float, level: float) -> int:
    """The fewest good documents with which rejecting none of them passes a test."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def joined(counts: list[int], least: int) -> list[list[int]]:
    """Strata in groups of neighbours: the smallest group below ``least`` joins its smaller neighbour until there is none."""
    groups = [[s] for s in range(len(counts))]
    total = lambda g: sum(counts[s] for s in g)
    while len(groups) > 1 and total(min(groups, key=total)) < least:
        at = groups.index(min(groups, key=total))
        other = min((k for k in (at - 1, at + 1) if 0 <= k < len(groups)), key=lambda k: total(groups[k]))
        low = min(at, other)
        groups[low : low + 2] = [groups[low] + groups[low + 1]]
    return groups


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> dict[tuple[int, str], int]:
    """(stratum, rule) -> the step above which the rule rejects. Labels of all documents count.

    What comes to the driver is sums and a histogram: at most strata x (rules x STEPS + 1) rows, whatever the input.
    """
    named = rules()
    n_strata, n_path = len(STRATA) + 1, len(named) * STEPS
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    bins = [F.ceil(x * STEPS).cast("int").alias(f"__bin_{r}") for r, x in named.items()]
    marked = measured.where(~base_failed()).select("doc_id", *COUNTS).join(marks.where("__quality in (0, 1)"), "doc_id").select("__quality", stratum().alias("__stratum"), *bins)
    sums = {(r["__stratum"], r["__quality"]): r for r in marked.groupBy("__stratum", "__quality").agg(F.count("*").alias("__n"), *(F.sum(f"__bin_{r}").alias(r) for r in named)).collect()}
    level = delta / n_strata
    groups = joined([sums[s, 1]["__n"] if (s, 1) in sums else 0 for s in range(n_strata)], least_labels(risk, level))
    of_bad = [{rule: sum(sums[s, 0][rule] for s in group if (s, 0) in sums) for rule in named} for group in groups]
    orders = [sorted(named, key=lambda rule: -x[rule]) for x in of_bad]  # stable: equal rules stay in the order of their names
    # Place on its group's path at which a document is rejected for the first time.
    never = n_path + 1
    place = F.lit(never)
    for group, order in zip(groups, orders, strict=True):
        firsts = [F.when(F.col(f"__bin_{rule}") > 0, (k + 1) * STEPS + 1 - F.col(f"__bin_{rule}")) for k, rule in enumerate(order)]
        place = F.when(F.col("__stratum").isin(group), F.coalesce(F.least(*firsts), F.lit(never))).otherwise(place)
    seen = marked.where("__quality = 1").groupBy("__stratum", place.alias("__place")).count().collect()
    chosen = {}
    for group, order in zip(groups, orders, strict=True):
        histogram = np.zeros((n_strata, never + 1), np.int64)
        for row in seen:
            if row["__stratum"] in group:
                histogram[row["__stratum"], row["__place"]] += row["count"]
        n, rejected, tested, last = histogram.sum(axis=1), np.zeros(n_strata, np.int64), -1, 0
        for at in range(1, n_path + 1 if n.sum() else 1):
            rejected += histogram[:, at]
            if (k := int(rejected.sum())) != tested and (binomial_cdf(k, int(n.sum()), risk) > level or (rejected > risk * n).any()):
                break
            tested, last = k, at
        for k, rule in enumerate(order):
            chosen |= {(s, rule): STEPS - min(max(last - k * STEPS, 0), STEPS) for s in group}
    return chosen


def judge(measured: DataFrame, chosen: dict[tuple[int, str], int]) -> DataFrame:
    """Adds base_failed and kept."""
    named = rules()
    bad = [(stratum() == s) & (F.ceil(named[rule] * STEPS) > cut) for (s, rule), cut in chosen.items() if cut < STEPS]
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~reduce(lambda a, b: a | b, bad, F.col("base_failed")))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Per document: doc_id, its counts, base_failed and kept."""
    measured = materialize(measure(docs), "rules")
    return judge(measured, cutoffs(measured, labels, risk, delta))
