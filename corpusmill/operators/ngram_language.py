"""Languages by profiles of letter trigrams, learnt from texts whose language is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import materialize

#: Trigrams of a profile at most, the most frequent ones of all languages together: with some dozens of languages a few million numbers, which are broadcast.
MOST_GRAMS = 50_000
#: What every trigram counts more than it was seen, and by how much a trigram the best language must beat the next on average.
SMOOTHING, MARGIN = 0.5, 0.1
#: Characters that are taken at once; trigrams counted by a table of all that their characters allow, if it has so many places at most; counts that a task holds.
AT_ONCE, DENSE, HELD = 1_000_000, 1 << 22, 1_000_000


def _letters(text: Column) -> Column:
    """The text in lower case, one space for all between its words, none at the ends. Empty where there is no letter."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``AT_ONCE`` characters, or of one text."""
    begin, held = 0, 0
    for k, x in enumerate(texts):
        if k > begin and held + len(x) > AT_ONCE:
            yield begin, k
            begin, held = k, 0
        held += len(x)
    if texts:
        yield begin, len(texts)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts with one space around each, end to end, the places where a trigram begins, and the text of each."""
    chars = np.frombuffer("".join([f" {x} " for x in texts]).encode("utf-32-le"), np.uint32)
    size = np.array([len(x) for x in texts], np.int64)
    count = np.where(size > 0, size, 0)
    of = np.repeat(np.arange(len(texts)), count)
    return chars, np.arange(len(of)) - (np.cumsum(count) - count)[of] + (np.cumsum(size + 2) - size - 2)[of], of


def _codes(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = chars.astype(np.int64)
    return (c[at] << 42) | (c[at + 1] << 21) | c[at + 2]


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the texts, as codes, and how often each is there."""
    chars, at, _ = _trigrams(texts)
    used = np.flatnonzero(np.bincount(chars)) if len(at) else np.zeros(0, np.int64)
    k = len(used)
    if k**3 > DENSE:
        return np.unique(_codes(chars, at), return_counts=True)
    rank = np.zeros(used[-1] + 1 if k else 0, np.int64)
    rank[used] = np.arange(k)
    c = rank[chars]
    counts = np.bincount((c[at] * k + c[at + 1]) * k + c[at + 2], minlength=k**3)
    found = np.flatnonzero(counts)
    return (used[found // k**2] << 42) | (used[found // max(k, 1) % max(k, 1)] << 21) | used[found % max(k, 1)] if k else found, counts[found]


def fit(texts: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_GRAMS) -> DataFrame:
    """The profiles, written: gram, langs array<struct<lang,weight>>, the log-likelihood of the gram in each language. Texts without a language or
    letter teach nothing. Each task counts where texts lie; what it shuffles is a row a trigram and language."""
    said = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), _letters(F.col(text)).alias("x")).where("x <> ''")
    kind = to_arrow_type(said.schema["lang"].dataType)
    counted = T.StructType([T.StructField("gram", T.StringType()), said.schema["lang"], T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def merged(some: list) -> tuple[np.ndarray, np.ndarray]:
            codes, of = np.unique(np.concatenate([x for x, _ in some]), return_inverse=True)
            return codes, np.bincount(of, np.concatenate([n for _, n in some])).astype(np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for name, some in held.items():
                codes, n = merged(some)
                for k in range(0, len(codes), 10_000):
                    grams = ["".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))) for c in codes[k : k + 10_000].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([name] * len(grams), kind), pa.array(n[k : k + 10_000])], names=["gram", "lang", "c"])
            held.clear()

        for batch in batches:
            by: dict = {}
            for name, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(name, []).append(x)
            for name, some in by.items():
                held.setdefault(name, []).extend(_counted(some[a:b]) for a, b in _parts(some))
            if sum(len(x) for some in held.values() for x, _ in some) > HELD:
                held = {name: [merged(some)] for name, some in held.items()}
                if sum(len(some[0][0]) for some in held.values()) > HELD / 2:
                    yield from told()
        yield from told()

    counts = materialize(said.mapInArrow(run, counted).groupBy("gram", "lang").agg(F.sum("c").alias("c")), "gram-counts")
    known = counts.groupBy("gram").agg(F.sum("c").alias("all")).orderBy(F.desc("all"), "gram").limit(most).select("gram")
    known = materialize(known, "profile-grams")
    v = known.count()
    kept = counts.join(F.broadcast(known), "gram")
    totals = kept.groupBy("lang").agg(F.sum("c").alias("n"))
    grid = known.crossJoin(F.broadcast(totals)).join(kept, ["gram", "lang"], "left")  # bounded: grams times languages
    weight = F.log((F.coalesce("c", F.lit(0)) + SMOOTHING) / (F.col("n") + SMOOTHING * v))
    return materialize(grid.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("lang", weight.alias("weight")))).alias("langs")), "profiles")


class _Profiles:
    """Profiles as a table of weights, a row a trigram and a column a language, and how rows are found: by the places of a trigram's characters among
    those that the profiles use, or, where these are many, by its code."""

    def __init__(self, profiles: DataFrame):
        rows = profiles.toArrow()
        langs = rows["langs"].combine_chunks()
        each = langs.flatten()
        self.langs = sorted(set(each.field("lang").to_pylist()))
        column = {x: k for k, x in enumerate(self.langs)}
        codes = np.array([(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in rows["gram"].to_pylist()], np.int64)
        weights = np.zeros((len(codes), len(self.langs)))
        of = np.repeat(np.arange(len(codes)), langs.value_lengths().to_numpy(zero_copy_only=False))
        weights[of, [column[x] for x in each.field("lang").to_pylist()]] = each.field("weight").to_numpy(zero_copy_only=False)
        order = np.argsort(codes)
        self.codes, self.weights = codes[order], np.ascontiguousarray(weights[order].T)
        used = np.unique([self.codes >> 42, self.codes >> 21 & 0x1FFFFF, self.codes & 0x1FFFFF])
        self.used = used if (len(used) + 1) ** 3 <= DENSE else None

    def rows(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of the trigram at each place, -1 where it isn't known."""
        if self.used is None:
            codes = _codes(chars, at)
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            return np.where(self.codes[place] == codes, place, -1)
        k = len(self.used)
        if not hasattr(self, "dense"):  # made where it is used, not sent
            self.rank = np.full(0x110000, k, np.int64)
            self.rank[self.used] = np.arange(k)
            self.dense = np.full((k + 1) ** 3, -1, np.int32)
            self.dense[self.place(self.rank[self.codes >> 42], self.rank[self.codes >> 21 & 0x1FFFFF], self.rank[self.codes & 0x1FFFFF])] = np.arange(len(self.codes))
        c = self.rank[chars]
        return self.dense[self.place(c[at], c[at + 1], c[at + 2])]

    def place(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        k = len(self.used) + 1
        return (a * k + b) * k + c

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-likelihoods, a row a text and a column a language, and the number of known trigrams of each text."""
        score, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in _parts(texts) if len(self.codes) else ():
            chars, at, of = _trigrams(texts[a:b])
            row = self.rows(chars, at)
            of, row = of[row >= 0], row[row >= 0]
            n[a:b] = np.bincount(of, minlength=b - a)
            for k in range(len(self.langs)):
                score[a:b, k] = np.bincount(of, self.weights[k][row], minlength=b - a)
        return score, n


def detect(texts: DataFrame, key: str, profiles: DataFrame, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """All rows of ``texts`` (key unique) with ``detected``: the language of the highest score, null where the text has no known trigram or the best
    language doesn't beat the next by ``margin`` a trigram. Ties go to the code. Profiles are sent to the tasks, and texts scored where they lie."""
    known = _Profiles(profiles)

    @F.pandas_udf(profiles.schema["langs"].dataType.elementType["lang"].dataType)
    def detected(letters: pd.Series) -> pd.Series:
        score, n = known.scores(letters.tolist())
        if not n.any():
            return pd.Series([None] * len(n), dtype=object)
        best = score.argmax(axis=1)
        ranked = np.sort(score, axis=1)
        clear = (n > 0) & (ranked[:, -1] - ranked[:, -2] >= margin * n if len(known.langs) > 1 else True)
        return pd.Series([known.langs[k] if x else None for k, x in zip(best.tolist(), clear.tolist(), strict=True)], dtype=object)

    return texts.withColumn("detected", detected(_letters(F.col(text))))


def page_languages(blocks: DataFrame, profiles: DataFrame, margin: float = MARGIN) -> DataFrame:
    """blocks (doc_id, page, ...) with ``page_lang``, the first language that is detected in a block of the page, in order of block_no."""
    keyed = blocks.withColumn("_id", F.struct("doc_id", "page", "block_no"))
    first = Window.partitionBy("doc_id", "page").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return detect(keyed, "_id", profiles, margin=margin).withColumn("page_lang", F.first("detected", ignorenulls=True).over(first)).select(*blocks.columns, "page_lang")
