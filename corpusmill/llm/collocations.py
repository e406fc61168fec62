"""Phrase collocation mining by Rabin-Karp fingerprints.

A text is split at punctuation and line ends into pieces and those at spaces and tabs into words; phrases of one to ``LONGEST`` words lie
within a piece. A word's fingerprint is a polynomial of its bytes, a phrase's one of its words' fingerprints, both modulo 2^64, and
both come from differences of prefix sums, so numpy hashes every phrase of a stretch of texts at once. Fingerprints hold the language.

1. Words and pairs: each task adds up fingerprints in runs of some millions, and one shuffle adds these up. A fingerprint brings its count,
   the sum of its occurrences' checks (a second, independent hash of the phrase), and a pointer to one occurrence.
2. Longer phrases likewise, those alone whose pairs are all frequent: a phrase is never more frequent than a part of it. Also noted is
   which words belong to frequent pairs.
3. The occurrences that pointers of frequent fingerprints name give their texts: only frequent phrases are ever made, each once.
   A fingerprint is verified against its text: the sum of the checks must be the count times the check of the text.
4. Fingerprints that fail, because different phrases share them, are counted by text instead, wherever they occur.

The sets that passes look into (frequent fingerprints, pointers, failures) are bit maps of fixed size (``FILTER_BITS``), broadcast. They may say
yes for what isn't in the set, which an exact join or count then leaves out, and never no for what is. More entries make them less selective,
not larger.

Null and empty texts hold no word. A null language is ``und``. Rows that repeat count each for itself. A text of any length is taken
whole. Ties of rank are in the order of the phrase's bytes. Other columns, whatever their names, are neither read nor kept. An empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_texts, materialize

LONGEST, LEAST_COUNT, TOP = 4, 30, 2000
#: Of a candidate's occurrences so many of 100 inside one longer candidate make it a part of that.
WITHIN = 80
SCALE = 2_000_000
FILTER_BITS = 1 << 27
#: Bytes of text hashed at once, and fingerprints counted at once.
STRETCH, RUN = 1 << 17, 3_000_000
#: Rows of an Arrow batch that goes back to the JVM.
ROWS = 250_000
#: Sums of checks are taken modulo this; pointers are below it.
MODULUS = 1 << 31
#: Shares into which the ranking of a language is dealt first.
SHARES = 64

_WORD, _GAP, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _OUTER = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_CHECK_BASE, _CHECK_OUTER = 0xA0761D6478BD642F, np.uint64(0xE7037ED1A0B428DB)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _SPREAD
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Polynomial:
    """Hashes of parts of byte strings by one base. Its powers are kept, as are those of its inverse, which moves a difference of prefix
    sums to the power zero."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def parts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data):
            n = max(len(data), 2 * STRETCH)
            self.up, self.down = powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[begin]) * self.down[begin])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and piece of each word of lower-cased bytes."""
    kind = _KIND[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = kind == _WORD
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2], np.searchsorted(np.flatnonzero(kind == _BREAK), edges[::2])


class Stretch:
    """Some texts, joined by line ends: langs, doc_ids and lower-cased bytes of the rows; begin, end, hash, check, piece and row of each word."""

    def __init__(self, langs: list[str], ids: list, texts: list[bytes], hashes: Polynomial, checks: Polynomial, kept: int):
        self.langs, self.ids, self.kept = langs, ids, kept
        self.data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        self.begin, self.end, self.piece = words_of(self.data)
        self.words, self.checks = (x.parts(self.data, self.begin, self.end) for x in (hashes, checks))
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        self.row = np.searchsorted(edges[1:], self.begin, "right")
        self.lang = lang_numbers(langs)[self.row]
        doc = np.array([0 if x is None else x for x in ids], np.int64).view(np.uint64)
        self.place = mix(mix(doc)[self.row] + (self.begin - edges[self.row]).astype(np.uint64))

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the phrases of n words that begin at each word, and whether they lie in one piece. ``kept`` bits of a hash count;
        fewer make phrases share a fingerprint. The lowest bit tells words from longer phrases."""
        count = max(0, len(self.words) - n + 1)
        h = self.lang[:count] + np.uint64(n)
        for k in range(n):
            h = h * _OUTER + self.words[k : k + count]
        return (mix(h) >> np.uint64(64 - self.kept)).view(np.int64) & -2 | (n == 1), self.piece[n - 1 :] == self.piece[:count]

    def checks_at(self, at: np.ndarray, n: int) -> np.ndarray:
        """Checks of the phrases of n words that begin at these words."""
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _CHECK_OUTER + self.checks[at + k]
        return (mix(h) >> np.uint64(33)).view(np.int64)

    def pointers_at(self, at: np.ndarray) -> np.ndarray:
        """A number for each place, made of doc_id and the byte in the text; the same in every pass."""
        return (self.place[at] >> np.uint64(33)).view(np.int64)

    def text(self, a: int, n: int) -> bytes:
        return b" ".join(self.data[self.begin[a] : self.end[a + n - 1]].tobytes().split())


def stretches(batches: Iterator[pa.RecordBatch], kept: int = 64) -> Iterator[Stretch]:
    """batches: lang, text, doc_id. Texts are joined up to ``STRETCH`` bytes, each in pieces of its own."""
    hashes, checks = Polynomial(_BASE), Polynomial(_CHECK_BASE)
    for batch in batches:
        langs, ids, texts, size = [], [], [], 0
        for lang, text, doc_id in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            langs.append(lang)
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= STRETCH:
                yield Stretch(langs, ids, texts, hashes, checks, kept)
                langs, ids, texts, size = [], [], [], 0
        if texts:
            yield Stretch(langs, ids, texts, hashes, checks, kept)


def lang_numbers(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def positions(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each fingerprint in a map of a power of two of bits."""
    return fps & (bits - 1), (fps >> 32) & (bits - 1)


def bit_map(spark: SparkSession, members: DataFrame, bits: int):
    """A broadcast bit map of numbers (column fp): bits / 8 bytes, however many they are."""
    places = F.array(F.col("fp").bitwiseAND(bits - 1), F.shiftright("fp", 32).bitwiseAND(bits - 1))
    at = members.select(F.explode(places).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast(table)


def holds(table: np.ndarray, fps: np.ndarray) -> np.ndarray:
    found = np.ones(len(fps), bool)
    for at in positions(fps, 64 * len(table)):
        found &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return found


def owner_numbers(fps: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """A number for a fingerprint at a place, the same as ``owner_number``."""
    return fps ^ (pointers << 32) ^ (pointers << 1)


def owner_number(fp: F.Column, pointer: F.Column) -> F.Column:
    return fp.bitwiseXOR(F.shiftleft(pointer, 32)).bitwiseXOR(F.shiftleft(pointer, 1))


_SUMS = ("fp", "n", "checks", "pointer")


def added_up(runs: Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]], most: int = RUN) -> Iterator[pa.RecordBatch]:
    """fp, n, checks (modulo ``MODULUS``), pointer (the least) of runs of about ``most`` fingerprints; those without checks are only noted, with
    n = 0. runs: fingerprints, checks, pointers."""

    def batches_of(parts: list[tuple], noted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        fps = np.concatenate([*(p[0] for p in parts), none])
        order = np.argsort(fps)
        fps, some = fps[order], np.unique(np.concatenate([*noted, none]))
        starts = np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1]))) if len(fps) else none
        n = np.diff(np.append(starts, len(fps)))
        fps = np.concatenate([fps[starts], some])

        def reduced(f: np.ufunc, i: int) -> np.ndarray:
            values = np.concatenate([*(p[i] for p in parts), none[:0].astype(np.int32)])[order]
            return f.reduceat(values, starts, dtype=np.int64) if len(starts) else none

        rest = np.zeros(len(some), np.int64)
        columns = [fps, *(np.concatenate([x, rest]) for x in (n, reduced(np.add, 1) % MODULUS, reduced(np.minimum, 2)))]
        parts.clear()
        for k in range(0, len(fps), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS]) for c in columns], names=list(_SUMS))

    parts, noted, size = [], [], 0
    for fps, checks, pointers in runs:
        if checks is None:
            noted.append(fps)
        else:
            parts.append((fps, checks.astype(np.int32), pointers.astype(np.int32)))
        size += len(fps)
        if size >= most:
            yield from batches_of(parts, noted)
            parts, noted, size = [], [], 0
    if size:
        yield from batches_of(parts, noted)


def frequent_fingerprints(texts: DataFrame, runs, least: int, kept: int, tag: str) -> DataFrame:
    """fp, n, checks, pointer of fingerprints with at least ``least`` occurrences, or only noted (n = 0), written. runs: of a stretch.

    Tasks add up before the shuffle, so Spark gets the rows dealt by fingerprint and adds them up once, after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(x for stretch in stretches(batches, kept) for x in runs(stretch))

    found = texts.mapInArrow(run, "fp long, n long, checks long, pointer long")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = found.repartition(parts, "fp").groupBy("fp").agg(F.sum("n").alias("n"), F.sum("checks").alias("checks"), F.min("pointer").alias("pointer"))
    return materialize(total.where((F.col("n") >= least) | (F.col("n") == 0)), tag)


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, bits: int = FILTER_BITS, kept: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of two words or more with at least ``least`` occurrences, and of the words of such pairs. And
    (lang, n) with the number of words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))

    def summed(stretch: Stretch, fps: np.ndarray, at: np.ndarray, n: int) -> tuple:
        return fps[at], stretch.checks_at(at, n), stretch.pointers_at(at)

    def short(stretch: Stretch) -> Iterator[tuple]:
        for n in (1, 2):
            fps, whole = stretch.phrases(n)
            yield summed(stretch, fps, np.flatnonzero(whole), n)

    few = frequent_fingerprints(texts, short, least, kept, "frequent-pairs")
    is_word = F.col("fp").bitwiseAND(1) == 1
    pairs = bit_map(spark, few.where(~is_word), bits)

    def long(stretch: Stretch) -> Iterator[tuple]:
        fps, whole = stretch.phrases(2)
        run = good = holds(pairs.value, fps) & whole
        at = np.flatnonzero(good)
        yield np.unique(stretch.phrases(1)[0][np.concatenate([at, at + 1])]), None, None
        for n in range(3, longest + 1):
            run = run[:-1] & good[n - 2 :]
            yield summed(stretch, stretch.phrases(n)[0], np.flatnonzero(run), n)

    more = frequent_fingerprints(texts, long, least, kept, "frequent-phrases")
    noted, longer = more.where("n = 0"), more.where("n > 0")
    frequent = materialize(few.where(is_word).join(noted.select("fp"), "fp", "left_semi").union(few.where(~is_word)).union(longer), "frequent")
    owners = bit_map(spark, frequent.select(owner_number(F.col("fp"), F.col("pointer")).alias("fp")), bits)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for stretch in stretches(batches, kept):
            rows = []
            for n in range(1, min(longest, len(stretch.words)) + 1):
                fps, whole = stretch.phrases(n)
                at = np.flatnonzero(whole & holds(owners.value, owner_numbers(fps, stretch.pointers_at(np.arange(len(fps))))))
                rows += zip(fps[at].tolist(), stretch.pointers_at(at).tolist(), stretch.checks_at(at, n).tolist(), [stretch.langs[r] for r in stretch.row[at].tolist()], [n] * len(at), [stretch.text(a, n) for a in at.tolist()], strict=True)
            for lang, count in zip(stretch.langs, np.bincount(stretch.row, minlength=len(stretch.langs)).tolist(), strict=True):
                totals[lang] += count
            yield batch_of(rows)
        yield batch_of([(0, n, 0, lang, 0, b"") for lang, n in totals.items()])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["fp", "pointer", "check", "lang", "words", "phrase"])

    named = materialize(texts.mapInArrow(owned, "fp long, pointer long, check long, lang string, words int, phrase binary"), "named-phrases")
    totals = named.where("words = 0").groupBy("lang").agg(F.sum("pointer").alias("n"))
    one = named.where("words > 0").groupBy("fp", "pointer").agg(F.min(F.struct("lang", "words", "phrase", "check")).alias("x"))
    verified = materialize(frequent.join(one, ["fp", "pointer"], "left"), "verified-phrases")
    right = F.coalesce(F.pmod(F.pmod("n", F.lit(MODULUS)) * F.col("x.check"), F.lit(MODULUS)) == F.pmod("checks", F.lit(MODULUS)), F.lit(False))
    found = verified.where(right).select("x.lang", F.col("x.phrase").cast("string").alias("phrase"), "x.words", F.col("n").alias("f"))
    failed = verified.where(~right).select("fp")
    if failed.limit(1).count():
        found = found.unionByName(counted_by_text(texts, bit_map(spark, failed, bits), failed, least, longest, kept))
    return found, totals


def counted_by_text(texts: DataFrame, shared, fps: DataFrame, least: int, longest: int, kept: int) -> DataFrame:
    """lang, phrase, words, f of the phrases whose fingerprint is among ``fps``; ``shared``: their bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in stretches(batches, kept):
            counts: Counter = Counter()
            for n in range(1, min(longest, len(stretch.words)) + 1):
                found, whole = stretch.phrases(n)
                at = np.flatnonzero(whole & holds(shared.value, found))
                counts.update((fp, stretch.langs[r], n, stretch.text(a, n)) for a, fp, r in zip(at.tolist(), found[at].tolist(), stretch.row[at].tolist(), strict=True))
            rows = [(*key, f) for key, f in counts.items()]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["fp", "lang", "words", "phrase", "f"])

    found = texts.mapInArrow(run, "fp long, lang string, words int, phrase binary, f long").join(fps, "fp", "left_semi")
    total = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialize(total.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f"), "counted-phrases")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words and more, by its lowest-scoring cut."""
    parts = F.split("phrase", " ")
    joined = lambda x: F.array_join(x, " ")
    cuts = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), parts.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("left"), joined(F.slice("w", F.col("k") + 1, F.col("words"))).alias("right"))
    known = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))


def independent(candidates: DataFrame, within: int = WITHIN) -> DataFrame:
    """Candidates without those of which a longer candidate that holds them makes up ``within`` of 100 occurrences or more."""
    longer = candidates.where("words > 2").select("lang", F.split("phrase", " ").alias("w"), "words", F.col("a").alias("f"))
    sizes = longer.select("lang", "w", "words", "f", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    parts = sizes.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = parts.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("f"))
    share = F.expr(f"cast(100 as decimal(10,0)) * cast(f as decimal(19,0)) >= cast({within} as decimal(10,0)) * cast(a as decimal(19,0))")
    return candidates.join(inside, ["lang", "phrase"], "left").where(F.col("f").isNull() | ~share).drop("f")


def top(candidates: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` of each language with their rank; shares of a language are ranked alone first, so no task gets a whole one."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST_COUNT, most: int = TOP) -> DataFrame:
    """Per language the first ``most`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent_phrases(docs, least)
    best = top(independent(materialize(scored(found), "scored-phrases")), most)
    return best.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
