"""Phrase mining against brute force and on awkward tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, fp long, n int, words string, a int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    some = ["new", "York", "stock", "exchange", "of", "the", "and", "é漢", "x", "ab", "b", "a"]
    fixed = ["new york stock exchange", "of the", "ab b", "the stock\texchange of", "NEW  York"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b", "!?"]
    out = []
    for i in range(160):
        text = "".join((rng.choice(fixed) if rng.random() < 0.3 else rng.choice(some)) + rng.choice(marks) for _ in range(rng.randrange(0, 40)))
        out.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    out += [(500, None, "en"), (501, "", "en"), (502, " \t. \n", None), (None, "new york stock exchange", "en"), (503, "a " * 30_000, "fr"), (504, "y" * 200_000, "fr"), out[5], out[5]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "w", 3) for r in rows], DOCS).repartition(3)


def brute_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    p = " ".join(words[i : i + k])
                    f[lang][p] += 1
    return f, n


def brute(rows, least, most):
    counts, n = brute_counts(rows)
    out = []
    for lang, f in counts.items():
        found = {}
        for p, a in f.items():
            w = p.split(" ")
            if len(w) > 1 and a >= least:
                found[p] = min((2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
        gone = {p for p in found for q in found if len(q.split(" ")) > len(p.split(" ")) and f" {p} " in f" {q} " and 100 * f[q] >= 80 * f[p]}
        kept = sorted((p for p in found if p not in gone), key=lambda p: (-found[p][0], -f[p], p.encode()))[:most]
        out += [(lang, k + 1, p, f[p], found[p][2], found[p][3], n[lang], found[p][0]) for k, p in enumerate(kept)]
    return sorted(out)


@pytest.mark.parametrize("least,most", [(2, 2000), (8, 5)])
def test_collocations_equal_brute_force(docs, rows, least, most):
    want = brute(rows, least, most)
    got = collocations.collocations(docs, least, most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


@pytest.mark.parametrize("bits,kept", [(64, 64), (1 << 10, 64), (1 << 27, 7), (1 << 27, 1)])
def test_shared_fingerprints_and_full_bit_maps_change_nothing(docs, rows, bits, kept):
    counts, n = brute_counts(rows)
    found, totals = collocations.frequent_phrases(docs, 5, bits=bits, kept=kept)
    want = {(lang, p, len(p.split(" ")), a) for lang, f in counts.items() for p, a in f.items() if a >= 5}
    got = set(map(tuple, found.select("lang", "phrase", "words", "f").collect()))
    parts = {(lang, w) for lang, p, n, _ in want if n > 1 for w in p.split(" ")}
    assert got <= want and {x for x in want if x[2] > 1 or x[:2] in parts} <= got
    assert {r["lang"]: r["n"] for r in totals.collect() if r["n"]} == {k: v for k, v in n.items() if v}


def test_prefix_sums_give_the_polynomials():
    text = b"alpha beta, gamma  alpha beta"
    hashes, checks = collocations.Polynomial(collocations._BASE), collocations.Polynomial(collocations._CHECK_BASE)
    some = collocations.Stretch(["en", "en"], [3, None], [b"Alpha", text], hashes, checks, 64)
    found = [some.text(a, 1) for a in range(6)]
    assert found == [b"alpha", b"alpha", b"beta", b"gamma", b"alpha", b"beta"] and some.piece.tolist() == [0, 1, 1, 2, 2, 2] and some.row.tolist() == [0, *[1] * 5]
    for base, got in ((collocations._BASE, some.words), (collocations._CHECK_BASE, some.checks)):
        value = lambda w, b=base: sum(c * pow(b, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64)
        assert got.tolist() == collocations.mix(np.array([value(w) for w in found], np.uint64)).tolist()
    fps, whole = some.phrases(2)
    assert whole.tolist() == [False, True, False, True, True] and fps[1] == fps[4] and len(set(fps.tolist())) == 4
    assert some.checks_at(np.array([1, 4]), 2).tolist()[0] == some.checks_at(np.array([4]), 2)[0] and some.text(3, 2) == b"gamma alpha"
    again = collocations.Stretch(["en"], [None], [text], hashes, checks, 64)
    assert again.pointers_at(np.arange(5)).tolist() == some.pointers_at(np.arange(1, 6)).tolist()


def test_scores_pass_64_bits(spark):
    big = 4 * 10**18
    found = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)], "lang string, phrase string, words int, f long")
    row = collocations.scored(found).first()
    assert row["score"] == 2_000_000 * (big - 2) // (2 * big - 1)
    assert collocations.independent(collocations.scored(found)).count() == 1


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_no_text_at_all(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, " . ", None)], "doc_id long, text string, lang string")
    assert collocations.collocations(none.withColumn("first_doc_id", F.lit(1))).count() == 0
