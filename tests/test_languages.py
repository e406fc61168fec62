"""Trigram profiles on texts whose language is known."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ngram_language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def profiles(documents):
    return ngram_language.fit(documents.where("doc_id % 5 <> 0"))


def share(found):
    row = found.agg(F.avg((F.col("detected") == F.col("lang")).cast("int")).alias("right"), F.avg(F.col("detected").isNull().cast("int")).alias("open"), F.count("*").alias("n")).first()
    return row["right"] or 0.0, row["open"], row["n"]


@pytest.mark.parametrize("words,right,open_", [(20, 0.98, 0.05), (5, 0.9, 0.2)])
def test_held_out_texts(documents, profiles, words, right, open_):
    cut = documents.where("doc_id % 5 = 0").withColumn("w", F.split("text", r"\s+")).where(F.size("w") >= words).select("doc_id", "lang", F.array_join(F.slice("w", 1, words), " ").alias("text"))
    found, unknown, n = share(ngram_language.detect(cut, "doc_id", profiles))
    assert n > 100 and found >= right and unknown <= open_


def test_texts_without_a_language(spark, profiles):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... 456"), (4, "漢字漢字"), (5, "The the of and " * 2000), (6, "x")], "id int, text string")
    found = {r["id"]: r["detected"] for r in ngram_language.detect(rows, "id", profiles).collect()}
    assert found.keys() == {1, 2, 3, 4, 5, 6} and [found[k] for k in (1, 2, 3, 4)] == [None] * 4 and found[5] == "en"


def test_profiles_of_little(spark):
    rows = spark.createDataFrame([("aba aba", "x"), ("cdc", "y"), (None, "z"), ("abab", None), ("!!", "y")], "text string, lang string")
    p = ngram_language.fit(rows)
    assert {x["lang"] for r in p.collect() for x in r["langs"]} == {"x", "y"}
    asked = spark.createDataFrame([(1, "aba"), (2, "cdc cdc"), (3, "zzz")], "id int, text string")
    assert {r["id"]: r["detected"] for r in ngram_language.detect(asked, "id", p).collect()} == {1: "x", 2: "y", 3: None}
    assert ngram_language.fit(rows.limit(0)).count() == 0


def test_first_language_of_a_page(spark, profiles):
    rows = [(1, 1, 0, "123"), (1, 1, 1, "der die und das ist nicht eine Einheit"), (1, 1, 2, "the of and the other one that is"), (1, 2, 3, "...")]
    got = ngram_language.page_languages(spark.createDataFrame(rows, "doc_id int, page int, block_no int, text string"), profiles).orderBy("block_no").collect()
    assert [r["page_lang"] for r in got] == ["de", "de", "de", None]


@pytest.mark.parametrize("dense", [0, 1 << 22])
def test_counts_and_scores_by_hand(spark, monkeypatch, dense):
    for name, value in (("DENSE", dense), ("AT_ONCE", 40), ("HELD", 30)):
        monkeypatch.setattr(ngram_language, name, value)
    texts = [(k, x, "ab"[k % 2]) for k, x in enumerate(["Abra cadabra, ÉÉ", "x", "漢字 漢 字漢字", "😀 a 𝒳𝒴 b", "", "abra " * 30, "cad bra abr"])]
    df = spark.createDataFrame(texts, "id int, text string, lang string")

    def grams(t):
        x = "".join(c if c.isalpha() else " " for c in t.lower())
        x = f" {' '.join(x.split())} "
        return [x[k : k + 3] for k in range(len(x) - 2)] if x.strip() else []

    counts = {lang: collections.Counter(g for _, t, of in texts if of == lang for g in grams(t)) for lang in "ab"}
    known = sorted({g for c in counts.values() for g in c}, key=lambda g: (-sum(c[g] for c in counts.values()), g.encode()))[:12]
    total = {lang: sum(c[g] for g in known) for lang, c in counts.items()}
    weight = {g: {lang: math.log((counts[lang][g] + 0.5) / (total[lang] + 0.5 * len(known))) for lang in "ab"} for g in known}
    profiles = ngram_language.fit(df, most=12)
    got = {r["gram"]: {x["lang"]: x["weight"] for x in r["langs"]} for r in profiles.collect()}
    assert got.keys() == weight.keys() and all(got[g][x] == pytest.approx(weight[g][x]) for g in known for x in "ab")
    score, n = ngram_language._Profiles(profiles).scores([" ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) for _, t, _ in texts])
    assert n.tolist() == [sum(g in weight for g in grams(t)) for _, t, _ in texts]
    assert all(score[k].tolist() == pytest.approx([sum(weight[g][x] for g in grams(t) if g in weight) for x in "ab"]) for k, t, _ in texts)


def test_detection_shuffles_no_trigrams(spark, documents, profiles):
    plan = ngram_language.detect(documents.select("doc_id", "text"), "doc_id", profiles)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
