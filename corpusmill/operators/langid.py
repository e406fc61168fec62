"""Language of a text by frequent words; any pandas UDF of the same shape can take its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Frequent words by language.
STOP_WORDS = {
    "en": "the of and to in that is was for on with as are be this from by it at or".split(),
    "de": "der die und das den von zu mit ist des im dem nicht ein eine als auch auf für sich".split(),
    "fr": "le la les de des et un une du en que qui est pour dans sur pas au par ce".split(),
    "es": "el la los de y que en un una se del las por con para es al lo como su".split(),
}


def detect(text: Column) -> Column:
    """The language most of whose frequent words the text holds; null where none is found; ties to the code."""
    words = tokens(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")))
    score = lambda lang: F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS[lang])))
    ranked = F.array_sort(F.array(*(F.struct((-score(k)).alias("s"), F.lit(k).alias("lang")) for k in sorted(STOP_WORDS))))
    return F.when(ranked[0]["s"] < 0, ranked[0]["lang"])


def page_languages(pages: DataFrame) -> DataFrame:
    """doc_id, page, lang of the joined texts of each page. pages: doc_id, page, block_no, text."""
    joined = pages.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), " ").alias("t"))
    return joined.select("doc_id", "page", detect(F.col("t")).alias("lang"))
