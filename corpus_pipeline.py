"""Documents to training sequences: five stages, each on what the one before kept.

All stages keep the columns of the documents, whatever their names, but the last. Null and empty texts are judged as texts
without words: the classifier scores them as one empty line, and the quality rules reject them (fewer than ten words). Texts of
any length are taken whole. Rows with one text tie and are treated alike, except that one of them stays in the Jaccard join.
Rows that repeat are rows of their own up to there. An empty table passes all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import jaccard_join, line_crf, line_dedup, packing, quality_rules
from corpusmill.llm.common import materialize, small_batches, table

#: Documents that score below are rejected.
QUALITY_CUTOFF = 0.3
#: Losers are broadcast up to so many ids; beyond, they are joined.
BROADCAST_IDS = 1_000_000


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns as one, so that no name of a stage's own can clash with one of the documents'."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line model scores at least ``QUALITY_CUTOFF``."""
    small_batches(spark)
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score(_packed(docs), model, keep=("__row",))
    return _unpacked(scored.where(F.col("score") >= QUALITY_CUTOFF), docs)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the risk-controlled cutoffs.

    Texts are measured once for the cutoffs and once more where they are filtered, which spares them a shuffle.
    """
    chosen = quality_rules.cutoffs(materialize(quality_rules.measure(docs), "rules"), table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(quality_rules.measure(_packed(docs), keep=("__row",)), chosen)
    return _unpacked(judged.where("kept"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes from later documents the blocks of lines that they share with earlier ones; no document goes."""
    done = line_dedup.dedup_lines(_packed(docs))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(fresh.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows that share a doc_id stay together: they go only if each of them is to go, and of full repeats one stays. Rows
    without a doc_id can't be named as losers and stay.
    """
    found = materialize(jaccard_join.join(docs), "groups")
    by_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("goes"), F.count("*").alias("n"))
    by_id = materialize(by_id.where("goes or n > 1"), "losers")
    losers = by_id.where("goes").select("doc_id")
    losers = F.broadcast(losers) if losers.count() <= BROADCAST_IDS else losers
    kept = _packed(docs).join(losers, "doc_id", "left_anti")
    repeats = by_id.where("n > 1 and not goes").select("doc_id")
    if repeats.limit(1).count():
        many = kept.join(repeats, "doc_id", "left_semi").dropDuplicates()
        kept = kept.join(repeats, "doc_id", "left_anti").unionByName(many)
    return _unpacked(kept, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows of each document with their texts, and the bins they lie in: rows of a bin, by position, are a sequence.

    Of linked documents one is left by now, so a duplicate cluster is a text that several rows without or with one doc_id have.
    """
    return packing.sequences(docs, packing.pack(docs)).drop("row")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: The classifier is trained and the alignment is a sequence algorithm: SQL has no form of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
