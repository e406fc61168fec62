"""Bounded samples of labelled documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """place, label int, text of the ``most`` first labelled documents outside fold 0, in the order of place (a hash of the id).

    The sampled ids (``most`` at most, a fixed bound) are broadcast, and only their texts are shuffled. Where an id has several
    labels the largest counts, where it has several rows the one whose text has the least hash.
    """
    place = F.struct(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").cast("string").alias("id"))
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), F.col("doc_id").cast("string"))
        .limit(most)
    )
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", F.col("__label").alias("label")).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return once.select(place.alias("place"), "label", F.col("x.text").alias("text"))


def first_whole(rows: DataFrame, size: str, most: int) -> pa.Table:
    """The rows (one a sampled document) in the order of their place, for as long as the sum of column ``size`` is at most
    ``most``; what comes to the driver is that much and a place and a size of each sampled document."""
    rows = materialize(rows, "sample")
    total, last = 0, None
    for r in sorted(rows.select("place.hash", "place.id", F.col(size).alias("size")).collect(), key=lambda r: (r["hash"], r["id"])):
        total += r["size"]
        if total > most:
            break
        last = r
    place = F.struct(F.col("place.hash"), F.col("place.id"))
    within = F.lit(False) if last is None else place <= F.struct(F.lit(last["hash"]).alias("hash"), F.lit(last["id"]).alias("id"))
    return rows.where(within).orderBy("place.hash", "place.id").drop("place").toArrow()
