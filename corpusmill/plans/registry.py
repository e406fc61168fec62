"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import document_windows
from ..sources.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 120 words with an overlap of 20: doc_id, lang, source, order, text, text_hash, chunk_id (doc-order)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return document_windows(docs).withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("order").cast("string")))


#: The same chunks in SQL.
CHUNKS = r"""WITH tok AS (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 120 THEN 1 ELSE CAST(ceil((len(w) - 120) / 100.0) AS BIGINT) + 1 END AS k FROM tok),
cut AS (SELECT doc_id, lang, source, i AS ord, array_to_string(list_slice(w, i * 100 + 1, i * 100 + 120), ' ') AS text FROM win, unnest(range(k)) t(i)),
chunks AS (SELECT *, sha256(lower(text)) AS text_hash, doc_id || '-' || ord AS chunk_id FROM cut)
"""


def audits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations from events: chunk = event_id mod 211, user = user_id mod 7, the label is the event's type."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), (F.col("event_id") % 211).alias("chunk_id"), (F.col("user_id") % 7).alias("user"), F.col("ts").alias("created_at"), F.col("event_type").alias("value"))
    previous = F.lag("value").over(Window.partitionBy("chunk_id").orderBy("created_at", "audit_id"))
    before = F.when(previous.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("label"), previous))
    return e.withColumn("before", before).withColumn("after", F.create_map(F.lit("label"), "value")).withColumn("action", F.lit("metadata_update"))


AUDITS = """WITH ev AS (SELECT event_id AS audit_id, event_id % 211 AS chunk_id, user_id % 7 AS usr, ts AS created_at, event_type AS value FROM events),
audits AS (SELECT *, lag(value) OVER (PARTITION BY chunk_id ORDER BY created_at, audit_id) AS before FROM ev)
"""
