"""Streaming forms; each shares its logic with the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.curation import merge
from ..sources.shared import materialize


def request_rates(requests: DataFrame, limit: int = 60, width: str = "60 seconds", watermark: str | None = "5 minutes") -> DataFrame:
    """Requests per key and tumbling window, those above the limit flagged. Works on a stream (ts, key) and on a table."""
    rows = requests.withWatermark("ts", watermark) if watermark and requests.isStreaming else requests
    counted = rows.groupBy(F.window("ts", width).alias("w"), "key").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "key", "n", (F.col("n") > limit).alias("limited"))


def event_counts(events: DataFrame, width: str = "1 hour", watermark: str | None = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def new_documents(arrivals: DataFrame, stored: DataFrame | None = None, watermark: str = "1 hour") -> DataFrame:
    """Arrivals (project_id, doc_hash, ts, ...) whose hash is new: not among the ``stored`` ones (project_id, doc_hash) of the
    project, and, of a stream, not seen within the watermark; of a table the first by ts stays."""
    fresh = arrivals if stored is None else arrivals.join(stored.select("project_id", "doc_hash").distinct(), ["project_id", "doc_hash"], "left_anti")
    if arrivals.isStreaming:
        return fresh.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["project_id", "doc_hash"])
    first = Window.partitionBy("project_id", "doc_hash").orderBy("ts")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fold_patches(events: DataFrame) -> DataFrame:
    """One patch per chunk out of many, the later event's values over the earlier's. events: chunk_id, user, patch, event_no."""
    one = events.select("chunk_id", "event_no", "user", F.explode("patch").alias("k", "v"))
    last = one.groupBy("chunk_id", "k").agg(F.max_by("v", "event_no").alias("v"))
    user = events.groupBy("chunk_id").agg(F.max_by("user", "event_no").alias("user"), F.count("*").alias("n_events"))
    return last.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("patch")).join(user, "chunk_id")


def apply_events(chunks: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, audits) after all events in order of event_no. Every event that changes something adds one revision and one
    audit, whose before and after hold the fields that it changes.

    Each field of each event is compared with the one before it, or with the stored value: rows of a chunk and field are sorted,
    never gathered. Fields without a value are left out of an audit. events: chunk_id, event_no, user, patch map<string,string>.
    """
    stored = chunks.select("chunk_id", F.explode("curated").alias("k", "stored"))
    said = events.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "event_no", "user", F.explode("patch").alias("k", "v"))
    w = Window.partitionBy("chunk_id", "k").orderBy("event_no")
    placed = said.withColumn("_n", F.row_number().over(w)).withColumn("_lag", F.lag("v").over(w)).join(stored, ["chunk_id", "k"], "left")
    moved = placed.withColumn("old", F.when(F.col("_n") == 1, F.col("stored")).otherwise(F.col("_lag"))).where(~F.col("old").eqNullSafe(F.col("v")))
    moved = materialize(moved.select("chunk_id", "event_no", "user", "k", "old", "v"), "moved")
    entries = lambda c: F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("k", F.col(c).alias("x")))), lambda e: e["x"].isNotNull()))
    audits = moved.groupBy("chunk_id", "event_no", "user").agg(entries("old").alias("before"), entries("v").alias("after"))
    last = moved.groupBy("chunk_id", "k").agg(F.max_by("v", "event_no").alias("v"))
    patches = last.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_patch"))
    counts = moved.groupBy("chunk_id").agg(F.countDistinct("event_no").alias("_n"))
    joined = chunks.join(patches, "chunk_id", "left").join(counts, "chunk_id", "left")
    now = F.when(F.col("_patch").isNull(), F.col("curated")).otherwise(merge(F.col("curated"), F.col("_patch")))
    return joined.withColumn("curated", now).withColumn("rev", F.col("rev") + F.coalesce("_n", F.lit(0))).drop("_patch", "_n"), audits


def curate_stream(events: DataFrame, read_chunks, write_chunks, write_audits, checkpoint: str, **options):
    """Applies a stream of annotation events batch by batch. ``read_chunks(number)`` gives the chunks as they were before batch
    ``number``; ``write_audits`` and ``write_chunks`` take a DataFrame and the batch's number and replace what they wrote for that
    number before, so that a batch that comes again after a failure, at whatever point, leaves the same state."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        chunks, audits = apply_events(read_chunks(number), rows)
        write_audits(audits, number)
        write_chunks(chunks, number)
        rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).options(**options)
