"""Arrival of raw data: kinds, health, content hashes and what is known already."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Kinds by file extension.
EXTENSIONS = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def sniff(name: Column, data: Column) -> Column:
    """MIME type: by the head of the content, else by the name, else octet-stream."""
    head = F.lower(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"))
    by_name = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    guess = F.try_element_at(by_name, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    return F.when(F.startswith(head, F.lit("%pdf")), "application/pdf").when(F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html")), "text/html").otherwise(F.coalesce(guess, F.lit("application/octet-stream")))


@F.pandas_udf(T.DoubleType())
def non_utf8_ratio(data: pd.Series) -> pd.Series:
    """Share of bytes that aren't part of valid UTF-8."""
    return data.map(lambda b: (len(b) - len(bytes(b).decode("utf-8", "ignore").encode())) / len(b) if b else 0.0)


def content_key(data: Column) -> Column:
    return F.sha2(data, 256)


def listing_key(files: DataFrame, *keys: str) -> DataFrame:
    """Key of a directory: the hash of its sorted names, joined by bars. Names are sorted by Spark and hashed as they come, so no
    directory is held in memory."""
    kinds = T.StructType([*(files.schema[k] for k in keys), T.StructField("doc_hash", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, name in zip(*columns, strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(name.encode())
                else:
                    digest.update(b"|" + name.encode())
        if digest is not None:
            done.append((*now, digest.hexdigest()))
        columns = list(zip(*done, strict=True)) or [[]] * (len(keys) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)

    named = files.select(*keys, "name").where("name is not null")
    return named.repartition(*keys).sortWithinPartitions(*keys, "name").mapInArrow(run, kinds)


def ingest(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Every incoming row (project_id, doc_id, doc_hash, seq) with the doc_id it gets and whether it is new: a hash the project
    has keeps its document, within the batch the first row makes one. existing: project_id, doc_hash, doc_id."""
    known = existing.groupBy("project_id", "doc_hash").agg(F.min("doc_id").alias("_known"))
    firsts = incoming.groupBy("project_id", "doc_hash").agg(F.min_by("doc_id", "seq").alias("_first"), F.min("seq").alias("_seq"))
    joined = incoming.join(firsts, ["project_id", "doc_hash"]).join(known, ["project_id", "doc_hash"], "left")
    return joined.select("project_id", "doc_id", "doc_hash", F.coalesce("_known", "_first").alias("surviving_doc_id"), (F.col("_known").isNull() & (F.col("seq") == F.col("_seq"))).alias("is_new"))


def with_cache(inputs: DataFrame, cache: DataFrame, keys: list[str], compute) -> tuple[DataFrame, DataFrame]:
    """(results, new cache): results known by key are taken over, only the others are computed, each once."""
    misses = inputs.join(cache, keys, "left_anti").dropDuplicates(keys)
    fresh = compute(misses).select(*keys, "result")
    full = cache.select(*keys, "result").unionByName(fresh)
    return inputs.join(full, keys, "left"), full


def cache_hits(inputs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    known = inputs.join(cache.select(*keys).distinct().withColumn("_k", F.lit(1)), keys, "left")
    return known.agg(F.count("*").alias("requests"), F.count("_k").alias("hits"), F.coalesce(F.count("_k") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("hit_ratio"))


def dispatch(rows: DataFrame, parsers: dict) -> tuple[DataFrame | None, DataFrame]:
    """(parsed, errors): each MIME type goes to its parser (DataFrame -> DataFrame); types without one become error rows."""
    parsed = None
    for mime, parser in parsers.items():
        part = parser(rows.where(F.col("mime") == mime))
        parsed = part if parsed is None else parsed.unionByName(part, allowMissingColumns=True)
    errors = rows.where(~F.col("mime").isin(*parsers) | F.col("mime").isNull()).withColumn("error", F.concat(F.lit("no parser for "), F.coalesce("mime", F.lit("null"))))
    return parsed, errors


def latest_documents(documents: DataFrame, versions: DataFrame) -> DataFrame:
    newest = Window.partitionBy("doc_id").orderBy(F.desc("version"))
    return documents.join(versions.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n"), "doc_id")
