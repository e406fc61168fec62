"""Listings with filters and search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

GRAM = 3


def list_documents(documents: DataFrame, versions: DataFrame, projects: DataFrame, project_id=None, scope=None, kind: str | None = None, status: str | None = None, q: str | None = None, include_deleted: bool = False) -> DataFrame:
    """doc_id, project_id, type, status, metadata (JSON text) of documents by their latest versions; ``routing.page_of`` takes a page of them and
    ``count()`` is the total.

    documents: doc_id, project_id, source_type; versions: doc_id, version, status, meta; projects: project_id, is_active. ``scope`` is the
    project that the caller may see: asking for another one is an error. ``q`` is looked for anywhere in the serialised metadata, in
    any case; % and _ in it are wildcards. Documents without a version or project are left out.
    """
    if scope is not None and project_id not in (None, scope):
        raise PermissionError(f"not in project {scope}: {project_id}")
    project_id = scope if scope is not None else project_id
    shown = projects if include_deleted else projects.where("is_active")
    found = documents if project_id is None else documents.where(F.col("project_id") == F.lit(project_id))
    found = found if kind is None else found.where(F.col("source_type") == kind)
    newest = versions.groupBy("doc_id").agg(F.max_by(F.struct("status", "meta"), "version").alias("v"))
    rows = found.join(shown.select("project_id").distinct(), "project_id", "left_semi").join(newest, "doc_id")
    listed = rows.select("doc_id", "project_id", F.col("source_type").alias("type"), F.col("v.status").alias("status"), F.to_json("v.meta").alias("metadata"))
    listed = listed if status is None else listed.where(F.col("status") == status)
    return listed if q is None else listed.where(matches(F.col("metadata"), q))


def matches(text: Column, q: str) -> Column:
    """Whether the text holds ``q``, in any case, with the wildcards % and _."""
    return F.ilike(text, F.lit(f"%{q}%"))


def _grams(text: Column) -> Column:
    """Distinct runs of three characters, lower-cased."""
    chars = F.split(F.lower(text), "")
    n = F.size(chars)
    runs = F.arrays_zip(*(F.slice(chars, F.lit(k), F.greatest(n - (GRAM - 1), F.lit(0))).alias(f"c{k}") for k in range(1, GRAM + 1)))
    return F.array_distinct(F.transform(runs, lambda x: F.concat(*(x[f"c{k}"] for k in range(1, GRAM + 1)))))


def gram_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (gram, key) of the texts, written in the order of grams, so that a search reads the few row groups that hold its own."""
    postings = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(_grams(F.col(text))).alias("gram"))
    return materialize(postings.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").select("gram", "key"), "grams")


def search(index: DataFrame, rows: DataFrame, key: str, text: str, q: str) -> tuple[DataFrame, int | None]:
    """The rows whose text ``matches`` q, and how many candidates were verified for it: rows that hold all runs of three characters between the
    wildcards of q. Where it has no such run all rows are verified, and the number is None. index: ``gram_index`` of the rows."""
    spark = rows.sparkSession
    if "\\" in q:  # an escape may make a wildcard ordinary
        return rows.where(matches(F.col(text), q)), None
    parts = [x for x in re.split("[%_]", q) if x]
    wanted = spark.createDataFrame([(x,) for x in parts], "x string").select(F.explode(_grams(F.col("x"))).alias("g")).distinct() if parts else None
    grams = sorted(r["g"] for r in wanted.collect()) if wanted is not None else []
    if not grams:
        return rows.where(matches(F.col(text), q)), None
    held = index.where(F.col("gram").isin(grams)).groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    candidates = materialize(held.select(F.col("key").alias(key)), "candidates")
    return rows.join(candidates, key, "left_semi").where(matches(F.col(text), q)), candidates.count()


def list_audits(audits: DataFrame, chunks: DataFrame, doc_id=None, user: str | None = None, action: str | None = None, since=None) -> DataFrame:
    """Audits with the doc_id of their chunks, filtered; audits of chunks that aren't there are left out. audits: chunk_id, user, action,
    created_at, ...; chunks: chunk_id, doc_id. The caller orders by created_at, or ``exports.write_audits`` does."""
    mine = chunks.select("chunk_id", "doc_id") if doc_id is None else chunks.where(F.col("doc_id") == F.lit(doc_id)).select("chunk_id", "doc_id")
    found = audits
    for name, value in (("user", user), ("action", action)):
        found = found if value is None else found.where(F.col(name) == F.lit(value))
    found = found if since is None else found.where(F.col("created_at") >= (since if isinstance(since, Column) else F.lit(since)))
    return found.join(mine, "chunk_id")
