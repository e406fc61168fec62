"""Exports and releases as files that are whole or not there.

An export lies below an id made of everything that decides its rows: format, documents, taxonomy version, template, filters, project settings,
near-duplicate, personal-data and split settings. An attempt writes into a folder of its own; ``manifest.json`` comes last, by a rename, and
names that folder. So an export with a manifest is complete and left as it is, and what a broken attempt has left behind is never read.
Counts are observed while rows are written, not counted after.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, releases
from . import chunks as files
from .shared import materialize

FORMATS = ("jsonl", "csv", "parquet", "bundle")


@dataclass(frozen=True)
class Settings:
    """What is exported and how. template: field -> SQL expression, or a preset's name."""

    template: dict[str, str] | str
    fmt: str = "jsonl"
    taxonomy_version: int = 1
    filters: tuple[str, ...] = ()
    project: dict = field(default_factory=dict)
    drop_near_dupes: bool = False
    dupe_threshold: float = 0.85
    exclude_pii: bool = True
    split_by: tuple[str, ...] = ()
    fractions: dict[str, float] = field(default_factory=dict)
    seed: int = 0
    tolerance: float = 0.03

    def fields(self) -> dict[str, str]:
        return files.fields_of(self.template) if isinstance(self.template, str) else files.fields_of(template=self.template)

    def template_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.fields(), sort_keys=True).encode()).hexdigest()


def export_id(settings: Settings, doc_ids: DataFrame) -> str:
    """Of the settings and the set of documents (doc_id)."""
    h = releases.tree_hash(doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().select(F.sha2("doc_id", 256).alias("h"))).first()["hash"]
    return files.export_id(asdict(settings) | {"template": settings.template_hash(), "documents": h})


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commit(spark: SparkSession, path: str, content: dict) -> bool:
    """Writes a small JSON file at once: readers see it whole or not at all. One that is there already stays; whether this one counts."""
    fs, at = file_system(spark, path)
    if fs.exists(at):
        return False
    _, draft = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if not fs.exists(at) and fs.rename(draft, at):
        return True
    fs.delete(draft, False)
    return False


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of an export or release, None where there is none."""
    if not files.exists(spark, f"{folder}/manifest.json"):
        return None
    lines = spark.read.text(f"{folder}/manifest.json").collect()
    return json.loads("".join(r["value"] for r in lines))


def _located(name: str):
    """A field of a chunk record: at its root, in its metadata or in its source, the first that has it, as text."""
    roots = ("doc_id", "chunk_id", "order", "rev", "text_hash")
    if name in roots:
        return F.col(name).cast("string")
    inside = F.try_element_at("metadata", F.lit(name))
    return F.coalesce(inside, F.col(f"source.{name}").cast("string")) if name in ("page", "section_path") else inside


def _split(rows: DataFrame, settings: Settings) -> DataFrame:
    by = [f"_by{i}" for i in range(len(settings.split_by))]
    dealt = releases.stratified_split(rows.withColumns({b: _located(n) for b, n in zip(by, settings.split_by, strict=True)}), by, settings.fractions, settings.seed, settings.tolerance)
    return dealt.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "split"), F.create_map(F.lit("split"), F.col("split"))))


def export_dataset(chunks: DataFrame, doc_ids: DataFrame, settings: Settings, folder: str, redactions: DataFrame | None = None) -> str:
    """Writes the chunks (records of ``CHUNK_SCHEMA``) of the documents; returns the export's folder. An export that is there is not read again.

    The folder gets the rows, ``doc_ids`` as a table, and the manifest: settings, template hash, rows, documents asked for, distinct
    tables among table texts, and drop and split statistics. The chosen rows are computed once.
    """
    if settings.fmt not in FORMATS:
        raise ValueError(f"unknown format {settings.fmt}")
    spark, target = chunks.sparkSession, f"{folder}/{export_id(settings, doc_ids)}"
    if files.exists(spark, f"{target}/manifest.json"):
        return target
    attempt = f"attempt-{uuid.uuid4().hex}"
    wanted = doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    rows = chunks.join(wanted, "doc_id", "left_semi")
    for f in settings.filters:
        rows = rows.where(f)
    if settings.exclude_pii and redactions is not None:
        cleared = files.redacted(files.with_redactions(rows, redactions).withColumn("_text", F.col("content.text")), "_text")
        rows = cleared.withColumn("content", F.col("content").withField("text", F.col("_text"))).select(chunks.columns)
    before, after = Observation(), Observation()
    if settings.drop_near_dupes:
        rows = materialize(rows.observe(before, F.count("*").alias("input")), "export-input")
        rows = dedup.drop_near_duplicates(rows.withColumn("_text", F.coalesce("content.text", F.lit(""))), ["doc_id", "order"], "_text", settings.dupe_threshold).drop("_text")
    if settings.fractions:
        rows = _split(materialize(rows, "export-rows"), settings)
    # A table's id counts once, so the rows that are written keep it beside their fields until they are projected.
    table_id = F.when(F.col("content.type") == "table_text", F.try_element_at("metadata", F.lit("table_id")))
    per_split = [F.count_if(F.col("split") == s).alias(s) for s in settings.fractions]
    staged = materialize(rows.withColumn("_table", table_id).observe(after, F.count("*").alias("rows"), *per_split), "export-stage")
    fields, data = settings.fields(), f"{target}/{attempt}"
    {"jsonl": files.write_jsonl, "csv": files.write_csv, "parquet": files.write_parquet, "bundle": files.write_bundle}[settings.fmt](staged, fields, data)
    wanted.write.parquet(f"{data}-doc-ids")
    seen = after.get
    manifest = asdict(settings) | {"template": fields, "template_hash": settings.template_hash(), "data": attempt, "doc_ids": f"{attempt}-doc-ids", "n_docs": wanted.count(), "n_rows": seen["rows"], "table_count": staged.where("_table is not null").agg(F.count_distinct("_table").alias("n")).first()["n"]}
    if settings.drop_near_dupes:
        n = before.get["input"]
        manifest["drop_stats"] = {"input": n, "kept": seen["rows"], "dropped": n - seen["rows"], "drop_percent": 100.0 * (n - seen["rows"]) / n if n else 0.0}
    if settings.fractions:
        manifest["split_stats"] = {s: seen[s] for s in settings.fractions}
    commit(spark, f"{target}/manifest.json", manifest)
    return target


def data_of(spark: SparkSession, target: str) -> str:
    """The folder of a finished export's or release's rows."""
    manifest = read_manifest(spark, target)
    if manifest is None:
        raise ValueError(f"no finished export in {target}")
    return f"{target}/{manifest['data']}"


def export_release(chunks: DataFrame, documents: DataFrame, folder: str, release_id: str) -> str:
    """Writes a release: the chunk records of its documents as JSON lines, in the order of the manifest's documents and of the chunks, over files
    in the order of their names; the documents' manifest (doc_id, doc_hash, chunks), a JSON line each, in the same order; then
    ``manifest.json`` with the hash of it all. documents: a ``releases.manifest``. A release that is there is left as it is."""
    spark, target = chunks.sparkSession, f"{folder}/{release_id}"
    if files.exists(spark, f"{target}/manifest.json"):
        return target
    attempt, seen = f"attempt-{uuid.uuid4().hex}", Observation()
    rows = chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    line = F.to_json(F.struct(*(f"`{c}`" for c in chunks.columns)), {"ignoreNullFields": "false"})
    # Observed after the ranges are drawn, as drawing them reads the rows once more.
    rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order").observe(seen, F.count("*").alias("rows")).select(line.alias("value")).write.text(f"{target}/{attempt}")
    own = documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.to_json(F.struct("doc_id", "doc_hash", "chunks")).alias("value"))
    own.write.text(f"{target}/{attempt}-documents")
    commit(spark, f"{target}/manifest.json", {"release": release_id, "data": attempt, "documents": f"{attempt}-documents", "n_docs": documents.count(), "n_rows": seen.get["rows"], "manifest_hash": releases.manifest_hash(documents).first()["manifest_hash"]})
    return target


#: The columns of an audit table.
AUDIT_COLUMNS = ("chunk_id", "doc_id", "user", "action", "request_id", "created_at")


def write_audits(audits: DataFrame, path: str) -> None:
    """Audits (of ``listing.list_audits``) as CSV with a header, in the order of time: by ranges of it, over files in the order of their names.
    Times are ISO texts, with a fraction where there is one; a column that is missing is empty."""
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shown = {"created_at": F.regexp_replace(time, r"\.000000$", "")}
    rows = audits.repartitionByRange("created_at", "chunk_id").sortWithinPartitions("created_at", "chunk_id")
    rows.select(*(shown.get(c, F.col(c) if c in audits.columns else F.lit(None)).cast("string").alias(c) for c in AUDIT_COLUMNS)).write.csv(path, header=True, emptyValue="")
