"""Chunk files in, exports out."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pii
from ..operators.numbering import numbered

CHUNK_SCHEMA = (
    "doc_id string, chunk_id string, `order` int, rev int, content struct<type:string,text:string>, source struct<page:int,section_path:array<string>>, "
    "text_hash string, metadata map<string,string>"
)
REDACTION_SCHEMA = "chunk_id string, redactions array<struct<type:string,text:string>>"
#: Presets: field -> SQL expression over a chunk record.
PRESETS = {
    "rag": {"context": "concat(array_join(source.section_path, ' / '), ': ', content.text)", "answer": "''"},
    "sft": {"prompt": "content.text", "completion": "''"},
}


def read_chunks(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """Lines of chunk records; files without lines give none."""
    rows = spark.read.schema(CHUNK_SCHEMA).json(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(*doc_ids))


def read_redactions(spark: SparkSession, path: str) -> DataFrame:
    """Redactions by chunk; a path that isn't there is no redactions."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(REDACTION_SCHEMA).json(path)
    except AnalysisException:
        return spark.createDataFrame([], REDACTION_SCHEMA)


def with_redactions(chunks: DataFrame, redactions: DataFrame) -> DataFrame:
    """Every chunk with its redactions, none as an empty array."""
    return chunks.join(redactions, "chunk_id", "left").withColumn("redactions", F.coalesce("redactions", F.array().cast("array<struct<type:string,text:string>>")))


def redacted(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Texts with their redactions applied, and no suggestion named redactions."""
    out = chunks.withColumn(text, pii.redact(F.col(text), F.col("redactions")))
    return out.withColumn("suggestions", F.map_filter("suggestions", lambda k, v: k != "redactions")) if "suggestions" in chunks.columns else out


def read_html_files(spark: SparkSession, path: str, pattern: str = "*.{html,htm}") -> DataFrame:
    """page_id by sorted name, url = path, html. Paths alone are numbered; contents don't move for it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    ids = numbered(files.select("path"), ["path"], "_n").select("path", (F.col("_n") - 1).cast("long").alias("page_id"))
    return files.select("path", F.decode("content", "UTF-8").alias("html")).join(ids, "path").select("page_id", F.col("path").alias("url"), "html")


def read_html_archives(spark: SparkSession, path: str) -> DataFrame:
    """The HTML members of zip files: archive, name, html, members in order of name."""
    import io
    import zipfile

    import pandas as pd

    def members(batches):
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.lower().endswith((".html", ".htm")))
                    yield pd.DataFrame({"archive": archive, "name": names, "html": [z.read(n).decode("utf-8", "replace") for n in names]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(members, "archive string, name string, html string")


def fields_of(preset: str | None = None, template: dict[str, str] | None = None) -> dict[str, str]:
    """The fields to export: the preset's, which wins, or the template's."""
    if preset:
        return PRESETS[preset]
    if not template:
        raise ValueError("a preset or a template is needed")
    return template


def project(chunks: DataFrame, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    return chunks.selectExpr(*(f"`{c}`" for c in keep), *(f"{e} as `{n}`" for n, e in fields.items()))


def json_lines(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    return project(chunks, fields).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(chunks: DataFrame, fields: dict[str, str], path: str) -> None:
    json_lines(chunks, fields).write.text(path)


def sorted_fields(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The fields as text, sorted by name, nulls as empty."""
    return project(chunks, fields).select(*(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in sorted(fields)))


def write_csv(chunks: DataFrame, fields: dict[str, str], path: str) -> None:
    sorted_fields(chunks, fields).write.csv(path, header=True, emptyValue="")


def write_parquet(chunks: DataFrame, fields: dict[str, str], path: str) -> None:
    project(chunks, fields).select(*sorted(fields)).write.parquet(path)


def write_bundle(chunks: DataFrame, fields: dict[str, str], path: str) -> None:
    """One directory per split; rows without one go to train."""
    split = F.col("split") if "split" in chunks.columns else F.lit("train")
    project(chunks, fields, ("split",) if "split" in chunks.columns else ()).withColumn("split", F.coalesce(split, F.lit("train"))).write.partitionBy("split").parquet(path)


def write_snapshot_csv(chunks: DataFrame, path: str) -> None:
    """A snapshot as CSV, content and metadata as JSON."""
    columns = {"doc_id": "doc_id", "chunk_id": "chunk_id", "order": "`order`", "content": "to_json(content)", "metadata": "to_json(metadata)"}
    project(chunks, columns).write.csv(path, header=True)


def export_id(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def export(chunks: DataFrame, fields: dict[str, str], folder: str, settings: dict, filters: list[str] = ()) -> str:
    """Writes JSON lines below an id made of the settings; an export that is there already is left as it is."""
    target = f"{folder}/{export_id(settings | {'fields': fields, 'filters': list(filters)})}"
    if not exists(chunks.sparkSession, f"{target}/data/_SUCCESS"):
        for f in filters:
            chunks = chunks.where(f)
        write_jsonl(chunks, fields, f"{target}/data")
        manifest(chunks).write.json(f"{target}/manifest")
    return target


def manifest(chunks: DataFrame) -> DataFrame:
    """One row: rows, documents, distinct tables among table texts. Needs doc_id, content, metadata."""
    table = F.when(F.col("content.type") == "table_text", F.try_element_at("metadata", F.lit("table_id")))
    return chunks.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(table).alias("n_tables"))


def document_manifest(chunks: DataFrame) -> DataFrame:
    """Per document: files, pages read by OCR, the first language of every page up to the last, languages used.
    chunks: doc_id, order, file_path, page, source_stage, lang."""
    by_page = chunks.where("page is not null").groupBy("doc_id", "page").agg(F.min_by("lang", F.when(F.col("lang").isNotNull(), F.col("order"))).alias("lang"))
    pages = by_page.groupBy("doc_id").agg(F.max("page").alias("n"), F.map_from_entries(F.collect_list(F.struct("page", "lang"))).alias("m"))
    langs = pages.select("doc_id", F.transform(F.sequence(F.lit(1), "n"), lambda p: F.try_element_at("m", p)).alias("page_langs"))
    own = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_set("file_path")).alias("files"), F.sort_array(F.collect_set(F.when(F.col("source_stage") == "pdf_ocr", F.col("page")))).alias("pages_ocr"), F.sort_array(F.collect_set("lang")).alias("langs_used"))
    return own.join(langs, "doc_id", "left")


def map_of_json(value: Column) -> Column:
    """A map from JSON text; bad JSON and nulls give an empty map."""
    return F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))


def sanitize(text: Column) -> Column:
    """Ends trimmed, unless the text begins and ends with a code fence."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    return F.when(F.startswith(trimmed, F.lit("```")) & F.endswith(trimmed, F.lit("```")), text).otherwise(trimmed)
