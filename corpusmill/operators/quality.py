"""Quality metrics, gates, validation and evaluation.

Chunks: doc_id, order, chunk_id, type, text, page, section_path, source_stage, curated map<string,string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Thresholds of the gates.
EMPTY_MAX, SECTION_MIN, TEXT_MIN, OCR_MAX, OTHER_MAX, COMPLETE_MIN = 0.10, 0.90, 0.5, 0.5, 0.2, 0.8


def has_value(values: Column, field: Column | str) -> Column:
    """The key is there, not null and not blank."""
    found = F.try_element_at(values, F.lit(field) if isinstance(field, str) else field)
    return F.coalesce(found.isNotNull() & (tx.collapse(found) != ""), F.lit(False))


def parse_metrics(chunks: DataFrame, *keys: str) -> DataFrame:
    """Per document: empty_chunk_ratio (table text counts as empty), html_section_path_coverage, ocr_ratio."""
    empty = (F.col("type") != "table_placeholder") & ((F.col("type") != "text") | F.col("text").isNull() | (tx.collapse(F.col("text")) == ""))
    pages = F.count_distinct("page")
    ocr = F.count_distinct(F.when(F.col("source_stage") == "pdf_ocr", F.col("page")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return chunks.groupBy(*(keys or ("doc_id",))).agg(
        F.count("*").alias("n_chunks"),
        share(empty).alias("empty_chunk_ratio"),
        share(F.coalesce(F.size("section_path"), F.lit(0)) > 0).alias("html_section_path_coverage"),
        F.when(pages > 0, ocr / pages).otherwise(0.0).alias("ocr_ratio"),
    )


def document_text(chunks: DataFrame) -> DataFrame:
    """The texts of each document's chunks in order, joined."""
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "").alias("text"))


def coverage_metrics(texts: DataFrame) -> DataFrame:
    cover = tx.char_coverage(F.coalesce("text", F.lit("")))
    return texts.withColumn("_c", cover).select("doc_id", (F.col("_c.ascii_ratio") + F.col("_c.latin1_ratio")).alias("text_coverage"), F.col("_c.other_ratio").alias("utf_other_ratio"))


def required_fields(taxonomies: DataFrame) -> DataFrame:
    """Names of the required fields in each project's newest taxonomy. taxonomies: project_id, version, fields array<struct<name,required,...>>."""
    newest = taxonomies.groupBy("project_id").agg(F.max_by("fields", "version").alias("fields"))
    return newest.select("project_id", F.transform(F.filter("fields", lambda f: f["required"]), lambda f: f["name"]).alias("required"))


def completeness(chunks: DataFrame, required: Column) -> DataFrame:
    """Share of a document's chunks with all required fields; with none required 1."""
    done = F.forall(required, lambda f: has_value(F.col("curated"), f))
    return chunks.groupBy("doc_id").agg(F.avg(F.when(done, 1.0).otherwise(0.0)).alias("curation_completeness"))


def failed_gates(block_pii: Column | None = None) -> Column:
    """Names of the gates that a row of metrics fails: mime, the six metrics and pii_count."""
    over = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    under = lambda c, least: F.coalesce(F.col(c) < least, F.lit(False))
    section = F.col("mime").eqNullSafe("text/html") & (F.col("html_section_path_coverage").isNull() | under("html_section_path_coverage", SECTION_MIN))
    pii = F.coalesce((F.lit(False) if block_pii is None else block_pii) & (F.col("pii_count") > 0), F.lit(False))
    gates = {
        "empty_chunk_ratio": over("empty_chunk_ratio", EMPTY_MAX), "html_section_path_coverage": section, "text_coverage": under("text_coverage", TEXT_MIN), "ocr_ratio": over("ocr_ratio", OCR_MAX),
        "utf_other_ratio": over("utf_other_ratio", OTHER_MAX), "curation_completeness": under("curation_completeness", COMPLETE_MIN), "pii_count": pii,
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in gates.items())))


def gate(metrics: DataFrame, block_pii: Column | None = None) -> DataFrame:
    """Adds failed_gates and status."""
    return metrics.withColumn("failed_gates", failed_gates(block_pii)).withColumn("status", F.when(F.size("failed_gates") > 0, "needs_review").otherwise("parsed"))


def gate_counts(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("failed_gates").alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


def scorecard(chunks: DataFrame, *keys: str) -> DataFrame:
    """Parse metrics by file with a verdict on emptiness and section coverage."""
    return parse_metrics(chunks, *keys).withColumn("passed", (F.col("empty_chunk_ratio") <= EMPTY_MAX) & (F.col("html_section_path_coverage") >= SECTION_MIN))


CHUNK_LINE = "doc_id string, chunk_id string, `order` int, content string, metadata string"


def validate_lines(lines: DataFrame) -> DataFrame:
    """Issues of lines of JSON (line_no, value): bad_json, bad_content, bad_metadata, empty_label, duplicate_chunk_id,
    duplicate_order. One row per issue: line_no, issue."""
    parsed = lines.withColumn("j", F.try_parse_json("value"))
    get = lambda path: F.try_variant_get("j", path, "string")
    bad = F.col("j").isNull() | ~F.coalesce(F.schema_of_variant("j").startswith("OBJECT"), F.lit(False))
    is_object = lambda path: F.coalesce(F.expr(f"schema_of_variant(try_variant_get(j, '{path}', 'variant'))").startswith("OBJECT"), F.lit(False))
    read = parsed.select("line_no", bad.alias("bad"), get("$.chunk_id").alias("chunk_id"), get("$.doc_id").alias("doc_id"), get("$.order").alias("ord"), is_object("$.content").alias("content"), is_object("$.metadata").alias("metadata"), get("$.metadata.label").alias("label"))
    good = read.where("not bad")
    again = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("line_no")) > 1
    marked = good.withColumn("dup_id", F.col("chunk_id").isNotNull() & again("chunk_id")).withColumn("dup_order", F.col("doc_id").isNotNull() & F.col("ord").isNotNull() & again("doc_id", "ord"))
    issues = F.array_compact(F.array(F.when(~F.col("content"), F.lit("bad_content")), F.when(~F.col("metadata"), F.lit("bad_metadata")), F.when(F.col("label").isNotNull() & (F.trim("label") == ""), F.lit("empty_label")), F.when(F.col("dup_id"), F.lit("duplicate_chunk_id")), F.when(F.col("dup_order"), F.lit("duplicate_order"))))
    return marked.select("line_no", F.explode(issues).alias("issue")).unionByName(read.where("bad").select("line_no", F.lit("bad_json").alias("issue")))


def dataset_stats(chunks: DataFrame) -> DataFrame:
    """rows, chars (text chunks only), docs."""
    return chunks.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.col("type") == "text", F.length("text"))), F.lit(0)).alias("chars"), F.count_distinct("doc_id").alias("docs"))


def accuracy(answers: DataFrame, *keys: str) -> DataFrame:
    """total, correct, accuracy of answers that equal what was expected, ends trimmed."""
    right = F.coalesce(F.trim("answer") == F.trim("expected"), F.lit(False)).cast("int")
    return answers.groupBy(*keys).agg(F.count("*").alias("total"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))


def answered(examples: DataFrame, model) -> DataFrame:
    """Examples (prompt, expected) with the answers of ``model``, a pandas UDF from text to text or any Column function."""
    return examples.withColumn("answer", model(F.col("prompt")))


def keep_results(results: DataFrame, path: str) -> None:
    """Adds results by release to the history; a release that comes again replaces its own."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release").parquet(path)


def evaluated_releases(history: DataFrame) -> DataFrame:
    return history.select("release").distinct().orderBy("release")


def part_hashes(blocks: DataFrame) -> DataFrame:
    """Per document and part (file, else page) the hash of its block texts in order; blocks with neither are left out."""
    part = F.coalesce("file_path", F.col("page").cast("string"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "")
    return blocks.withColumn("part", part).where("part is not null").groupBy("doc_id", "part").agg(F.sha2(joined, 256).alias("part_hash"))


def latency_histogram(durations: DataFrame, edges: list[float]) -> DataFrame:
    """Count of durations by stage and bin: the number of the first edge that the value doesn't exceed, or one more."""
    bins = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < F.col("seconds")))
    return durations.groupBy("stage", bins.alias("bin")).agg(F.count("*").alias("n"))


def image_counts(images: DataFrame) -> DataFrame:
    """Per document: images, share with text, images per page."""
    has_text = F.coalesce(tx.collapse(F.col("text")) != "", F.lit(False))
    return images.groupBy("doc_id").agg(F.count("*").alias("image_count"), F.avg(has_text.cast("int")).alias("ocr_text_ratio"), (F.count("*") / F.count_distinct("page")).alias("images_per_page"))


def ocr_needed(min_length: int = 100, ratio: float = 0.5) -> Column:
    """Whether a page's text is too short or has too few ASCII and Latin-1 characters."""
    cover = tx.char_coverage(F.coalesce("text", F.lit("")))
    return (F.length(F.trim(F.coalesce("text", F.lit("")))) < min_length) | (cover["ascii_ratio"] + cover["latin1_ratio"] < ratio)
