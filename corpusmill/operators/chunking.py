"""From documents and blocks to chunks.

Blocks: doc_id, block_no, text, type (text, table_placeholder, table_text), page, section_path array<string>,
kind (title, step or null), file_path, meta map<string,string>. Every packer groups by document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def document_windows(docs: DataFrame, target: int = 120, overlap: int = 20) -> DataFrame:
    """Chunks of ``target`` words: doc_id, order, text, text_hash, chunk_id. Other columns of ``docs`` but text stay."""
    rest = [c for c in docs.columns if c not in ("text", "doc_id")]
    exploded = docs.select("doc_id", *rest, F.posexplode(tx.windows(F.col("text"), target, overlap)).alias("order", "text"))
    hashed = exploded.withColumn("text_hash", tx.text_hash(F.lit("text"), F.col("text")))
    return hashed.withColumn("chunk_id", tx.name_id(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("1"), F.col("order").cast("string"), "text_hash")))


def _greedy(sizes: Column, most: int) -> Column:
    """Part number of each size: a part is closed by the element that brings it to ``most``."""
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, n: Column) -> Column:
        held = state["held"] + n
        full = held >= most
        return F.struct(F.when(full, state["part"] + 1).otherwise(state["part"]).alias("part"), F.when(full, 0).otherwise(held).alias("held"), F.concat(state["out"], F.array(state["part"])).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def _packed(islands: DataFrame, most: int, first: dict[str, str]) -> DataFrame:
    """Text islands (doc_id, island, block_no, text, ...) cut greedily; ``first``: output column -> column taken from the first block."""
    item = F.struct("block_no", "text", tx.token_count(F.col("text")).alias("n"), *(F.col(c).alias(f"_{o}") for o, c in first.items()))
    grouped = islands.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(item)).alias("b"))
    cut = grouped.withColumn("part", _greedy(F.transform("b", lambda x: x["n"]), most)).select("doc_id", "island", F.explode(F.arrays_zip("b", "part")).alias("x"))
    parts = cut.groupBy("doc_id", "island", "x.part").agg(F.array_sort(F.collect_list("x.b")).alias("b"))
    text = F.regexp_replace(F.array_join(F.transform("b", lambda x: x["text"]), "\n"), r"(?U)^\s+|\s+\z", "")
    return parts.select("doc_id", F.get("b", F.lit(0))["block_no"].alias("at"), F.lit("text").alias("type"), text.alias("text"), *(F.get("b", F.lit(0))[f"_{o}"].alias(o) for o in first))


def _ordered(chunks: DataFrame, with_section: bool) -> DataFrame:
    hashed = chunks.withColumn("text_hash", tx.text_hash(F.col("type"), F.coalesce("text", F.lit("")), F.coalesce("section_path", F.array().cast("array<string>")) if with_section else None))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "sub")) - 1
    return hashed.withColumn("order", order).withColumn("chunk_id", tx.name_id(F.col("text_hash"))).drop("at", "sub")


def pack_by_section(blocks: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """Blocks of one section and one set of metadata go together until ``max_tokens``; tables stand alone.

    Returns doc_id, order, type, text, section_path, page, meta, text_hash, chunk_id.
    """
    w = Window.partitionBy("doc_id").orderBy("block_no")
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(w))
    entries = F.array_sort(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>"))))
    marked = blocks.withColumn("_meta", F.to_json(entries)).withColumn("_table", F.col("type") != "text")
    breaks = F.when(F.col("_table") | F.lag("_table", 1, True).over(w) | ~same("section_path") | ~same("_meta"), 1).otherwise(0)
    numbered = marked.withColumn("island", F.sum(breaks).over(w))
    keep = {"section_path": "section_path", "page": "page", "_m": "_meta"}
    texts = _packed(numbered.where(~F.col("_table")), max_tokens, keep)
    texts = texts.select("doc_id", "at", F.lit(0).alias("sub"), "type", "text", "section_path", "page", F.map_from_entries(F.from_json("_m", "array<struct<key:string,value:string>>")).alias("meta"))
    tables = blocks.where("type <> 'text'").select("doc_id", F.col("block_no").alias("at"), F.lit(0).alias("sub"), "type", F.when(F.col("type") == "table_text", F.col("text")).alias("text"), "section_path", "page", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))
    return _ordered(texts.unionByName(tables), with_section=True)


def pack_by_layout(blocks: DataFrame, max_tokens: int = 900) -> DataFrame:
    """A new chunk begins at another file, a title or a step (numbered through the document), after a table and at
    ``max_tokens``; a change of section alone begins none. Text of tables is cut between lines so that parts stay within the
    limit. A chunk keeps the step number until the next title, step or other file.

    Returns doc_id, order, type, text, section_path, page, file_path, step_id, meta, text_hash, chunk_id; a table keeps the meta of
    its block, text has none.
    """
    w = Window.partitionBy("doc_id").orderBy("block_no")
    is_text = F.col("type") == "text"
    last_file = F.last(F.when(is_text, F.struct("file_path")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    moved = is_text & last_file.isNotNull() & ~F.col("file_path").eqNullSafe(last_file["file_path"])
    step, title = is_text & F.col("kind").eqNullSafe("step"), is_text & F.col("kind").eqNullSafe("title")
    numbered = (
        blocks.withColumn("_new", F.coalesce(moved | step | title, F.lit(False)))
        .withColumn("_n", F.sum(step.cast("int")).over(w))
        .withColumn("_mark", F.when(step, F.struct(F.col("_n").alias("s"))).when(F.col("_new"), F.struct(F.lit(None).cast("bigint").alias("s"))))
        .withColumn("step_id", F.last("_mark", ignorenulls=True).over(w)["s"].cast("int"))
        .withColumn("island", F.sum((F.col("_new") | ~is_text | ~F.lag(is_text, 1, False).over(w)).cast("int")).over(w))
    )
    keep = {c: c for c in ("section_path", "page", "file_path", "step_id")}
    texts = _packed(numbered.where(is_text), max_tokens, keep).withColumn("sub", F.lit(0))
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    # A line that would bring the part over the limit opens the next one.
    begin = F.struct(F.lit(0).alias("part"), F.lit(0).alias("held"), F.lit(0).alias("lines"), F.array().cast("array<struct<part:int,line:string>>").alias("out"))

    def add(s: Column, line: Column) -> Column:
        n = tx.token_count(line)
        over = (s["lines"] > 0) & (s["held"] + n > max_tokens)
        part = F.when(over, s["part"] + 1).otherwise(s["part"])
        return F.struct(part.alias("part"), F.when(over, n).otherwise(s["held"] + n).alias("held"), F.lit(1).alias("lines"), F.concat(s["out"], F.array(F.struct(part.alias("part"), line.alias("line")))).alias("out"))

    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("meta", none) if "meta" in blocks.columns else none
    cut = numbered.where("type = 'table_text'").withColumn("meta", own).select("doc_id", F.col("block_no").alias("at"), "section_path", "page", "file_path", "step_id", "meta", F.posexplode(F.aggregate(lines, begin, add, lambda s: s["out"])).alias("i", "x"))
    parts = cut.groupBy("doc_id", "at", F.col("x.part").alias("sub")).agg(*(F.first(c).alias(c) for c in (*keep, "meta")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x.line"))), lambda x: x["line"]), "\n").alias("text"))
    columns = ["doc_id", "at", "sub", "type", "text", *keep, "meta"]
    tables = parts.withColumn("type", F.lit("table_text")).withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+\z", "")).select(columns)
    holders = numbered.where("type = 'table_placeholder'").select("doc_id", F.col("block_no").alias("at"), F.lit(0).alias("sub"), "type", F.lit(None).cast("string").alias("text"), *keep, own.alias("meta"))
    return _ordered(texts.withColumn("meta", none).select(columns).unionByName(tables).unionByName(holders), with_section=False)


def section_windows(blocks: DataFrame, target: int = 1200, overlap: int = 200) -> DataFrame:
    """The lines of each run of one section joined, normalised and cut into token windows; order goes on through the document."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    runs = blocks.where("type = 'text'").withColumn("island", F.sum((~F.col("section_path").eqNullSafe(F.lag("section_path").over(w))).cast("int")).over(w))
    joined = runs.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("block_no", "text", "section_path"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["text"]), "\n")
    cut = joined.select("doc_id", "island", F.get("b", F.lit(0))["section_path"].alias("section_path"), F.posexplode(tx.windows(text, target, overlap)).alias("i", "raw")).withColumn("text", tx.nfc_form(F.col("raw")))
    return cut.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("island", "i")) - 1).alias("order"), "section_path", "text", tx.text_hash(F.lit("text"), F.col("text")).alias("text_hash"))


def lines_to_blocks(lines: DataFrame) -> DataFrame:
    """Lines of laid-out pages (doc_id, page, line_no, text, size) to blocks: a line larger than 1.2 times the page's median
    or the first of a document is a title and the section of what follows; numbered and dashed lines are steps; lines with
    tabs, pipes or double spaces are tables."""
    page, doc = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id").orderBy("page", "line_no")
    base = lines.withColumn("median", F.percentile("size", F.lit(0.5)).over(page)).where(F.trim("text") != "")
    table = F.col("text").rlike(r"[|\t]|  ")
    title = ~table & ((F.col("size") > 1.2 * F.col("median")) | (F.row_number().over(doc) == 1))
    step = F.trim("text").rlike(r"(?i)^(?:step\s*)?\d+[.)\s]|^[-*]\s+")
    kind = F.when(table, None).when(title, "title").when(step, "step")
    marked = base.withColumn("kind", kind).withColumn("section", F.last(F.when(F.col("kind") == "title", F.trim("text")), ignorenulls=True).over(doc))
    return marked.select(
        "doc_id", (F.row_number().over(doc) - 1).alias("block_no"), F.when(table, "").otherwise(F.trim("text")).alias("text"), F.when(table, "table_placeholder").otherwise("text").alias("type"), "page",
        F.when(F.col("section").isNull(), F.array().cast("array<string>")).otherwise(F.array("section")).alias("section_path"), "kind",
    )


def upper_case_sections(lines: DataFrame) -> DataFrame:
    """Lines with an upper-case line as the section of those below; before the first it is INTRO."""
    doc = Window.partitionBy("doc_id").orderBy("page", "line_no")
    heading = (F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{Lu}")
    return lines.where(F.trim("text") != "").withColumn("section", F.coalesce(F.last(F.when(heading, F.trim("text")), ignorenulls=True).over(doc), F.lit("INTRO")))
