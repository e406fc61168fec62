"""Versions, upserts, manifests and differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered_within

#: Hashes of a manifest that are joined at once, about; each further level takes so many digits of a hash.
FAN, DIGITS = 4096, 3


def upsert(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final, deleted, deltas) of the chunks of the document versions in ``incoming``.

    Rows: doc_id, version, order, chunk_id, text, text_hash, rev, curated. Of incoming rows with one chunk_id the last by
    order counts. Curated values come over from the old row with the same text hash (the last by order), the revision from
    the old row at the same place: equal text keeps it, other text adds one.
    """
    last = Window.partitionBy("chunk_id").orderBy(F.desc("order"))
    new = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("doc_id", "version", "order", "chunk_id", "text", "text_hash")
    scope = new.select("doc_id", "version").distinct()
    old = existing.join(scope, ["doc_id", "version"], "left_semi")
    carried = old.groupBy("doc_id", "version", "text_hash").agg(F.max_by("curated", "order").alias("_curated"))
    placed = old.select("doc_id", "version", "order", F.col("text_hash").alias("_hash"), F.col("rev").alias("_rev"))
    final = (
        new.join(carried, ["doc_id", "version", "text_hash"], "left").join(placed, ["doc_id", "version", "order"], "left")
        .withColumn("rev", F.when(F.col("_rev").isNull(), 1).otherwise(F.col("_rev") + (F.col("_hash") != F.col("text_hash")).cast("int")))
        .withColumn("curated", F.coalesce("_curated", F.create_map().cast("map<string,string>")))
        .select("doc_id", "version", "order", "chunk_id", "text", "text_hash", "rev", "curated")
    )
    deleted = old.join(new.select("chunk_id"), "chunk_id", "left_anti")
    return final, deleted, order_deltas(old, new)


def _diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, change: added, removed or changed; equal rows are left out."""
    a = old.select(*keys, F.struct(value).alias("_old"))
    b = new.select(*keys, F.struct(value).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change")


def order_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document the numbers of places added, removed and changed by text hash."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return _diff(old, new, ["doc_id", "order"], "text_hash").groupBy("doc_id").agg(n("added"), n("removed"), n("changed"))


def part_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document the sorted parts added, removed and changed."""
    parts = lambda kind: F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("part")))).alias(kind)
    return _diff(old, new, ["doc_id", "part"], "part_hash").groupBy("doc_id").agg(parts("added"), parts("removed"), parts("changed"))


def manifest(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document its newest version's hash and the map chunk_id -> text_hash. documents: doc_id, version, doc_hash."""
    newest = documents.groupBy("doc_id").agg(F.max("version").alias("version"), F.max_by("doc_hash", "version").alias("doc_hash"))
    held = chunks.join(newest, ["doc_id", "version"]).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "text_hash")))).alias("chunks"))
    return newest.join(held, "doc_id", "left").select("doc_id", "doc_hash", F.coalesce("chunks", F.create_map().cast("map<string,string>")).alias("chunks"))


def tree_hash(rows: DataFrame) -> DataFrame:
    """One hash (column hash) of rows' hashes (column h), whatever their order. Hashes that begin alike are joined in their order and hashed
    in turn, ``FAN`` or so at once, level by level, so that no task joins more however many rows there are."""
    together = lambda *c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["h"]), ""), 256)
    level, digits, count = rows.select(F.col("h").alias("at"), "h"), 0, rows.count()
    while count > FAN * 16**digits:
        digits += DIGITS
    while digits:
        level = level.groupBy(F.left("at", F.lit(digits)).alias("b")).agg(together("at", "h").alias("h")).select(F.col("b").alias("at"), "h")
        digits -= DIGITS
    return level.agg(together("at", "h").alias("hash"))


def flat_hash(rows: DataFrame) -> DataFrame:
    """One hash (column hash) of rows' hashes (column h), all joined in their order; null where there are none. Hashes are sorted by ranges and
    joined in runs of up to ``FAN``; one digest takes the runs in order and holds one batch of them at a time."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FAN):
                h = batch.column(0).slice(start, FAN).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (h[0], h[-1], "".join(h))], names=["first", "last", "joined"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, some = hashlib.sha256(), False
        for batch in batches:
            for joined in batch.column(2):
                found.update(joined.as_py().encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([found.hexdigest() if some else None], pa.string())], names=["hash"])

    ranges = rows.select("h").where("h is not null").repartitionByRange("h").sortWithinPartitions("h").mapInArrow(runs, "first string, last string, joined string")
    return ranges.repartition(1).sortWithinPartitions("first", "last").mapInArrow(digest, "hash string").agg(F.max("hash").alias("hash"))


def manifest_hash(m: DataFrame, flat: bool = False) -> DataFrame:
    """One hash of a manifest, the ``tree_hash`` or the ``flat_hash`` of its documents, each hashed where it lies."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("chunks")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    each = m.select(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "doc_hash", entries), 256).alias("h"))
    return (flat_hash(each) if flat else tree_hash(each)).withColumnRenamed("hash", "manifest_hash")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, change, and of changed documents the chunks added, removed and changed. A document whose hash is new is
    changed as a whole: its chunk lists are empty."""
    a = old.select("doc_id", F.col("doc_hash").alias("h1"), F.col("chunks").alias("c1"))
    b = new.select("doc_id", F.col("doc_hash").alias("h2"), F.col("chunks").alias("c2"))
    both = a.join(b, "doc_id", "full_outer")
    keys = lambda m, keep: F.array_sort(F.map_keys(F.map_filter(m, keep)))
    same_doc = F.col("h1").eqNullSafe(F.col("h2"))
    lists = {
        "added": keys(F.col("c2"), lambda k, v: ~F.map_contains_key("c1", k)),
        "removed": keys(F.col("c1"), lambda k, v: ~F.map_contains_key("c2", k)),
        "changed": keys(F.col("c2"), lambda k, v: F.map_contains_key("c1", k) & ~v.eqNullSafe(F.try_element_at("c1", k))),
    }
    none = F.array().cast("array<string>")
    found = both.select("doc_id", "h1", "h2", *(F.when(same_doc & F.col("c1").isNotNull() & F.col("c2").isNotNull(), x).otherwise(none).alias(f"chunks_{k}") for k, x in lists.items()))
    some = F.size("chunks_added") + F.size("chunks_removed") + F.size("chunks_changed") > 0
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(~F.col("h1").eqNullSafe(F.col("h2")) | some, "changed")
    return found.withColumn("change", change).where("change is not null").drop("h1", "h2")


def release_rows(chunks: DataFrame, m: DataFrame) -> DataFrame:
    return chunks.join(m.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("doc_id", "order")


def bump_version(versions: DataFrame) -> DataFrame:
    """The next version row of every document; its hash is made of the newest hash and the new number."""
    newest = versions.groupBy("doc_id").agg(F.max("version").alias("v"), F.max_by("doc_hash", "version").alias("h"))
    return newest.select("doc_id", (F.col("v") + 1).alias("version"), F.sha2(F.concat_ws(":", "h", (F.col("v") + 1).cast("string")), 256).alias("doc_hash"))


def stratified_split(chunks: DataFrame, by: list[str], fractions: dict[str, float], seed: int = 0, tolerance: float | None = 0.03) -> DataFrame:
    """Adds split. Whole documents are dealt within a stratum (the values of ``by`` of the document's last chunk), in the order
    of a seeded hash, at cumulative shares; the last name takes the rest. Shares by chunk must lie within ``tolerance``."""
    strata = chunks.groupBy("doc_id").agg(F.max_by(F.struct(*by), "order").alias("stratum"))
    keyed = strata.withColumn("place", F.sha2(F.concat(F.lit(str(seed)), F.lit("|"), F.col("doc_id").cast("string")), 256))
    ranked = numbered_within(keyed, ["stratum"], ["place", "doc_id"], "r")
    sizes = strata.groupBy(F.col("stratum").alias("_s")).agg(F.count("*").alias("n"))
    shuffled = ranked.join(sizes, F.col("stratum").eqNullSafe(F.col("_s")))
    split, end = None, F.lit(0)
    names = list(fractions)
    for name in names[:-1]:
        end = end + F.bround(F.lit(fractions[name]) * F.col("n"), 0)
        split = F.when(F.col("r") <= end, name) if split is None else split.when(F.col("r") <= end, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    out = chunks.join(shuffled.select("doc_id", split.alias("split")), "doc_id")
    if tolerance is not None:
        counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        total = sum(counts.values())
        off = [n for n, f in fractions.items() if total and abs(counts.get(n, 0) / total - f) > tolerance]
        if off:
            raise ValueError(f"shares outside tolerance: {off}")
    return out


def first_location(field: str, *locations: Column) -> Column:
    """Value of ``field`` in the first map that has the key, even where its value is null."""
    out = None
    for m in locations:
        hit = F.coalesce(F.map_contains_key(m, field), F.lit(False))
        out = F.when(hit, F.try_element_at(m, F.lit(field))) if out is None else out.when(hit, F.try_element_at(m, F.lit(field)))
    return out
