"""Writes of people: edits of chunks are folded in their order, audited, and the gates of the documents that they touch are set anew.
Functions return the new rows and leave storing to the caller.

chunks: chunk_id, doc_id, rev, curated map<string,string>, suggestions map<string,struct<value,...>>, stale boolean.

An edit is a row chunk_id, edit_no (the order; ties by user and content), user, kind, field, entries map<string,string>. Kinds: ``patch`` lays its
entries over the curated values and does nothing where they are there already; ``bulk`` does the same and always counts; ``accept`` takes
the suggested value of ``field``; ``rename`` replaces the value of ``field`` by what ``entries`` has for it and marks the chunk stale. Every edit
that counts adds one to ``rev`` and writes an audit with all curated values before and after. Its action ends in ``_conflict`` where an
earlier audit of another user left the chunk with another value in a field that the edit changes.

Only chunks that an edit names are folded; a chunk's edits are streamed in order through a task that keeps its current values and a few witnesses
a field, so many edits of one chunk are never gathered. A null map is an empty one; edits of unknown chunks, and those without a chunk, are
left out; a null user is never in conflict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize
from . import quality
from .numbering import numbered

#: The actions of audits by kind of edit.
ACTIONS = {"patch": "metadata_update", "bulk": "bulk_apply", "accept": "accept_suggestion", "rename": "taxonomy_migration"}
TEXTS = "map<string,string>"


def merge(before: Column, patch: Column) -> Column:
    """``before`` with the entries of ``patch`` over it."""
    return F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(patch, k)), patch)


class Witnesses:
    """Enough of the (user, value) pairs said of a field to tell whether another user said another value. A pair is kept if it answers a
    question that no kept one answers; there are at most six such pairs."""

    def __init__(self):
        self.pairs: list[tuple] = []

    def contradict(self, user, value) -> bool:
        return any(u != user and v != value for u, v in self.pairs)

    def add(self, user, value) -> None:
        other = object()
        users, values = {other, *(u for u, _ in self.pairs)} - {user}, {other, *(v for _, v in self.pairs)} - {value}
        if not all(self.contradict(u, v) for u in users for v in values):
            self.pairs.append((user, value))


def changed_values(edit: dict, now: dict, offers: dict) -> dict | None:
    """What an edit makes of the current values; None if it doesn't count."""
    entries, field = dict(edit["entries"] or ()), edit["field"]
    if edit["kind"] == "accept":
        return None if offers.get(field) is None else {**now, field: offers[field]}
    if edit["kind"] == "rename":
        return None if now.get(field) not in entries else {**now, field: entries[now[field]]}
    after = {**now, **entries}
    return None if edit["kind"] == "patch" and after == now else after


class Folder:
    """The state of one chunk while its rows pass: stored values first, then earlier audits, then edits in order."""

    def __init__(self, chunk_id, row: dict | None):
        self.chunk_id, self.stored, self.now, self.offers = chunk_id, row is not None, dict(row["entries"] or ()) if row else {}, dict(row["offers"] or ()) if row else {}
        self.said: dict[str, Witnesses] = {}
        self.revs, self.taken, self.stale = 0, [], False

    def hear(self, user, values: dict) -> None:
        if user is not None:
            for field, value in values.items():
                self.said.setdefault(field, Witnesses()).add(user, value)

    def edit(self, edit: dict) -> dict | None:
        """The audit of an edit, if it counts."""
        before, after = self.now, changed_values(edit, self.now, self.offers) if self.stored else None
        if after is None:
            return None
        moved = {k: v for k, v in after.items() if before.get(k) != v or k not in before}
        clash = edit["user"] is not None and any(self.said[k].contradict(edit["user"], v) for k, v in moved.items() if k in self.said)
        self.hear(edit["user"], after)
        self.now, self.revs, self.stale = after, self.revs + 1, self.stale or edit["kind"] == "rename"
        if edit["kind"] == "accept":
            del self.offers[edit["field"]]
            self.taken.append(edit["field"])
        action = ACTIONS[edit["kind"]] + "_conflict" * clash
        return {"chunk_id": self.chunk_id, "edit_no": edit["edit_no"], "user": edit["user"], "action": action, "before": list(before.items()), "after": list(after.items())}

    def final(self) -> dict:
        return {"chunk_id": self.chunk_id, "after": list(self.now.items()), "revs": self.revs, "taken": self.taken, "stale": self.stale}


def folded(rows: Iterator[dict]) -> Iterator[dict]:
    """Audits, and a last row for each chunk with edits that count; rows: by chunk, role (0 stored, 1 earlier audit, 2 edit), place."""
    chunk = None
    for row in rows:
        if chunk is None or chunk.chunk_id != row["chunk_id"]:
            if chunk is not None and chunk.revs:
                yield chunk.final()
            chunk = Folder(row["chunk_id"], row if row["role"] == 0 else None)
        if row["role"] == 1:
            chunk.hear(row["user"], dict(row["entries"] or ()))
        elif row["role"] == 2 and (audit := chunk.edit(row)):
            yield audit
    if chunk is not None and chunk.revs:
        yield chunk.final()


def _fold(chunks: DataFrame, edits: DataFrame, history: DataFrame | None, written: int = 4096) -> DataFrame:
    """Audits and last rows (``revs`` not null) of the chunks that edits name, written as a table."""
    key, texts = chunks.schema["chunk_id"].dataType, lambda c: F.col(c).cast(TEXTS)
    edits = edits.where("chunk_id is not null").withColumn("chunk_id", F.col("chunk_id").cast(key))
    named = edits.select("chunk_id").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    offers = F.transform_values("suggestions", lambda _, x: x["value"].cast("string")) if "suggestions" in chunks.columns else none(TEXTS)
    stored = chunks.join(named, "chunk_id", "left_semi").select("chunk_id", F.lit(0).alias("role"), none("long").alias("edit_no"), none("string").alias("user"), none("string").alias("kind"), none("string").alias("field"), texts("curated").alias("entries"), offers.alias("offers"))
    asked = edits.select("chunk_id", F.lit(2).alias("role"), F.col("edit_no").cast("long"), F.col("user").cast("string"), "kind", F.col("field").cast("string"), texts("entries").alias("entries"), none(TEXTS).alias("offers"))
    rows = stored.unionByName(asked)
    if history is not None:
        heard = history.withColumn("chunk_id", F.col("chunk_id").cast(key)).join(named, "chunk_id", "left_semi")
        rows = rows.unionByName(heard.select("chunk_id", F.lit(1).alias("role"), none("long").alias("edit_no"), F.col("user").cast("string"), none("string").alias("kind"), none("string").alias("field"), texts("after").alias("entries"), none(TEXTS).alias("offers")))
    tie = F.xxhash64("kind", "field", F.to_json("entries")).alias("tie")
    # Dealt by a hash of the id: of a union whose parts are dealt by the id already, Spark 4.1 may leave out the exchange though it has
    # merged the partitions of each part in its own way.
    dealt = rows.withColumn("tie", tie).repartition(F.xxhash64("chunk_id")).sortWithinPartitions("chunk_id", "role", "edit_no", "user", "tie")
    names = ("chunk_id", "edit_no", "user", "action", "before", "after", "revs", "taken", "stale")
    pairs = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def batch_of(out: list[dict]) -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), pa.string(), pa.string(), pairs, pairs, pa.int64(), pa.list_(pa.string()), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], k) for n, k in zip(names, kinds, strict=True)], names=list(names))

        def all_rows() -> Iterator[dict]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("chunk_id").type
                yield from batch.to_pylist()

        out: list[dict] = []
        for row in folded(all_rows()):
            out.append(row)
            if len(out) >= written:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    kinds = (key, T.LongType(), T.StringType(), T.StringType(), *(T.MapType(T.StringType(), T.StringType()),) * 2, T.LongType(), T.ArrayType(T.StringType()), T.BooleanType())
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return materialize(dealt.drop("tie").mapInArrow(run, schema), "edits")


def gate_table(documents: DataFrame, chunks: DataFrame, required: Column) -> DataFrame:
    """documents (doc_id, mime and the metrics of the gates but completeness) with n_chunks and n_complete, the sums that completeness is made
    of, and completeness, failed_gates and status. required: array of the names of required fields, made of the documents' columns."""
    wanted = documents.select("doc_id", required.alias("_required"))
    complete = F.forall("_required", lambda f: quality.has_value(F.col("curated"), f))
    sums = chunks.join(wanted, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(complete.cast("long")).alias("n_complete"))
    full = documents.join(sums, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_chunks", "n_complete")})
    return _gated(full, documents.columns)


def _gated(rows: DataFrame, columns: list[str]) -> DataFrame:
    block = F.col("block_pii") if "block_pii" in columns else F.lit(False)
    share = F.when(F.col("n_chunks") > 0, F.col("n_complete") / F.col("n_chunks")).otherwise(0.0)
    return quality.gate(rows.withColumn("curation_completeness", share), block)


def regate(gates: DataFrame, chunks: DataFrame, audits: DataFrame, required: Column) -> DataFrame:
    """The gate table after writes. The sums of a document change by what each audit of its chunks has gained or lost, so neither its other
    chunks nor their values are read; documents without an audit keep their gates and status. chunks: chunk_id, doc_id."""
    docs = audits.select("chunk_id", "before", "after").join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    wanted = gates.select("doc_id", required.alias("_required"))
    complete = lambda c: F.forall("_required", lambda f: quality.has_value(F.col(c), f)).cast("long")
    gained = docs.join(wanted, "doc_id").groupBy("doc_id").agg(F.sum(complete("after") - complete("before")).alias("_gained"))
    joined = gates.withColumnsRenamed({"failed_gates": "_failed", "status": "_status"}).join(materialize(gained, "gained"), "doc_id", "left")
    fresh = _gated(joined.withColumn("n_complete", F.col("n_complete") + F.coalesce("_gained", F.lit(0))), gates.columns)
    kept = lambda new, old: F.when(F.col("_gained").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(new)
    old = {"failed_gates": "_failed", "status": "_status"}
    return fresh.select(*(kept(c, old[c]) if c in old else c for c in gates.columns))


def write(chunks: DataFrame, edits: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunks and the audits of all edits in order. history: earlier audits (chunk_id, user, after), for conflicts."""
    done = _fold(chunks, edits, history)
    finals = done.where("revs is not null")
    now = finals.select("chunk_id", F.col("after").alias("_after"), F.col("revs").alias("_revs"), F.col("taken").alias("_taken"), F.col("stale").alias("_stale"))
    joined = chunks.join(now, "chunk_id", "left")
    fresh = {"curated": F.coalesce("_after", "curated"), "rev": (F.col("rev") + F.coalesce("_revs", F.lit(0))).cast(chunks.schema["rev"].dataType)}
    if "suggestions" in chunks.columns:
        left = F.map_filter("suggestions", lambda k, _: ~F.array_contains("_taken", k))
        fresh["suggestions"] = F.when(F.size("_taken") > 0, F.when(F.size(left) > 0, left)).otherwise(F.col("suggestions"))
    if "stale" in chunks.columns:
        fresh["stale"] = F.coalesce("_stale", F.lit(False)) | F.coalesce("stale", F.lit(False))
    audits = done.where("revs is null").select("chunk_id", "edit_no", "user", "action", "before", "after")
    return joined.select(*(fresh[c].alias(c) if c in fresh else f"`{c}`" for c in chunks.columns)), audits


def _edits(rows: DataFrame, kind: str, field=None, entries=None) -> DataFrame:
    no = F.col("edit_no") if "edit_no" in rows.columns else F.lit(0)
    return rows.select("chunk_id", no.cast("long").alias("edit_no"), "user", F.lit(kind).alias("kind"), (F.lit(None) if field is None else field).cast("string").alias("field"), (F.lit(None) if entries is None else entries).cast(TEXTS).alias("entries"))


def patch(chunks: DataFrame, patches: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """patches: chunk_id, user, patch and, where a chunk has several, edit_no. One that changes nothing leaves the row and writes no audit.
    history: as in ``write``."""
    return write(chunks, _edits(patches, "patch", entries=F.col("patch")), history)


def select_chunks(chunks: DataFrame, ids: DataFrame | None = None, doc_id=None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Chunks by id, all of which must exist, or of one document within an inclusive range of order."""
    if ids is not None:
        missing = ids.join(chunks, "chunk_id", "left_anti").limit(5).collect()
        if missing:
            raise ValueError(f"unknown chunks: {[r['chunk_id'] for r in missing]}")
        return chunks.join(ids.distinct(), "chunk_id", "left_semi")
    if doc_id is None:
        raise ValueError("neither ids nor a document")
    found = chunks.where(F.col("doc_id") == doc_id)
    found = found if first is None else found.where(F.col("order") >= first)
    return found if last is None else found.where(F.col("order") <= last)


def bulk_patch(chunks: DataFrame, selected: DataFrame, values: dict[str, str], user: str, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One patch for all selected chunks; every one gets a revision and an audit, changed or not."""
    new = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return write(chunks, _edits(selected.select("chunk_id").distinct().withColumn("user", F.lit(user)), "bulk", entries=new), history)


def accept_suggestions(chunks: DataFrame, accepted: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """accepted: chunk_id, user, field and, where the order matters, edit_no. The field takes the suggested value, the suggestion goes, an
    empty map becomes null; chunks without the suggestion are left alone."""
    return write(chunks, _edits(accepted, "accept", field=F.col("field")), history)


def rename_options(options: Column, mapping: Column) -> Column:
    """Options with the mapped ones renamed, in order, each once."""
    return F.array_distinct(F.transform(options, lambda o: F.coalesce(F.try_element_at(mapping, o), o)))


def rename_values(chunks: DataFrame, field: str, mapping: dict[str, str], user: str, options: list[str] | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Renames values of an enum field; changed chunks turn stale. ``rename_field_options`` does the same to a taxonomy."""
    if options is not None and set(mapping) - set(options):
        raise ValueError(f"unknown options: {sorted(set(mapping) - set(options))}")
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    hit = chunks.where(F.try_element_at("curated", F.lit(field)).isin(list(mapping))).select("chunk_id", F.lit(user).alias("user"))
    return write(chunks, _edits(hit, "rename", field=F.lit(field), entries=names), history)


def rename_field_options(taxonomies: DataFrame, project_id, field: str, mapping: dict[str, str]) -> DataFrame:
    """taxonomies (project_id, version, fields array<struct<name,type,options,...>>) with the options of the field in the project's newest version
    renamed. An unknown project, field or option, and a field that is no enum, is an error."""
    newest = taxonomies.where(F.col("project_id") == project_id).orderBy(F.desc("version")).select("version", F.filter("fields", lambda f: f["name"] == field).alias("f")).limit(1).collect()
    if not newest or not newest[0]["f"]:
        raise ValueError("taxonomy or field not found")
    found = newest[0]["f"][0]
    if found["type"] != "enum":
        raise ValueError("the field is no enum")
    if unknown := set(mapping) - set(found["options"] or ()):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    renamed = F.transform("fields", lambda f: F.when(f["name"] == field, f.withField("options", rename_options(f["options"], names))).otherwise(f))
    hit = (F.col("project_id") == project_id) & (F.col("version") == newest[0]["version"])
    return taxonomies.withColumn("fields", F.when(hit, renamed).otherwise(F.col("fields")))


def taxonomy_issues(fields: DataFrame) -> DataFrame:
    """fields: project_id, name, type, options. Rows (project_id, name, issue) for repeated names and enums without options."""
    twice = fields.groupBy("project_id", "name").count().where("count > 1").select("project_id", "name", F.lit("duplicate_name").alias("issue"))
    bare = fields.where((F.col("type") == "enum") & (F.coalesce(F.size("options"), F.lit(0)) <= 0)).select("project_id", "name", F.lit("enum_without_options").alias("issue"))
    return twice.unionByName(bare)


def next_version(keys: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    newest = versions.groupBy(key).agg(F.max("version").alias("v"))
    return keys.join(newest, key, "left").withColumn("next_version", F.coalesce("v", F.lit(0)) + 1).drop("v")


def guidelines(fields: DataFrame) -> DataFrame:
    """A block of text per field: name and type, help, examples, options."""
    line = lambda label, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    title = F.concat("name", F.lit(" ("), "type", F.lit(")"), F.when(F.col("required"), " *").otherwise(""))
    return fields.withColumn("guideline", F.concat_ws("\n", title, F.col("helptext"), line("Examples: ", F.col("examples")), line("Options: ", F.col("options"))))


def annotation_tasks(chunks: DataFrame, docs: DataFrame, limit: int | None = None, batch: int = 100) -> DataFrame:
    """Task rows of the chunks of the given documents, in order, in batches."""
    picked = chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ranked = numbered(picked if limit is None else picked.orderBy("doc_id", "order").limit(limit), ["doc_id", "order"])
    return ranked.select(F.col("n").alias("id"), F.struct("text", "chunk_id", "doc_id").alias("data"), F.floor((F.col("n") - 1) / batch).alias("batch"))


def set_active(projects: DataFrame, project_id, active: bool) -> DataFrame:
    """Soft delete or restore."""
    hit = F.col("project_id") == project_id
    return projects.withColumn("is_active", F.when(hit, active).otherwise(F.col("is_active"))).withColumn("deleted_at", F.when(hit, F.lit(None) if active else F.current_timestamp()).otherwise(F.col("deleted_at")))
