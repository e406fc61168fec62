"""Stored chunks of document versions: a log of commits, each of which costs what it changes.

A commit writes all rows of the document versions that it touches and the list of these, in a folder of its own; then its record
``commits/<number>.json`` makes it count, by a rename that fails if the number is taken. Readers take the rows of each document version from the last
commit that touches it. What is stored is never rewritten by an upsert; ``compact`` folds the log into one commit.

Rows are laid out by ``bucket``, a hash of doc_id, so that an upsert reads only the buckets of the documents that it brings.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import releases
from .exports import commit as write_once
from .exports import file_system
from .shared import materialize

COLUMNS = "doc_id {id}, version int, `order` int, chunk_id string, text string, text_hash string, rev int, curated map<string,string>"
#: Buckets of a store that is new.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; nothing has been changed."""


class ChunkStore:
    """Chunks at ``path``. ``id_type`` is the SQL type of doc_id; a store keeps the type and number of buckets that it was made with."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string", buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        write_once(spark, f"{self.path}/store.json", {"id_type": id_type, "buckets": buckets})
        made = json.loads("".join(r["value"] for r in spark.read.text(f"{self.path}/store.json").collect()))
        self.schema, self.buckets = COLUMNS.format(id=made["id_type"]), made["buckets"]

    def commits(self) -> list[dict]:
        """The records that count, oldest first: those from the last compaction on. One small record a commit."""
        fs, at = file_system(self.spark, f"{self.path}/commits")
        if not fs.exists(at):
            return []
        names = sorted(f"{self.path}/commits/{s.getPath().getName()}" for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        found = [json.loads(r["value"]) for r in self.spark.read.text(names).collect()] if names else []
        found.sort(key=lambda c: c["number"])
        whole = max((k for k, c in enumerate(found) if c["whole"]), default=0)
        return found[whole:]

    def _known(self) -> set[str]:
        return {name for c in self.commits() for name in c["ids"]}

    def _rows(self, commits: list[dict], touched: DataFrame | None = None) -> DataFrame:
        """Rows of the commits, each document version from its last; ``touched`` (bucket): of these buckets only."""
        if not commits:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        pick = lambda df: df if touched is None else df.join(F.broadcast(touched), "bucket", "left_semi")  # noqa: E731  at most as many as there are buckets
        read = lambda kind, schema, c: self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{c['data']}/{kind}").withColumn("_commit", F.lit(c["number"]))
        both = lambda kind, schema: pick(reduce(DataFrame.unionByName, (read(kind, schema, c) for c in commits)))
        rows = both("rows", self.schema)
        if len(commits) == 1:
            return rows.drop("_commit")
        last = both("keys", ", ".join(self.schema.split(", ")[:2])).groupBy("bucket", "doc_id", "version").agg(F.max("_commit").alias("_commit"))
        return rows.join(last, ["bucket", "doc_id", "version", "_commit"], "left_semi").drop("_commit")

    def read(self) -> DataFrame:
        return self._rows(self.commits()).drop("bucket")

    def _write(self, rows: DataFrame, keys: DataFrame, before: list[dict], ids: list[str], whole: bool) -> None:
        number, data = (before[-1]["number"] if before else 0) + 1, f"data-{uuid.uuid4().hex}"
        names = [c.split()[0].strip("`") for c in self.schema.replace("map<string,string>", "map").split(", ")]
        placed = lambda df: df.withColumn("bucket", self._bucket())
        placed(rows.select(*names)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{data}/rows")
        placed(keys.select("doc_id", "version")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{data}/keys")
        at = f"{self.path}/commits/{number:012d}.json"
        if not write_once(self.spark, at, {"number": number, "data": data, "ids": ids, "whole": whole}):
            raise Conflict(f"commit {number} is taken")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(self.buckets)).cast("int")

    def upsert(self, incoming: DataFrame, commit_id: str) -> DataFrame | None:
        """Brings the document versions in ``incoming`` (doc_id, version, order, chunk_id, text, text_hash) to what it holds, as ``releases.upsert``
        says, and returns the deltas by document, which are written with the commit. A commit_id that has been committed does
        nothing and gives None, so a replay leaves the store as it is."""
        before = self.commits()
        if any(commit_id in c["ids"] for c in before):
            return None
        incoming = materialize(incoming, "incoming")
        keys = materialize(incoming.select("doc_id", "version").distinct(), "touched")
        old = self._rows(before, keys.select(self._bucket().alias("bucket")).distinct()).drop("bucket")
        final, _, deltas = releases.upsert(old, incoming)
        deltas = materialize(deltas, "deltas")
        self._write(final, keys, before, [commit_id], not before)
        return deltas

    def compact(self) -> None:
        """One commit with all rows. What it replaces stays on disk for readers that began before; ``vacuum`` deletes it."""
        before = self.commits()
        if len(before) > 1:
            rows = materialize(self._rows(before).drop("bucket"), "compacted")
            self._write(rows, rows.select("doc_id", "version").distinct(), before, sorted(self._known()), True)

    def vacuum(self) -> int:
        """Deletes data that no commit in use names, and says how many folders. Not to be run beside a writer."""
        fs, at = file_system(self.spark, self.path)
        used = {c["data"] for c in self.commits()}
        old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in used]
        return sum(fs.delete(p, True) for p in old)
