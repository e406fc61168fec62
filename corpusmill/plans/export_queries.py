"""Queries that write exports, releases and audit tables, read them again, and list what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing, routing
from ..sources import exports, store
from ..sources.shared import new_folder, table
from .curation_queries import NEW, _manifests, _versions
from .registry import AUDITS, CHUNKS, audits_of, chunks_of, query
from .text_queries import _records

_SPLIT = CHUNKS + """, chosen AS (SELECT * FROM chunks WHERE lang <> 'es' AND doc_id % 4 <> 1), st AS (SELECT doc_id, lang FROM chosen WHERE ord = 0),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM st),
dealt AS (SELECT c.*, CASE WHEN r <= round_even(0.7 * n, 0) THEN 'train' ELSE 'test' END AS split FROM chosen c JOIN r USING (doc_id))
"""


def _exported(s, d):
    """Chunks of three quarters of the documents, without one language, in two splits; every fourth chunk is a table's text."""
    kind = F.when(F.col("order") % 4 == 3, "table_text").otherwise("text")
    r = _records(s, d).withColumn("content", F.struct(kind.alias("type"), F.col("content.text").alias("text"))).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("table_id"), (F.col("order") % 7).cast("string"))))
    r = r.withColumns({"rev": F.lit(1), "text_hash": F.lit("h")})
    ids = table(s, d, "documents").where("doc_id % 4 <> 1").select("doc_id")
    settings = exports.Settings({"chunk": "chunk_id", "text": "content.text", "split": "metadata['split']"}, taxonomy_version=2, filters=("metadata['lang'] <> 'es'",), split_by=("lang",), fractions={"train": 0.7, "test": 0.3}, seed=7, tolerance=1.0)
    folder = new_folder(s, "exports")
    target = exports.export_dataset(r, ids, settings, folder)
    assert exports.export_dataset(r.limit(0), ids, settings, folder) == target
    return target


@query(_SPLIT + "SELECT doc_id || '-' || ord AS chunk, text, split FROM dealt")
def a13_export_files(s, d):
    target = _exported(s, d)
    return s.read.schema("chunk string, text string, split string").json(exports.data_of(s, target))


@query(_SPLIT + """SELECT 2::BIGINT AS taxonomy_version, (SELECT count(*) FROM documents WHERE doc_id % 4 <> 1) AS n_docs, count(*) AS n_rows, count(DISTINCT CASE WHEN ord % 4 = 3 THEN ord % 7 END) AS table_count,
count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'test') AS test FROM dealt""")
def a14_export_statistics(s, d):
    manifest = "taxonomy_version long, n_docs long, n_rows long, table_count long, split_stats struct<train: long, test: long>"
    return s.read.schema(manifest).json(f"{_exported(s, d)}/manifest.json").select("taxonomy_version", "n_docs", "n_rows", "table_count", "split_stats.train", "split_stats.test")


@query(CHUNKS + "SELECT doc_id, ord, text FROM chunks WHERE doc_id % 10 <> 1")
def a17_release_files(s, d):
    target = exports.export_release(chunks_of(s, d), _manifests(s, d)[0], new_folder(s, "releases"), "r1")
    return s.read.schema("doc_id long, `order` long, text string").json(exports.data_of(s, target)).withColumnRenamed("order", "ord")


@query(CHUNKS + """SELECT d.doc_id, sha256(d.text) AS doc_hash, count(c.chunk_id)::INTEGER AS n_chunks, (SELECT count(*) FROM chunks WHERE doc_id % 10 <> 1) AS n_rows FROM documents d LEFT JOIN chunks c USING (doc_id) WHERE d.doc_id % 10 <> 1 GROUP BY d.doc_id, d.text""")
def a17_release_manifest(s, d):
    target = exports.export_release(chunks_of(s, d), _manifests(s, d)[0], new_folder(s, "releases"), "r1")
    manifest = exports.read_manifest(s, target)
    docs = s.read.schema("doc_id long, doc_hash string, chunks map<string,string>").json(f"{target}/{manifest['documents']}")
    return docs.select("doc_id", "doc_hash", F.size("chunks").alias("n_chunks"), F.lit(manifest["n_rows"]).cast("long").alias("n_rows"))


def _audit_listing(s, d):
    """Audits by one user in the last week, of the chunks of which every third has gone."""
    newest = table(s, d, "events").agg(F.max("ts").alias("t")).first()["t"]
    chunks = audits_of(s, d).select("chunk_id").distinct().where("chunk_id % 3 <> 0").withColumn("doc_id", F.floor(F.col("chunk_id") / 10))
    since = F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return listing.list_audits(audits_of(s, d).withColumn("user", F.col("user").cast("string")), chunks, user="3", action="metadata_update", since=since)


_LISTED = "FROM audits WHERE usr = 3 AND chunk_id % 3 <> 0 AND created_at >= (SELECT max(ts) - INTERVAL 7 DAYS FROM events)"


@query(AUDITS + "SELECT audit_id, chunk_id, chunk_id // 10 AS doc_id " + _LISTED)
def b10_audit_listing(s, d):
    return _audit_listing(s, d).select("audit_id", "chunk_id", "doc_id")


@query(AUDITS + """SELECT chunk_id::VARCHAR AS chunk_id, (chunk_id // 10)::VARCHAR AS doc_id, '3' AS usr, 'metadata_update' AS action, regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS created_at """ + _LISTED)
def a18_audit_table(s, d):
    path = new_folder(s, "audit-table")
    exports.write_audits(_audit_listing(s, d), path)
    return s.read.csv(path, header=True).select("chunk_id", "doc_id", F.col("user").alias("usr"), "action", "created_at")


def _stored_documents(s, d):
    """Documents of six projects, one of them not active, in two versions; the metadata of the newer names language, source and number."""
    t = table(s, d, "documents").select("doc_id", "lang", "source")
    documents = t.select("doc_id", (F.col("doc_id") % 6).alias("project_id"), F.when(F.col("doc_id") % 2 == 0, "html").otherwise("pdf").alias("source_type"))
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("no"), F.concat(F.lit("N"), F.col("doc_id").cast("string")))
    versions = t.select("doc_id", F.lit(1).alias("version"), F.lit("parsed").alias("status"), F.create_map(F.lit("old"), F.lit("n12")).alias("meta"))
    versions = versions.unionByName(t.select("doc_id", F.lit(2).alias("version"), F.when(F.col("doc_id") % 3 == 0, "needs_review").otherwise("parsed").alias("status"), meta.alias("meta")))
    projects = documents.select("project_id").distinct().withColumn("is_active", F.col("project_id") != 5)
    return documents, versions, projects


_META = """'{"lang":"' || lang || '","source":"' || source || '","no":"N' || doc_id || '"}'"""


@query(f"""SELECT doc_id, project_id, type, status, metadata, count(*) OVER () AS total FROM (SELECT doc_id, doc_id % 6 AS project_id, CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS type, CASE WHEN doc_id % 3 = 0 THEN 'needs_review' ELSE 'parsed' END AS status, {_META} AS metadata FROM documents)
WHERE project_id <> 5 AND type = 'pdf' AND status = 'parsed' AND metadata ILIKE '%"n_2%' ORDER BY doc_id LIMIT 50 OFFSET 2""")
def b7_stored_documents(s, d):
    found = listing.list_documents(*_stored_documents(s, d), kind="pdf", status="parsed", q='"n_2')
    return routing.page_of(found, ["doc_id"], 2, 50).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


@query(f"SELECT doc_id, metadata, true AS few FROM (SELECT doc_id, {_META} AS metadata FROM documents WHERE doc_id % 6 <> 5) WHERE metadata ILIKE '%src1%\"n12%'")
def b7_indexed_search(s, d):
    """The same search by postings; few: less than half of the rows had to be verified."""
    rows = listing.list_documents(*_stored_documents(s, d)).select("doc_id", "metadata")
    found, verified = listing.search(listing.gram_index(rows, "doc_id", "metadata"), rows, "doc_id", "metadata", 'SRC1%"n12')
    return found.withColumn("few", F.lit(verified is not None and 2 * verified < rows.count()))


@query(NEW + """SELECT doc_id, ord, text_hash, 1 AS rev FROM chunks WHERE doc_id % 10 <> 3 UNION ALL
SELECT n.doc_id, n.ord, n.text_hash, CASE WHEN n.text_hash = o.text_hash THEN 1 ELSE 2 END FROM nw n JOIN chunks o ON o.doc_id = n.doc_id AND o.ord = n.ord WHERE n.doc_id % 10 = 3""")
def k7_stored_upsert(s, d):
    """All documents stored, then the second state of a tenth of them brought in, twice, and the log folded into one."""
    old, new = _versions(s, d)
    kept = store.ChunkStore(s, new_folder(s, "chunk-store"), "long")
    kept.upsert(old, "first")
    for _ in range(2):
        kept.upsert(new.where("doc_id % 10 = 3"), "second")
    kept.compact()
    return kept.read().select("doc_id", F.col("order").cast("long").alias("ord"), "text_hash", "rev")
