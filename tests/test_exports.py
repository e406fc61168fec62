"""Exports, releases and listings: files that are whole or not there, and searches that equal a plain filter."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import listing, releases
from corpusmill.sources import chunks as files
from corpusmill.sources import exports

FIELDS = {"text": "content.text", "page": "cast(source.page as string)"}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for d in range(20):
        for k in range(4):
            text = f"alpha beta {d if d % 5 else 'same words here'} {k} mail me@x.org" if k else "the same first chunk of words"
            kind = "table_text" if k == 3 else "text"
            rows.append((f"d{d}", f"d{d}-{k}", k, 1, (kind, text), (k + 1, ["A"]), f"h{d}{k}", {"lang": "en" if d % 2 else "de", "table_id": str(d % 3)}))
    return spark.createDataFrame(rows, files.CHUNK_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def ids(spark):
    return spark.createDataFrame([(f"d{d}",) for d in range(16)] + [("d1",)], "doc_id string")


def test_an_export_and_its_manifest(spark, chunks, ids, tmp_path):
    settings = exports.Settings(FIELDS, taxonomy_version=3, filters=("metadata['lang'] = 'en'",), drop_near_dupes=True, split_by=("lang",), fractions={"train": 0.5, "test": 0.5}, tolerance=0.2)
    redactions = spark.createDataFrame([("d1-1", [("email", "me@x.org")])], files.REDACTION_SCHEMA)
    target = exports.export_dataset(chunks, ids, settings, str(tmp_path), redactions)
    m = exports.read_manifest(spark, target)
    lines = [json.loads(r["value"]) for r in spark.read.text(exports.data_of(spark, target)).collect()]
    assert all(set(x) == {"text", "page"} for x in lines) and sum("[REDACTED]" in x["text"] for x in lines) == 1
    assert (m["taxonomy_version"], m["n_docs"], m["n_rows"], m["template_hash"]) == (3, 16, len(lines), settings.template_hash())
    assert m["drop_stats"]["input"] == 32 and m["drop_stats"]["dropped"] == 32 - len(lines) > 0
    assert sum(m["split_stats"].values()) == len(lines) and m["table_count"] == 3
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{target}/{m['doc_ids']}").collect()) == sorted(f"d{d}" for d in range(16))


def test_an_export_is_reused_by_all_that_decides_it(spark, chunks, ids, tmp_path):
    folder, base = str(tmp_path), exports.Settings("rag")
    first = exports.export_dataset(chunks, ids, base, folder)
    assert exports.export_dataset(chunks.limit(0), ids.repartition(2), base, folder) == first and spark.read.text(exports.data_of(spark, first)).count() == 64
    others = [exports.Settings("sft"), exports.Settings("rag", "csv"), exports.Settings("rag", taxonomy_version=2), exports.Settings("rag", project={"tables_as_text": True}), exports.Settings("rag", dupe_threshold=0.9), exports.Settings("rag", exclude_pii=False), exports.Settings("rag", seed=1), exports.Settings("rag", filters=("true",))]
    assert len({first, *(f"{folder}/{exports.export_id(s, ids)}" for s in others), f"{folder}/{exports.export_id(base, ids.limit(3))}"}) == 10
    with pytest.raises(ValueError):
        exports.export_dataset(chunks, ids, exports.Settings("rag", "xml"), folder)


def test_a_broken_attempt_is_not_an_export(spark, chunks, ids, tmp_path):
    settings = exports.Settings({"x": "content.nothing"})
    with pytest.raises(Exception, match="nothing"):
        exports.export_dataset(chunks, ids, settings, str(tmp_path))
    target = f"{tmp_path}/{exports.export_id(settings, ids)}"
    assert exports.read_manifest(spark, target) is None
    with pytest.raises(ValueError):
        exports.data_of(spark, target)
    exports.commit(spark, f"{tmp_path}/m.json", {"a": 1})
    exports.commit(spark, f"{tmp_path}/m.json", {"a": 2})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1} and not list(tmp_path.glob("m.json.*"))


@pytest.mark.parametrize("fmt", ["csv", "parquet", "bundle"])
def test_formats(spark, chunks, ids, tmp_path, fmt):
    settings = exports.Settings(FIELDS, fmt, fractions={"train": 0.75, "test": 0.25}, split_by=("doc_id",), tolerance=1.0)
    data = exports.data_of(spark, exports.export_dataset(chunks, ids, settings, str(tmp_path)))
    rows = spark.read.csv(data, header=True) if fmt == "csv" else spark.read.parquet(data)
    assert rows.count() == 64 and rows.columns == {"csv": ["page", "text"], "parquet": ["page", "text"], "bundle": ["text", "page", "split"]}[fmt]


def test_a_release_and_its_files(spark, chunks, tmp_path):
    versions = spark.createDataFrame([(f"d{d}", 1, f"hash{d}") for d in range(20) if d != 4], "doc_id string, version int, doc_hash string")
    m = releases.manifest(versions, chunks.withColumn("version", F.lit(1)))
    target = exports.export_release(chunks, m, str(tmp_path), "r1")
    data = exports.data_of(spark, target)
    parts = sorted(p for p in (tmp_path / "r1").glob("attempt-*/part-*") if "documents" not in p.parent.name)
    lines = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    assert [(x["doc_id"], x["order"]) for x in lines] == sorted((f"d{d}", k) for d in range(20) if d != 4 for k in range(4))
    manifest = exports.read_manifest(spark, target)
    docs = [json.loads(r["value"]) for r in spark.read.text(f"{target}/{manifest['documents']}").collect()]
    assert (manifest["n_rows"], manifest["n_docs"], len(docs), docs[0]["chunks"]["d0-0"]) == (76, 19, 19, "h00")
    assert manifest["manifest_hash"] == releases.manifest_hash(m).first()["manifest_hash"]
    assert exports.export_release(chunks.limit(0), m, str(tmp_path), "r1") == target and exports.data_of(spark, target) == data


def test_audit_listing_and_table(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [("c1", "u1", "edit", at + datetime.timedelta(days=2), "r"), ("c2", "u2", "edit", at, None), ("c1", "u2", "bulk_apply", at + datetime.timedelta(days=1, microseconds=5), "r"), ("gone", "u1", "edit", at, "r")]
    audits = spark.createDataFrame(rows, "chunk_id string, user string, action string, created_at timestamp, request_id string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "chunk_id string, doc_id string")
    count = lambda **f: listing.list_audits(audits, chunks, **f).count()
    assert [count(), count(doc_id="d1"), count(user="u2"), count(action="edit"), count(since=at + datetime.timedelta(hours=1)), count(doc_id="d1", user="u1", action="edit")] == [3, 2, 2, 2, 2, 1]
    exports.write_audits(listing.list_audits(audits, chunks), str(tmp_path / "audits"))
    lines = [x for p in sorted((tmp_path / "audits").glob("part-*")) for x in p.read_text().splitlines()[1:]]
    assert lines == ["c2,d2,u2,edit,,2024-01-02T03:04:05", "c1,d1,u2,bulk_apply,r,2024-01-03T03:04:05.000005", "c1,d1,u1,edit,r,2024-01-04T03:04:05"]


def test_document_listing(spark):
    documents = spark.createDataFrame([(1, 1, "pdf"), (2, 1, "html"), (3, 2, "pdf"), (4, 3, "pdf"), (5, 1, "pdf")], "doc_id int, project_id int, source_type string")
    versions = spark.createDataFrame([(1, 1, "parsed", {"a": "Old"}), (1, 2, "needs_review", {"a": "New Title"}), (2, 1, "parsed", {"a": "x"}), (3, 1, "parsed", {"b": "new"}), (4, 1, "parsed", {"b": "new"})], "doc_id int, version int, status string, meta map<string,string>")
    projects = spark.createDataFrame([(1, True), (2, True), (3, False)], "project_id int, is_active boolean")
    found = lambda **f: sorted(r["doc_id"] for r in listing.list_documents(documents, versions, projects, **f).collect())
    assert (found(), found(include_deleted=True), found(project_id=1), found(kind="html"), found(status="parsed")) == ([1, 2, 3], [1, 2, 3, 4], [1, 2], [2], [2, 3])
    assert (found(q="NEW"), found(q="old"), found(q='"b"'), found(q="n_w"), found(scope=2), found(scope=2, project_id=2)) == ([1, 3], [], [3], [1, 3], [3], [3])
    with pytest.raises(PermissionError):
        found(scope=2, project_id=1)


@pytest.mark.parametrize("q", ["alpha", "ALP", "a", "", "al%ma", "g_mma", "%%", "zzz", "é漢字", "ß", "a\\%b", "ma del", "İx"])
def test_search_equals_a_plain_filter(spark, q):
    texts = ["alpha beta", "Alpha Gamma", "gamma delta", None, "", "al", "é漢字 ALPHA", "STRASSE straße", "100a%b", "a b", "İxyz", "ixyz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    index = listing.gram_index(rows, "id", "t")
    found, candidates = listing.search(index, rows, "id", "t", q)
    want = {r["id"] for r in rows.where(listing.matches(F.col("t"), q)).collect()}
    assert {r["id"] for r in found.collect()} == want and (candidates is None or len(want) <= candidates < len(texts))
