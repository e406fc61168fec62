import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import agreement, curation, datasets, dedup, numbering, quality, releases, retrieval, routing
from corpusmill.sources import chunks as files
from corpusmill.sources import shared
from corpusmill.streaming import live


def greedy(texts, threshold):
    kept = []
    for i, t in enumerate(texts):
        words = t.split()
        votes = [0] * 64
        for w in words:
            h = int(hashlib.md5(w.encode()).hexdigest(), 16)
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        sim = sum(1 << b for b in range(64) if votes[b] > 0)
        mins = [min(hashlib.sha1(f"{w}-{k}".encode()).hexdigest() for w in words) for k in range(64)]
        near = lambda o: any((o[1] >> s & 255) == (sim >> s & 255) for s in range(0, 64, 8)) and (o[1] ^ sim).bit_count() <= int(64 * (1 - threshold)) and sum(a == b for a, b in zip(o[2], mins, strict=True)) / 64 >= threshold
        if not any(near(o) for o in kept):
            kept.append((i, sim, mins))
    return [k[0] for k in kept]


def test_near_duplicates_as_a_greedy_pass(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(30):
        base = list(rng.choice(texts).split()) if texts and rng.random() < 0.7 else rng.sample(words, 30)
        base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    found = [r["id"] for r in dedup.drop_near_duplicates(rows, ["id"], threshold=0.8).orderBy("id").collect()]
    assert found == greedy(texts, 0.8)


def test_near_duplicate_stats(spark):
    rows = spark.createDataFrame([(0, "alpha"), (1, "alpha"), (2, "beta"), (3, "")], "id int, text string")
    stats = dedup.drop_stats(rows, dedup.drop_near_duplicates(rows, ["id"])).first()
    assert (stats["input"], stats["kept"], stats["dropped"]) == (4, 3, 1)


def test_kappa_and_conflict(spark):
    a = spark.createDataFrame([(1, 7, "u1", "edit", {}, {"severity": "low"}, 1), (2, 7, "u2", "edit", {"severity": "low"}, {"severity": "high"}, 2)], "audit_id int, chunk_id int, user string, action string, before map<string,string>, after map<string,string>, created_at int")
    assert [(r["field"], r["kappa"]) for r in agreement.agreement(a).collect()] == [("severity", 0.0)]
    assert [r["action"] for r in agreement.conflicts(a).orderBy("audit_id").collect()] == ["edit", "edit_conflict"]


def test_completeness(spark):
    c = spark.createDataFrame([(1, {"severity": "high"}), (1, {"severity": ""})], "doc_id int, curated map<string,string>")
    assert quality.completeness(c, F.array(F.lit("severity"))).first()["curation_completeness"] == 0.5


def test_rename_values(spark):
    c = spark.createDataFrame([("c1", 1, {"severity": "low"}, False)], "chunk_id string, rev int, curated map<string,string>, stale boolean")
    new, audits = curation.rename_values(c, "severity", {"low": "minor"}, "u", ["low", "high"])
    assert (new.first()["curated"], new.first()["stale"], new.first()["rev"]) == ({"severity": "minor"}, True, 2)
    assert audits.first()["before"] == {"severity": "low"}
    with pytest.raises(ValueError):
        curation.rename_values(c, "severity", {"none": "x"}, "u", ["low"])


def test_select_chunks_needs_all(spark):
    c = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "chunk_id string, doc_id int, order int")
    with pytest.raises(ValueError):
        curation.select_chunks(c, ids=spark.createDataFrame([("z",)], "chunk_id string"))
    assert curation.select_chunks(c, doc_id=1, first=1, last=1).first()["chunk_id"] == "b"


CHUNK = "doc_id string, version int, order int, chunk_id string, text string, text_hash string, rev int, curated map<string,string>"


def test_upsert(spark):
    old = spark.createDataFrame([("d", 1, 0, "c0", "a", "h0", 1, {"k": "v"}), ("d", 1, 1, "c1", "b", "h1", 1, {}), ("d", 1, 2, "c2", "c", "h2", 1, {})], CHUNK)
    new = spark.createDataFrame([("d", 1, 0, "c0", "a", "h0", 1, {}), ("d", 1, 1, "c9", "B", "h9", 1, {})], CHUNK)
    final, deleted, deltas = releases.upsert(old, new)
    assert [(r["order"], r["rev"], r["curated"]) for r in final.orderBy("order").collect()] == [(0, 1, {"k": "v"}), (1, 2, {})]
    assert sorted(r["chunk_id"] for r in deleted.collect()) == ["c1", "c2"]
    assert [tuple(r) for r in deltas.collect()] == [("d", 0, 1, 1)]
    again, gone, same = releases.upsert(final, new)
    assert gone.count() == 0 and same.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, final.collect()))


def test_stratified_split(spark):
    rows = [(f"d{d}", o, "high" if d < 2 else "low") for d in range(4) for o in range(2)]
    out = releases.stratified_split(spark.createDataFrame(rows, "doc_id string, order int, severity string"), ["severity"], {"train": 0.5, "test": 0.5}, 42)
    assert {(r["severity"], r["split"]): r["count"] for r in out.groupBy("severity", "split").count().collect()} == {(s, p): 2 for s in ("high", "low") for p in ("train", "test")}


def test_exports(spark, tmp_path):
    record = [("d1", f"c{i}", i, 1, ("text", t), (1, ["Intro"]), "h", {}) for i, t in enumerate(("hello", "world"))]
    c = spark.createDataFrame(record, files.CHUNK_SCHEMA)
    lines = sorted(r["value"] for r in files.json_lines(c, files.fields_of("rag")).collect())
    assert lines == ['{"context":"Intro: hello","answer":""}', '{"context":"Intro: world","answer":""}']
    files.write_csv(c, {"text": "content.text", "page": "source.page"}, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == [("1", "hello"), ("1", "world")]
    files.write_bundle(c, files.fields_of("sft"), str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle")).select("split").distinct().first()[0] == "train"
    first = files.export(c, files.fields_of("rag"), "file://" + str(tmp_path / "out"), {"p": 1})
    assert files.export(c.limit(0), files.fields_of("rag"), "file://" + str(tmp_path / "out"), {"p": 1}) == first
    assert spark.read.text(first + "/data").count() == 2
    with pytest.raises(ValueError):
        files.fields_of()


def test_holdout(spark):
    r = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "line_no long, text string")
    assert sorted((x["line_no"], x["split"]) for x in datasets.sft(r, 0.33).collect()) == [(0, "validation"), (1, "train"), (2, "train")]
    assert sorted(x["split"] for x in datasets.sft(r.limit(1), 0.33).collect()) == ["train", "validation"]


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=7 * i), f"k{i % 3}") for i in range(60)] + [(t0 + timedelta(hours=1), "end")]
    requests = spark.createDataFrame(rows, "ts timestamp, key string")
    requests.write.parquet(str(tmp_path / "in"))
    stream = live.request_rates(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in")), 2)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "res")).trigger(availableNow=True).start().awaitTermination()
    batch = live.request_rates(requests, 2)
    seen = spark.read.parquet(str(tmp_path / "res"))
    assert seen.count() > 0 and seen.exceptAll(batch).count() == 0 and batch.exceptAll(seen).where("key <> 'end'").count() == 0


def test_events_fold_in_order(spark):
    c = spark.createDataFrame([(1, 1, {"a": "0"})], "chunk_id int, rev long, curated map<string,string>")
    e = spark.createDataFrame([(1, 3, "u", {"a": "2"}), (1, 1, "u", {"a": "1"}), (1, 2, "v", {"a": "1"})], "chunk_id int, event_no long, user string, patch map<string,string>")
    new, audits = live.apply_events(c, e)
    assert (new.first()["curated"], new.first()["rev"]) == ({"a": "2"}, 3)
    assert [(r["event_no"], r["before"], r["after"]) for r in audits.orderBy("event_no").collect()] == [(1, {"a": "0"}, {"a": "1"}), (3, {"a": "1"}, {"a": "2"})]


def test_vector_top_k_of_many_queries(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 7), ("VECTOR_BLOCK", 40), ("QUERY_SLICE", 3)):
        monkeypatch.setattr(retrieval, name, n)
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(400)] + [(400, None)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.vector_top_k_batch(asked, df, 10).collect())
    want = []
    for q, x in rows[:400:20]:
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in rows[:400])[:10]
        want += [(q, n + 1, v) for n, (_, v) in enumerate(best)]
    assert found == want
    assert retrieval.vector_top_k_batch(asked.limit(0), df, 3).count() == 0


def test_searches_ask_every_twentieth_row(spark, tmp_path):
    from corpusmill.plans import QUERIES

    spark.createDataFrame([(i, f"word{i} common text") for i in range(60)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"word{i % 60} other", "en", "s") for i in range(90)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["i8_chunk_searches"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40} and {r["chunk_id"] for r in found if r["query_id"] == 20 and r["rank"] <= 1} == {"20-0"}
    assert {r["query_id"] for r in QUERIES["i4_vector_searches"](spark, str(tmp_path)).collect()} == {0, 20, 40}


def test_refs_meet_one_binding_a_scope(spark):
    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(n)])
    bindings = [(k, some(4), some(5), rng.choice(["a", "b", None]), rng.randrange(3), rng.randrange(4), rng.random() < 0.8) for k in range(80)]
    requests = [(k % 55, some(5), some(7), rng.choice(["a", "b", "none", None])) for k in range(60)]
    b = spark.createDataFrame(bindings, "binding_id long, project_id long, document_id long, model_ref string, priority int, created_at int, enabled boolean")
    r = spark.createDataFrame(requests, "request_id long, project_id long, document_id long, model_ref string")
    want = {}
    for i, p, d, ref in requests:
        met = [(int(not (d is not None and x[2] == d)), int(not (p is not None and x[1] == p)), x[4], -x[5], x[0]) for x in bindings if x[6] and ref is not None and x[3] == ref and x[1] in (None, p)]
        want[i, ref] = min([want.get((i, ref), (9, 0, 0, 0, None)), *met], key=lambda x: x[:4] + ((x[4] or 0),))
    done = routing.resolve_refs(r, b)
    assert {(x["request_id"], x["model_ref"]): x["binding_id"] for x in done.collect()} == {k: v[4] for k, v in want.items()} and done.count() == len(want)
    # Each scope's bindings are ranked before they are joined, so no join makes a row for each pair.
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 4


def test_whole_queries_leave_nothing_out(spark, tmp_path):
    from corpusmill.plans import QUERIES

    text = " ".join(f"w{k}" for k in range(300))
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted((r["ord"], r["mins"].count(",")) for r in QUERIES["f2_chunk_minhash"](spark, str(tmp_path)).collect()) == [(0, 63), (1, 63), (2, 63)]
    found = QUERIES["j2_i11_sft"](spark, str(tmp_path)).collect()
    assert found and all(r["text"].count(text) == 2 for r in found)


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(22)
    rows = []
    for k in range(400):
        value, before = rng.choice([None, "a", "b", "c"]), rng.choice([None, "a", "b", "c"])
        rows.append((k, rng.randrange(6), rng.choice(["u", "v", "w", None]), {"f": before, "g": "x"}, {"f": value, "g": rng.choice("xy")}, rng.randrange(40), "edit"))
    df = spark.createDataFrame(rows, "audit_id long, chunk_id long, user string, before map<string,string>, after map<string,string>, created_at int, action string").repartition(3)
    want = set()
    for a in rows:
        for f in ("f", "g"):
            if a[4][f] != a[3][f] and any(b[1] == a[1] and None not in (a[2], b[2]) and b[2] != a[2] and b[4][f] != a[4][f] and (b[5], b[0]) < (a[5], a[0]) for b in rows):
                want.add(a[0])
    assert {r["audit_id"] for r in agreement.conflicts(df).where("action = 'edit_conflict'").collect()} == want and 20 < len(want) < 380


def test_bindings_and_routes(spark):
    rng = random.Random(23)
    some = lambda n: rng.choice([None, *range(n)])
    bindings = [(k, some(4), some(5), "m", rng.randrange(3), rng.randrange(4), rng.random() < 0.8) for k in range(80)]
    requests = [(k, some(5), some(7)) for k in range(50)]
    b = spark.createDataFrame(bindings, "binding_id long, project_id long, document_id long, model_ref string, priority int, created_at int, enabled boolean")
    r = spark.createDataFrame(requests, "request_id long, project_id long, document_id long")
    want, routes = set(), set()
    for i, p, d in requests:
        own = [x for x in bindings if x[6] and d is not None and x[2] == d]
        near = [x for x in bindings if x[6] and p is not None and x[1] == p and x[2] is None]
        want |= {(i, x[0], n + 1) for n, x in enumerate(sorted(own or near, key=lambda x: (x[4], -x[5], x[0]))[:2])}
        mine = [x for x in bindings if p is not None and x[1] == p and d is not None and x[2] == d] or [x for x in bindings if p is not None and x[1] == p and x[2] is None]
        routes |= {(i, x[0], n + 1) for n, x in enumerate(sorted(mine, key=lambda x: (-x[5], x[0])))}
    assert {(x["request_id"], x["binding_id"], x["rank"]) for x in routing.resolve_bindings(r, b).collect()} == want
    assert {(x["request_id"], x["route_id"], x["rank"]) for x in routing.resolve_routes(r, b.withColumnRenamed("binding_id", "route_id")).collect()} == routes


def test_numbers_within_groups(spark):
    rng = random.Random(24)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k) for k in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    want = {(g, k): sum(1 for h, j in rows if h == g and j <= k) for g, k in rows}
    assert {(r["g"], r["k"]): r["n"] for r in numbering.numbered_within(df, ["g"], ["k"]).collect()} == want


def test_manifest_hash_by_levels(spark, monkeypatch):
    rows = [(k, f"h{k}", {f"c{k}": "t"}) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, doc_hash string, chunks map<string,string>")
    one = releases.manifest_hash(df).first()[0]
    monkeypatch.setattr(releases, "FAN", 4)
    deep = releases.manifest_hash(df).first()[0]
    leaves = sorted(hashlib.sha256(f"{k}|h{k}|c{k}=t".encode()).hexdigest() for k in range(300))
    join = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    assert one == join(leaves) and deep == join(join([x for x in leaves if x[:3] == p]) for p in sorted({x[:3] for x in leaves}))
    assert releases.manifest_hash(df.repartition(7)).first()[0] == deep


def test_a_flat_manifest_hash_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(releases, "FAN", 4)
    rows = [(k, f"h{k}", {f"c{k}": "t"}) for k in [*range(300), *range(20)]]  # some hashes are there twice
    df = spark.createDataFrame(rows, "doc_id long, doc_hash string, chunks map<string,string>")
    want = hashlib.sha256("".join(sorted(hashlib.sha256(f"{k}|h{k}|c{k}=t".encode()).hexdigest() for k, *_ in rows)).encode()).hexdigest()
    assert [r[0] for n in (1, 7) for r in releases.manifest_hash(df.repartition(n), flat=True).collect()] == [want, want]
    assert [r[0] for r in releases.manifest_hash(df.limit(0), flat=True).collect()] == [None]


def test_evidence_keeps_to_its_scope(spark):
    chunks = [(f"c{k}", k % 6, k, f"common words and number {k} of a chunk", f"h{k % 20}", ["s"], k % 2) for k in range(40)]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id long, `order` int, text string, text_hash string, section_path array<string>, project_id long")
    p = spark.createDataFrame([(1, "common words 7", 3, 0), (2, "common words 8", None, 0), (3, "common words", None, 9), (4, "words nowhere common", 77, 1)], "prompt_id long, prompt string, doc_id long, project_id long")
    rows = retrieval.evidence(p, c).collect()
    of = lambda k: [r for r in rows if r["prompt_id"] == k]
    assert len(of(1)) == 4 and {r["doc_id"] for r in of(1)} == {3} and {r["doc_id"] % 2 for r in of(2)} == {0} and not of(3) and not of(4)
    assert {r["chunk_id"] for r in retrieval.evidence(p, c, most_candidates=2).collect() if r["prompt_id"] == 1} == {"c3", "c9"}


def test_sources_round_trip(spark, tmp_path):
    import io
    import json
    import zipfile

    line = {"doc_id": "1", "chunk_id": "a", "order": 0, "rev": 1, "content": {"type": "text", "text": "x"}, "source": {"page": 1, "section_path": ["s"]}, "text_hash": "h", "metadata": {"k": "v"}}
    (tmp_path / "chunks.jsonl").write_text("\n".join(json.dumps(line | {"doc_id": str(k), "chunk_id": f"c{k}"}) for k in range(3)))
    assert [r["chunk_id"] for r in files.read_chunks(spark, str(tmp_path / "chunks.jsonl"), ["1"]).collect()] == ["c1"]
    assert files.read_chunks(spark, str(tmp_path / "chunks.jsonl")).count() == 3
    (tmp_path / "red.jsonl").write_text(json.dumps({"chunk_id": "c1", "redactions": [{"type": "email", "text": "x"}]}))
    assert files.read_redactions(spark, str(tmp_path / "red.jsonl")).first()["redactions"][0]["text"] == "x" and files.read_redactions(spark, str(tmp_path / "none")).count() == 0
    pages = tmp_path / "pages"
    pages.mkdir()
    for name in ("b.html", "a.htm", "c.txt"):
        (pages / name).write_text(f"<p>{name}</p>")
    found = {r["page_id"]: r["html"] for r in files.read_html_files(spark, str(pages)).collect()}
    assert found == {0: "<p>a.htm</p>", 1: "<p>b.html</p>"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("n/2.html", "two")
        z.writestr("1.HTM", "one")
        z.writestr("x.txt", "no")
    (tmp_path / "z.zip").write_bytes(packed.getvalue())
    assert [(r["name"], r["html"]) for r in files.read_html_archives(spark, str(tmp_path)).collect()] == [("1.HTM", "one"), ("n/2.html", "two")]


def test_shared_tables_are_cleared(spark):
    made = shared.materialize(spark.range(3), "test")
    path = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path) and shared.clear(spark) >= 1 and not os.path.exists(path)


def test_new_documents_against_stored_hashes(spark, tmp_path):
    rows = [(1, "a", 1), (1, "b", 2), (2, "a", 3), (1, "b", 4)]
    df = spark.createDataFrame(rows, "project_id long, doc_hash string, n int").withColumn("ts", F.timestamp_seconds("n"))
    stored = spark.createDataFrame([(1, "a")], "project_id long, doc_hash string")
    want = {(1, "b", 2), (2, "a", 3)}
    assert {(r["project_id"], r["doc_hash"], r["n"]) for r in live.new_documents(df, stored).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.new_documents(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), stored)
    stream.writeStream.format("memory").queryName("fresh").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert {(r["project_id"], r["doc_hash"]) for r in spark.table("fresh").collect()} == {x[:2] for x in want}


def test_a_replayed_batch_leaves_the_same(spark, tmp_path):
    schema = "chunk_id long, event_no long, user string, patch map<string,string>"
    base = spark.createDataFrame([(1, {"a": "0"}, 1), (2, {}, 1)], "chunk_id long, curated map<string,string>, rev long")
    base.write.parquet(str(tmp_path / "state-0"))
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[(1, 1, "u", {"a": "1"}), (2, 2, "u", {"b": "2"})], [(1, 3, "v", {"a": "1", "c": "3"})]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fail = {"at": 1}

    def write_chunks(df, number):
        if fail["at"] == number:  # the audits of this batch are written, its chunks aren't
            fail["at"] = None
            raise RuntimeError("lost")
        df.write.mode("overwrite").parquet(str(tmp_path / f"state-{number + 1}"))

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.curate_stream(events, lambda n: spark.read.parquet(str(tmp_path / f"state-{n}")), write_chunks, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"audits-{n}")), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception):
        run()
    run()
    state = {r["chunk_id"]: (r["curated"], r["rev"]) for r in spark.read.parquet(str(tmp_path / "state-2")).collect()}
    assert state == {1: ({"a": "1", "c": "3"}, 3), 2: ({"b": "2"}, 2)}
    audits = sorted((r["event_no"], r["before"], r["after"]) for n in (0, 1) for r in spark.read.parquet(str(tmp_path / f"audits-{n}")).collect())
    assert audits == [(1, {"a": "0"}, {"a": "1"}), (2, {}, {"b": "2"}), (3, {}, {"c": "3"})]
