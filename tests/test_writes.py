"""Writes against a plain loop over the edits, and gates against a full computation."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import curation

CHUNKS = "chunk_id string, doc_id int, rev int, curated map<string,string>, suggestions map<string,struct<value:string,confidence:double>>, stale boolean, edit_no int, user string"
EDITS = "chunk_id string, edit_no long, user string, kind string, field string, entries map<string,string>"
FIELDS, VALUES, USERS = ("severity", "label", "note"), ("low", "high", " ", "x"), ("u1", "u2", "u3", None)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    pick = lambda: {f: rng.choice(VALUES) for f in FIELDS if rng.random() < 0.6}
    chunks = [(f"c{i}", i % 12, 1, pick() or None, {f: (rng.choice(VALUES), 0.5) for f in FIELDS if rng.random() < 0.5} or None, None, 5, "x") for i in range(60)]
    edits = []
    for no in range(700):
        kind = rng.choice(("patch", "patch", "bulk", "accept", "accept", "rename"))
        field = rng.choice(FIELDS) if kind in ("accept", "rename") else None
        entries = pick() if kind in ("patch", "bulk") else {"low": "minor", "x": "low"} if kind == "rename" else None
        edits.append((f"c{7 if rng.random() < 0.3 else rng.randrange(64)}", no, rng.choice(USERS), kind, field, entries))
    history = [(f"c{rng.randrange(60)}", rng.choice(USERS), pick()) for _ in range(100)]
    return chunks, edits, [*history, ("c0", "u9", None)]


def loop(chunks, edits, history):
    state = {c[0]: [dict(c[3] or {}), dict(c[4] or {}), c[2], c[5]] for c in chunks}
    said, audits = [(c, u, v or {}) for c, u, v in history], []
    for c, no, user, kind, field, entries in sorted(edits, key=lambda e: e[1]):
        if c not in state:
            continue
        before, offers, rev, stale = state[c]
        if kind == "accept":
            if field not in offers:
                continue
            after = {**before, field: offers.pop(field)[0]}
        elif kind == "rename":
            if before.get(field) not in entries:
                continue
            after, stale = {**before, field: entries[before[field]]}, True
        else:
            after = {**before, **entries}
            if kind == "patch" and after == before:
                continue
        moved = {k: v for k, v in after.items() if before.get(k) != v}
        clash = user is not None and any(x == c and u is not None and u != user and k in old and old[k] != v for x, u, old in said for k, v in moved.items())
        audits.append((c, no, user, curation.ACTIONS[kind] + "_conflict" * clash, before, after))
        said.append((c, user, after))
        state[c] = [after, offers, rev + 1, stale]
    return state, audits


def test_writes_equal_a_loop(spark, tables):
    chunks, edits, history = tables
    new, audits = curation.write(spark.createDataFrame(chunks, CHUNKS).repartition(3), spark.createDataFrame(edits, EDITS).repartition(3), spark.createDataFrame(history, "chunk_id string, user string, after map<string,string>"))
    state, want = loop(chunks, edits, history)
    got = sorted(((r["chunk_id"], r["edit_no"], r["user"], r["action"], r["before"], r["after"]) for r in audits.collect()), key=lambda r: r[1])
    assert got == want and {a[3] for a in want} >= {"metadata_update_conflict", "bulk_apply", "accept_suggestion_conflict", "taxonomy_migration"}
    rows = new.collect()
    assert len(rows) == len(chunks) and new.columns == [c.split()[0] for c in CHUNKS.split(", ") if not c.startswith("confidence")]
    for r in rows:
        values, offers, rev, stale = state[r["chunk_id"]]
        assert (r["curated"] or {}, {k: tuple(v) for k, v in (r["suggestions"] or {}).items()}, r["rev"], bool(r["stale"])) == (values, offers, rev, bool(stale))


def test_gates_after_writes_equal_a_full_computation(spark, tables):
    chunks, edits, _ = tables
    before = spark.createDataFrame(chunks, CHUNKS)
    new, audits = curation.write(before, spark.createDataFrame(edits, EDITS))
    docs = spark.createDataFrame([(i, "text/plain", 0.0, 1.0, 1.0, 0.0, 0.0, 0, i % 3 == 0) for i in range(14)], "doc_id int, mime string, empty_chunk_ratio double, html_section_path_coverage double, text_coverage double, ocr_ratio double, utf_other_ratio double, pii_count int, block_pii boolean")
    required = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("severity"), F.lit("label"))).otherwise(F.array(F.lit("label")))
    shown = lambda df: sorted(map(tuple, df.select("doc_id", "n_chunks", "n_complete", "curation_completeness", F.array_join("failed_gates", ","), "status").collect()))
    old = curation.gate_table(docs, before, required)
    got, want = shown(curation.regate(old, before, audits, required)), shown(curation.gate_table(docs, new, required))
    assert got == want and got != shown(old) and [r[5] for r in got if r[0] > 11] == ["needs_review"] * 2


def test_two_patches_of_one_chunk(spark):
    c = spark.createDataFrame([("a", 1, {"z": "0"})], "chunk_id string, rev int, curated map<string,string>")
    p = spark.createDataFrame([("a", "u", {"x": "2"}, 1), ("a", "v", {"y": "3"}, 2), ("a", "v", {"y": "3"}, 3)], "chunk_id string, user string, patch map<string,string>, edit_no int")
    new, audits = curation.patch(c, p)
    assert [tuple(r) for r in new.collect()] == [("a", 3, {"z": "0", "x": "2", "y": "3"})]
    assert [(r["edit_no"], r["before"]) for r in audits.orderBy("edit_no").collect()] == [(1, {"z": "0"}), (2, {"z": "0", "x": "2"})]


def test_accepting_two_fields_of_one_chunk(spark):
    c = spark.createDataFrame([("a", 1, {}, {"x": ("1",), "y": ("2",)})], "chunk_id string, rev int, curated map<string,string>, suggestions map<string,struct<value:string>>")
    a = spark.createDataFrame([("a", "u", "x"), ("a", "u", "y"), ("a", "u", "none")], "chunk_id string, user string, field string")
    new, audits = curation.accept_suggestions(c, a)
    assert [tuple(r) for r in new.collect()] == [("a", 3, {"x": "1", "y": "2"}, None)] and audits.count() == 2


def test_bulk_counts_what_it_does_not_change(spark):
    c = spark.createDataFrame([("a", 1, {"x": "1"}), ("b", 1, {"x": "0"}), ("c", 4, {})], "chunk_id string, rev int, curated map<string,string>")
    new, audits = curation.bulk_patch(c, c.where("chunk_id <> 'c'"), {"x": "1"}, "u", spark.createDataFrame([("b", "w", {"x": "7"})], "chunk_id string, user string, after map<string,string>"))
    assert {r["chunk_id"]: r["rev"] for r in new.collect()} == {"a": 2, "b": 2, "c": 4}
    assert {r["chunk_id"]: r["action"] for r in audits.collect()} == {"a": "bulk_apply", "b": "bulk_apply_conflict"}


def test_witnesses_answer_for_all():
    rng = random.Random(2)
    for _ in range(300):
        said, w = [], curation.Witnesses()
        for _ in range(rng.randrange(25)):
            pair = rng.randrange(5), rng.randrange(5)
            assert w.contradict(*pair) == any(u != pair[0] and v != pair[1] for u, v in said)
            said.append(pair)
            w.add(*pair)
        assert len(w.pairs) <= 6


def test_renamed_options(spark):
    t = spark.createDataFrame([(1, 1, [("severity", "enum", ["low", "high"])]), (1, 2, [("note", "string", None), ("severity", "enum", ["low", "mid", "minor"])]), (2, 5, [("severity", "enum", ["low"])])], "project_id int, version int, fields array<struct<name:string,type:string,options:array<string>>>")
    got = {(r["project_id"], r["version"]): [tuple(f) for f in r["fields"]] for r in curation.rename_field_options(t, 1, "severity", {"low": "minor"}).collect()}
    assert got[1, 2] == [("note", "string", None), ("severity", "enum", ["minor", "mid"])] and got[1, 1][0][2] == ["low", "high"] and got[2, 5][0][2] == ["low"]
    for project, field, mapping in ((1, "severity", {"none": "x"}), (1, "note", {"a": "b"}), (1, "zzz", {"a": "b"}), (9, "severity", {"low": "x"})):
        with pytest.raises(ValueError):
            curation.rename_field_options(t, project, field, mapping)


def test_nothing_to_write(spark):
    c = spark.createDataFrame([("a", 1, {"x": "1"})], "chunk_id string, rev int, curated map<string,string>")
    new, audits = curation.write(c, spark.createDataFrame([], EDITS))
    assert [tuple(r) for r in new.collect()] == [("a", 1, {"x": "1"})] and audits.count() == 0
    assert [x.count() for x in curation.write(c.limit(0), spark.createDataFrame([("a", 1, "u", "bulk", None, {"x": "2"})], EDITS))] == [0, 0]
