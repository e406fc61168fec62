"""Stored chunks against the pure upsert; what an upsert writes; replays, writers that clash, compaction."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import releases
from corpusmill.sources import store

ROWS = "doc_id string, version int, `order` int, chunk_id string, text string, text_hash string"


def rows(docs, change=""):
    return [(f"d{d}", 1, k, f"d{d}-{k}-{t}", t, f"h{t}") for d in docs for k in range(3) for t in [f"text {k}" + (change if k == 1 else "")]]


@pytest.fixture
def made(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store", buckets=8)
    s.upsert(spark.createDataFrame(rows(range(300)), ROWS), "first")
    return s


def shown(df):
    return sorted((r["doc_id"], r["version"], r["order"], r["chunk_id"], r["rev"], tuple(sorted(r["curated"].items()))) for r in df.collect())


def files(tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet")}


def test_an_upsert_writes_what_it_changes(spark, made, tmp_path):
    before = files(tmp_path)
    deltas = made.upsert(spark.createDataFrame(rows([3, 7, 200], "!"), ROWS), "second")
    after = files(tmp_path)
    new = {f: n for f, n in after.items() if f not in before}
    assert before.items() <= after.items() and len(new) <= 6  # nothing stored is written again; rows and keys of three buckets at most
    assert {tuple(r) for r in deltas.collect()} == {(f"d{d}", 0, 0, 1) for d in (3, 7, 200)}
    got = shown(made.read())
    assert len(got) == 900 and {r[0] for r in got if r[4] == 2} == {"d3", "d7", "d200"}


def test_a_row_sequence_equals_the_pure_upsert(spark, made):
    rng, state = random.Random(5), None
    state = made.read()
    for n in range(3):
        picked = rows(rng.sample(range(310), 40), f"-{n}")
        picked = [r for r in picked if rng.random() < 0.8]
        incoming = spark.createDataFrame(picked, ROWS)
        final, _, _ = releases.upsert(state, incoming)
        touched = incoming.select("doc_id", "version").distinct()
        state = spark.createDataFrame(state.join(touched, ["doc_id", "version"], "left_anti").unionByName(final).collect(), state.schema)
        made.upsert(incoming, f"n{n}")
        assert shown(made.read()) == shown(state)
    made.compact()
    assert shown(made.read()) == shown(state) and len(made.commits()) == 1
    assert made.vacuum() == 4 and shown(made.read()) == shown(state)


def test_replays_change_nothing(spark, made, tmp_path):
    incoming = spark.createDataFrame(rows([1, 2], "?"), ROWS)
    assert made.upsert(incoming, "again") is not None
    before, there = shown(made.read()), files(tmp_path)
    assert made.upsert(incoming, "again") is None and made.upsert(spark.createDataFrame(rows([9], "z"), ROWS), "first") is None
    made.compact()
    assert made.upsert(incoming, "again") is None
    assert shown(made.read()) == before and there.items() <= files(tmp_path).items()


def test_writers_that_clash(spark, made, tmp_path, monkeypatch):
    other = store.ChunkStore(spark, made.path, id_type="long", buckets=3)
    assert (other.schema, other.buckets) == (made.schema, 8)
    stale = made.commits()
    monkeypatch.setattr(other, "commits", lambda: stale)
    made.upsert(spark.createDataFrame(rows([4], "a"), ROWS), "mine")
    before = shown(made.read())
    with pytest.raises(store.Conflict):
        other.upsert(spark.createDataFrame(rows([5], "b"), ROWS), "theirs")
    assert shown(made.read()) == before
    assert made.upsert(spark.createDataFrame(rows([5], "b"), ROWS), "theirs").count() == 1


def test_an_attempt_that_breaks_leaves_nothing_to_read(spark, made, tmp_path):
    before = shown(made.read())
    bad = spark.createDataFrame(rows([8], "x"), ROWS).withColumn("text", F.when(F.col("order") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        made.upsert(bad, "broken")
    assert shown(made.read()) == before and len(made.commits()) == 1
    assert json.loads((tmp_path / "store" / "store.json").read_text())["buckets"] == 8


def test_nothing_stored(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/none")
    assert s.read().count() == 0 and s.upsert(spark.createDataFrame([], ROWS), "empty").count() == 0 and s.read().count() == 0
