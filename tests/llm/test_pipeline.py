import random

import corpus_pipeline
from test_operators import prose  # noqa: F401


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    shared = prose(rng, 60)
    rows, marks = [], []
    for i in range(400):
        if i % 10 == 0:
            text = " ".join(w + "###" for w in prose(rng, 80).split())
        elif i % 10 == 1:
            text = rows[-10][1].replace("the", "thee", 1) if i > 20 else prose(rng, 150)
        else:
            text = f"{prose(rng, 90)}\n{shared}" if i % 10 == 2 else prose(rng, 100)
        rows.append((i, text, "en", "s0", len(text)))
        marks.append((i, int(i % 10 != 0), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, prose(rng, 4000), "en", "s0", 1), rows[5], (None, prose(rng, 100), "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        if k < 4:
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    junk, clean = {i for i in range(0, 400, 10)}, {i for i in range(400) if i % 10 > 2}
    assert not junk & set(kept[0]) and len(clean & set(kept[1])) >= 0.97 * len(clean)
    assert sum(shared in (t or "") for t in kept[2].values()) == 1
    assert len(kept[3]) < len(kept[2]) and clean & set(kept[1]) <= set(kept[3])
    assert {r["doc_id"] for r in docs.collect()} == set(kept[3])
    assert docs.where("bin_words > 2048").count() == 0 and docs.where("doc_id = 1002").count() == 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_on_awkward_tables(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) + f"\n{prose(rng, 9)}", "en", "s0", 1) for i in range(30)]
    rows += [(40, rows[3][1], None, None, None), rows[5], (None, rows[6][1] + " x", "en", None, 2), (None, None, None, None, None), (50, "", "en", "s", 0), (60, prose(rng, 5000), "en", "s", 0)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("__id", "__row", "component_id", "c", "score", "kept", "d", "e", "ranks", "row", "part", "removed_lines", "a.b", "n_words")
    base = base.select("*", *(corpus_pipeline.F.lit(c).alias(c) for c in names))
    spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(30)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (base, base.limit(0)):
        for most in (0, 1_000_000):
            monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", most)
            for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
                out = stage(spark, docs, str(tmp_path))
                found = corpus_pipeline.materialize(out, "test").collect()
                if k < 4:
                    assert out.columns == docs.columns and all(r["a.b"] == "a.b" for r in found)
                    assert len(found) <= docs.count()
                else:
                    assert {"doc_id", "bin_id", "position", "text"} <= set(out.columns) and len(found) >= docs.count()
