import hashlib
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import pii
from corpusmill.functions import signatures as sg
from corpusmill.functions import text as tx


def one(spark, column, *values, types="t string"):
    return spark.createDataFrame([values], types).select(column.alias("x")).first()["x"]


def test_windows_keep_every_token(spark):
    rng = random.Random(3)
    for _ in range(12):
        words = [f"w{i}" for i in range(rng.randrange(0, 40))]
        target, overlap = rng.randrange(1, 9), rng.randrange(0, 12)
        want, i = [], 0
        while i < len(words):
            want.append(" ".join(words[i : i + target]))
            if i + target >= len(words):
                break
            i += max(1, target - overlap)
        assert one(spark, tx.windows(F.col("t"), target, overlap), " ".join(words)) == want


def test_name_id(spark):
    assert one(spark, tx.name_id(F.col("t")), "doc|1|2|é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc|1|2|é"))


def test_normal_forms(spark):
    assert one(spark, tx.nfc_form(F.col("t")), "A­B  C\u0001ﬁ") == "AB C fi"
    row = one(spark, tx.parse_form(F.col("t")), "a\r\nb\rc\u0000\u001f\td")
    assert (row["text"], row["removed"]) == ("a\nb\nc\td", 2)


def test_char_coverage(spark):
    row = one(spark, tx.char_coverage(F.col("t")), "ABCé漢")
    assert [round(x, 6) for x in row] == [0.6, 0.2, 0.2]
    assert list(one(spark, tx.char_coverage(F.col("t")), "")) == [0, 0, 0]


def test_spans(spark):
    text = "x ```a\nb``` y $E=mc^2$ z $$q$$\n    code\n    more\nend"
    kinds = [(s["type"], s["text"]) for s in one(spark, tx.detect_spans("t"), text)]
    assert ("code_fence", "```a\nb```") in kinds and ("math", "$E=mc^2$") in kinds and ("math", "$$q$$") in kinds
    assert ("monospace", "    code\n    more\n") in kinds


def test_pii_and_redaction(spark):
    text = "Reach me at test@example.com or 555-123-4567 ID123"
    found = one(spark, pii.detect(F.col("t")), text)
    assert [(m["type"], m["text"]) for m in found] == [("email", "test@example.com"), ("phone", "555-123-4567"), ("id", "ID123")]
    assert one(spark, pii.redact(F.col("t"), pii.detect(F.col("t"))), text) == "Reach me at [REDACTED] or [REDACTED] [REDACTED]"


def test_rule_suggestions(spark):
    text = "Step 1: start ERROR INC-42 on 2024-01-01"
    assert {k: v["value"] for k, v in one(spark, pii.suggest(F.col("t")), text).items()} == {"severity": "ERROR", "step_id": "Step 1:", "ticket_id": "INC-42", "datetime": "2024-01-01"}
    assert list(one(spark, pii.suggest(F.col("t"), 2), text)) == ["severity", "step_id"]
    assert one(spark, pii.suggest(F.col("t"), use_rules=False), text) == {}


def simhash(words, digest, least):
    votes = [0] * 64
    for w in words:
        h = digest(w)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    value = sum(1 << b for b in range(64) if votes[b] >= least)
    return value - (1 << 64) if value >> 63 else value


def test_signatures(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    low = lambda t: int(hashlib.md5(t.encode()).hexdigest(), 16) & (1 << 64) - 1
    assert one(spark, sg.simhash(F.col("t")), text) == simhash(text.split(), low, 1)
    grams = [" ".join(text.split()[i : i + 3]) for i in range(len(text.split()) - 2)]
    head = lambda g: int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "big")
    assert one(spark, sg.shingle_simhash(F.col("t")), text) == simhash(grams, head, 0)
    assert one(spark, sg.shingle_simhash(F.col("t")), "two words") == -1
    assert one(spark, sg.shingle_simhash(F.col("t")), "  ") == 0
    mins = one(spark, sg.minhash(F.col("t"), 3), text)
    assert mins == [min(hashlib.sha1(f"{w}-{i}".encode()).hexdigest() for w in text.split()) for i in range(3)]


def test_shingle_simhash_as_a_column_equals_the_step(spark):
    texts = [None, "", "one", "one two", "One  two three", "a b c d a b c", "a b c d a b d"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    column = {r["id"]: r["sim"] for r in rows.select("id", sg.shingle_simhash(F.col("t")).alias("sim")).where("sim is not null").collect()}
    step = {r["id"]: r["sim"] for r in sg.with_shingle_simhash(rows, "id", F.col("t")).collect()}
    assert column == step and len(column) == len(texts) and column[5] != column[6]


def test_signatures_of_a_table_equal_those_of_columns(spark, monkeypatch):
    monkeypatch.setattr(sg, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(sg, "REMEMBERED", 5)
    monkeypatch.setattr(sg, "TEXTS_AT_ONCE", 4)
    texts = [None, "", " ", "one", "one two one", "Two  two three é漢", "a b c d a b c", "x " * 500, "a b c d a b d"] * 4
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    table = {r["id"]: (r["sim"], r["mins"]) for r in sg.with_signatures(rows, "id", "t", 9).collect()}
    columns = {r["id"]: (r["sim"], r["mins"]) for r in rows.select("id", sg.simhash(F.col("t")).alias("sim"), sg.minhash(F.col("t"), 9).alias("mins")).collect()}
    prefix = lambda x: int.from_bytes(bytes.fromhex(x[:16]), "big", signed=True) if len(x) > 1 else 0
    assert len(table) == len(texts)
    for i, t in enumerate(texts):
        assert table[i] == ((columns[i][0], [prefix(x) for x in columns[i][1]]) if t else (0, [0] * 9))


@pytest.mark.parametrize("digests,at_once", [(50_000, 10_000), (3, 2)])
def test_min_hashes_by_remembered_words(spark, monkeypatch, digests, at_once):
    monkeypatch.setattr(sg, "DIGESTS", digests)
    monkeypatch.setattr(sg, "DIGESTS_AT_ONCE", at_once)
    texts = [(1, "a b c a é漢 d"), (2, None), (3, " \u00a0 "), (4, "x"), (5, " ".join(f"w{k % 1500}" for k in range(3000)))]
    rows = spark.createDataFrame(texts, "id int, t string").coalesce(1)
    got = {r["id"]: r["mins"] for r in sg.with_minhash(rows, "t", permutations=5).collect()}
    want = {k: [min((hashlib.sha1(f"{w}-{i}".encode()).hexdigest() for w in (t or "").split()), default="0") for i in range(5)] for k, t in texts}
    assert got == want


def test_min_hashes_that_begin_alike():
    known = sg._WordDigests(1)
    known.known, known.whole, known.heads = {"a": 0, "b": 1, "c": 2}, [b"\0" * 8 + b"z" * 12, b"\0" * 8 + b"y" * 12, b"\1" * 20], np.array([[0], [0], [1]], np.uint64)
    assert known.least(["a", "b", "c"]) == [(b"\0" * 8 + b"y" * 12).hex()]
