"""SimHash joins and fill-in-middle against brute force, and on awkward tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import fill_middle, simhash_join

DOCS = "doc_id long, text string, lang string, fp string, key int, part int, n int, form string"


def prose(rng, n, words=("the", "of", "and", "tion", "ened", "reath", "ingou", "atand", "shere", "onble")):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 90)) for _ in range(40)]
    edited = []
    for b in base[:20]:
        words = b.split()
        words[rng.randrange(len(words))] = "changed"
        edited.append(" ".join(words))
    odd = [None, "", "  \n ", "one two", "ONE\ttwo", " lead and trail \v", "has <P> mark", "a<S>", "<M>", "é漢🎉 ▁ x y", "a" * 300_000, prose(rng, 20_000), "<<P", "x <P y> <S z", "\n\n"]
    return [*base, *edited, base[3], base[3].upper(), *odd, *(f"doc {i} of few" for i in range(30))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "f", 1, 2, 3, "g") for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[2], *[None] * 6), (7, "another text with the id of seven", "en", "f", 1, 2, 3, "g")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    owner = list(range(len(fps)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                owner[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash_join_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {r: min((d for (d, _), x in zip(rows, roots, strict=True) if x == r and d is not None), default=None) for r in roots}
    want = sorted(((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(map(tuple, simhash_join.join(docs).collect()), key=str) == want


@pytest.mark.parametrize("m,tile", [(1, 4096), (1, 16), (2, 8), (4, 64), (8, 64), (16, 4096)])
def test_tiles_lose_no_link(spark, m, tile):
    rng = random.Random(m)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1, 3, 7, 15, 31}
    for f in list(fps)[:80]:
        for _ in range(3):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(f)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash_join.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), m, tile).collect()
    place = {x: k for k, x in enumerate(signed)}
    assert all((fps[place[r["a"]]] ^ fps[place[r["b"]]]) for r in links)
    labels = simhash_join.merged(np.arange(len(fps)), np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
    assert labels.tolist() == brute_components(fps)


def test_a_dense_group_sends_no_pairs(spark):
    fps = [(1 << a) | (1 << b) for a in range(40) for b in range(a)]  # each within two bits of 76 others and more
    links = simhash_join.linked_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), 1, 100)
    assert links.count() < 10 * len(fps)


def test_blocks_keep_tiles_small():
    assert [simhash_join.blocks_for(n) for n in (0, 50_000, 200_000, 10_000_000, 10**9, 10**11)] == [1, 1, 2, 4, 8, 16]


# Fill-in-middle

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    spm = h[3] % 100 < 80
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [1, 50, 1 << 16])
def test_fill_in_middle_equals_brute_force_and_is_undone(docs, frame_bytes):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((brute_fim(*r) for r in rows), key=str)
    got = fill_middle.transform(fill_middle.store(docs, frame_bytes)).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str) == want
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r["output_sha256"] == digest(r["output"]) for r in got)
    assert sorted(r["restored_sha256"] for r in got) == sorted(digest(r["text"] or "") for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_a_cut_opens_one_frame():
    import zstandard

    text, opened = b" ".join(b"w%d" % i for i in range(5000)) + b"  ", []
    pack = zstandard.ZstdCompressor().compress
    parts = fill_middle.frames_of(text, pack, 1000)
    unpack = lambda x: opened.append(x) or zstandard.ZstdDecompressor().decompress(x)
    kept = fill_middle.Frames(*parts, unpack)
    assert kept.n == 5001 and len(kept.frames) > 20 and sum(kept.sizes) == len(text)
    for cut in (0, 1, 777, 5000, 5001):
        opened.clear()
        k, at, chars = kept.place(cut)
        assert len(opened) <= 1 and sum(kept.sizes[:k]) + at == chars == ([0, *fill_middle.unit_ends(text).tolist()][cut])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash_join.join(none).count() == 0 and fill_middle.transform(fill_middle.store(none)).count() == 0


def test_clashing_names_are_not_read(docs):
    renamed = docs.withColumns({"units": F.lit(1), "frames": F.lit("x"), "smallest": F.lit(2), "component": F.lit(3)})
    assert sorted(map(str, simhash_join.join(renamed).collect())) == sorted(map(str, simhash_join.join(docs).collect()))
    assert fill_middle.transform(fill_middle.store(renamed)).count() == docs.count()
