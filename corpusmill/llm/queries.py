"""The queries of this subpackage's operators, each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, collocations, fill_middle, jaccard_join, line_crf, line_dedup, packing, quality_rules, sentencepiece, simhash_join, topk, toxicity, warc
from .common import materialize, small_batches, table

#: The tokenizer's file; any BPE model file will do.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece.encode(_documents(spark, sf_dir), MODEL, decoded="decoded")
    hexed = lambda x: F.sha2(x.cast("binary"), 256)
    decimals = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        hexed(decimals("ids")).alias("ids_sha256"),
        hexed(F.col("decoded")).alias("decoded_sha256"),
        hexed(decimals("bounds")).alias("bounds_sha256"),
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(_documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sized_by_component(docs: DataFrame) -> DataFrame:
    """doc_id, n (words), source, cluster and row: the cluster is the least row key among the rows linked to the row (five words,
    0.75). Rows are named by a hash of doc_id and text, so that null and repeated ids are told apart; full repeats are linked."""
    keyed = docs.select(packing.row_of().alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"))
    found = jaccard_join.counted_join(keyed, keep=("id", "source"))
    return materialize(found.select(F.col("id").alias("doc_id"), F.col("n_words").cast("int").alias("n"), "source", F.col("component_id").alias("cluster"), F.col("doc_id").alias("row")), "sized")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_sized(sized_by_component(_documents(spark, sf_dir)))
    return packed.select("doc_id", "part", "begin", "n_words", "bin_id", "position", "bin_words")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    where = lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), F.array_join(F.transform("offending", where), ",").alias("offending"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.join(_documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(fill_middle.store(_documents(spark, sf_dir)), texts=False)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_topk, op3_line_dedup, op4_warc, op5_lm_score, op6_quality_rules, op7_jaccard_join, op8_packing, op9_quality_classifier, op10_toxicity, op11_collocations, op12_simhash_join, op13_fill_in_middle)}
#: SQL of the queries that SQL can express. The others hold a tokenizer, a trained model, an alignment or a packing, and are
#: tested against brute force.
ORACLES: dict[str, str] = {
    "op2_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op4_warc": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages), h AS (SELECT page_id, url, strlen(body)::BIGINT AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, url, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM h""",
    "op7_jaccard_join": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM t, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) u(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op11_collocations": r"""WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT doc_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT doc_id, lang, k AS words, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM w, unnest([1, 2, 3, 4]) a(k), unnest(range(1, len(w) - k + 2)) b(i)),
f AS (SELECT lang, words, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT c.lang, c.phrase, c.words, c.f AS a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f::HUGEINT + r.f))::BIGINT AS score
FROM f c, unnest(range(1, c.words)) u(k) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), 1, k), ' ')
JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), k + 1, c.words), ' ') WHERE c.words > 1),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT c.lang, c.phrase FROM s c JOIN s o ON o.lang = c.lang AND o.words > c.words AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100::HUGEINT * o.a >= 80::HUGEINT * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s ANTI JOIN d USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op13_fill_in_middle": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, x, u, len(u)::BIGINT AS n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS h FROM t),
d AS (SELECT doc_id, x, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT doc_id, x, n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
}
