"""Embedding, search, ranking, triage, prompts and checks of answers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources.shared import materialize
from .quality import has_value

DIMENSIONS = 384
#: What a rank score adds, and the least score and length of evidence.
SAME_DOCUMENT, PER_LEVEL, MOST_LEVELS, OVERLAP, LENGTH, LENGTH_CHARS = 0.07, 0.01, 0.05, 0.2, 0.1, 800.0
LEAST_SCORE, LEAST_CHARS = 0.15, 20
#: How an echo of the prompt begins, and what a grounded prompt ends with.
SYSTEM_START = "you are a precise assistant"
CLOSING = "Answer in at most four sentences and cite sources using [chunk_id]."


def bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """md5 of the token as a number, modulo ``dimensions``; by halves, for 64-bit arithmetic."""
    half = lambda a: F.conv(F.substr(F.md5(token), F.lit(a), F.lit(8)), 16, 10).cast("long")
    out = F.lit(0).cast("long")
    for a in (1, 9, 17, 25):
        out = (out * ((1 << 32) % dimensions) + half(a)) % dimensions
    return out.cast("int")


def sparse_vectors(texts: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """key, buckets array<int>, weights array<double>: sparse unit vectors of the texts that have a word. Words, as ``bucket`` has them, are
    counted where the text lies, without a shuffle; of a batch each distinct word is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).flatten().dictionary_encode()
            known = np.array([int(hashlib.md5(w.encode()).hexdigest(), 16) % dimensions for w in words.dictionary.to_pylist()], np.int64)
            sizes = np.array(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            cells = np.repeat(np.arange(batch.num_rows), sizes) * dimensions + (known[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64))
            cells, n = np.unique(cells, return_counts=True)
            rows = cells // dimensions
            norms = np.sqrt(np.bincount(rows, n.astype(np.float64) ** 2, minlength=batch.num_rows))
            edges = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=batch.num_rows)))).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in ((cells % dimensions).astype(np.int32), n / norms[rows]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "buckets", "weights"])

    rows = texts.select(key, F.coalesce(tx.tokens(F.lower(F.col(text))), F.array().cast("array<string>")).alias("w")).where(F.size("w") > 0)
    schema = T.StructType([texts.select(key).schema[0], T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def embed(texts: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Sparse unit vectors: key, bucket, weight. Words are hashed into buckets and counted."""
    rows = sparse_vectors(texts, key, text, dimensions).select(key, F.explode(F.arrays_zip("buckets", "weights")).alias("x"))
    return rows.select(key, F.col("x.buckets").alias("bucket"), F.col("x.weights").alias("weight"))


def embed_with(texts: DataFrame, key: str, model, text: str = "text") -> DataFrame:
    """Sparse unit vectors of another embedding: ``model`` is a pandas UDF from text to array<float>."""
    parts = texts.select(key, F.posexplode(model(F.col(text))).alias("bucket", "w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w").cast("double") * F.col("w")).over(Window.partitionBy(key)))
    return parts.select(key, "bucket", (F.col("w") / norm).alias("weight"))


def dense(sparse: DataFrame, key: str, dimensions: int = DIMENSIONS, kind: str = "float") -> DataFrame:
    """key, embedding array<float>, or of another ``kind``."""
    maps = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return maps.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast(kind)).alias("embedding"))


def top_by_words(queries: DataFrame, rows: DataFrame, k: int, query_key: str = "query_id", key: str = "chunk_id", scope: str | None = None) -> DataFrame:
    """For each query the k rows of highest inner product: query, key, score, rank, of those that share a word with it; with
    ``scope`` only rows of the query's own value in that column. queries and rows: a row for each bucket, with q_weight or weight."""
    scoped = [scope] if scope else []
    listed = lambda df, name, weight: df.groupBy(name, *scoped).agg(F.collect_list("bucket").alias("buckets"), F.collect_list(F.col(weight).cast("double")).alias("weights"))
    return sparse_top_k(listed(queries, query_key, "q_weight"), listed(rows, key, "weight"), k, query_key, key, scope)


def vector_top_k(query: list[float], vectors: DataFrame, k: int) -> DataFrame:
    """The k rows of highest inner product with one query vector: vec_id, score; ties to the smaller id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


#: Queries and vectors of a block, and queries whose scores are held at once.
QUERY_BLOCK, VECTOR_BLOCK, QUERY_SLICE = 16384, 8192, 256


def _best_by_blocks(queries: DataFrame, vectors: DataFrame, k: int, scope: str | None, least: float | None, scores, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """For each query (query_id, ...) the k vectors (vec_id, ...) of highest score: query_id, vec_id, score, rank; scores are rounded to nine
    places, those below ``least`` are left out, ties go to the smaller id. ``scores``: of two tables an array for each query, in order.

    A task holds one block of queries and one of vectors of one scope and keeps k rows a query, which are merged after. Vectors are
    copied once for each block of queries of their scope, queries for each block of vectors; vectors of scopes that no query asks for
    are left out before. ``counted``: tables to count instead of queries and vectors, where these take work to make; they may hold more rows.
    """
    scope = scope or "_all"
    of_queries, of_vectors = counted or (queries, vectors)
    blocks = lambda df, most, into: df.groupBy(scope).agg(F.ceil(F.count("*") / most).alias(into))
    sizes = materialize(blocks(of_queries, QUERY_BLOCK, "n_q").join(blocks(of_vectors, VECTOR_BLOCK, "n_v"), scope), "scopes")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = queries.join(sizes, scope).select(*queries.columns, F.pmod(F.xxhash64("query_id"), "n_q").alias("qb"), copies("n_v").alias("vb"))
    held = vectors.join(sizes, scope).select(*vectors.columns, F.pmod(F.xxhash64("vec_id"), "n_v").alias("vb"), copies("n_q").alias("qb"))
    floor = -np.inf if least is None else least
    id_types = queries.schema["query_id"].dataType, vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("query_id", id_types[0]), T.StructField("vec_id", id_types[1]), T.StructField("score", T.DoubleType())])

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if q.num_rows and v.num_rows:
            v = v.sort_by("vec_id")
            ids, asked_ids = v["vec_id"].to_pylist(), q["query_id"].to_pylist()
            for asked_id, row in zip(asked_ids, scores(q, v), strict=True):
                row = np.round(row, 9)
                low = max(floor, np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf)
                best = np.flatnonzero(row >= low)
                found.extend((asked_id, ids[b], float(row[b])) for b in best[np.argsort(-row[best], kind="stable")][:k])
        columns = list(zip(*found, strict=True)) or [[]] * 3
        kinds = (q["query_id"].type, v["vec_id"].type, pa.float64())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    hits = asked.groupBy(scope, "qb", "vb").cogroup(held.groupBy(scope, "qb", "vb")).applyInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and the sizes of the lists."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False), np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)


def _sparse_scores(q: pa.Table, v: pa.Table) -> Iterator[np.ndarray]:
    """Inner products with all vectors of a block by postings: the work of a query is the number of non-zeros in the buckets that it has."""
    buckets, sizes = _lists(v["buckets"])
    weights, _ = _lists(v["weights"])
    order = np.argsort(buckets, kind="stable")
    rows, weights = np.repeat(np.arange(v.num_rows), sizes)[order], weights[order]
    known, starts, counts = np.unique(buckets[order], return_index=True, return_counts=True)
    asked, n = _lists(q["buckets"])
    own, _ = _lists(q["weights"])
    edges = np.concatenate(([0], np.cumsum(n)))
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        at = np.minimum(np.searchsorted(known, asked[a:b]), len(known) - 1)
        hit = known[at] == asked[a:b]
        at, w = at[hit], own[a:b][hit]
        long = counts[at]
        place = np.repeat(starts[at] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        yield np.bincount(rows[place], np.repeat(w, long) * weights[place], minlength=v.num_rows)


def sparse_top_k(queries: DataFrame, rows: DataFrame, k: int, query_key: str = "query_id", key: str = "chunk_id", scope: str | None = None, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """For each query the k rows of highest inner product, of those that share a bucket with it: query, key, score, rank. queries and rows:
    key, buckets and weights, as ``sparse_vectors`` gives them, and ``scope``, if a query meets only rows of its own value there.
    ``counted``: tables with the scopes of queries and rows, to be counted instead of them."""
    place = F.lit(0) if scope is None else F.col(scope)
    own = lambda df, name, into: df.where("size(buckets) > 0").select(F.col(name).alias(into), place.alias(scope or "_all"), F.col("buckets").alias("buckets"), F.col("weights").alias("weights"))
    found = _best_by_blocks(own(queries, query_key, "query_id"), own(rows, key, "vec_id"), k, scope, 1e-9, _sparse_scores, counted)
    return found.select(F.col("query_id").alias(query_key), F.col("vec_id").alias(key), "score", "rank")


def _dense_scores(q: pa.Table, v: pa.Table) -> Iterator[np.ndarray]:
    matrix = lambda t: _lists(t["embedding"])[0].astype(np.float64).reshape(t.num_rows, -1)
    mine, theirs = matrix(q), matrix(v)
    for start in range(0, len(mine), QUERY_SLICE):
        yield from mine[start : start + QUERY_SLICE] @ theirs.T


def vector_top_k_batch(queries: DataFrame, vectors: DataFrame, k: int, scope: str | None = None, least: float | None = None) -> DataFrame:
    """For each query (query_id, embedding) the k rows of highest inner product: query_id, vec_id, score, rank; scores are
    rounded to nine places, those below ``least`` are left out, ties go to the smaller id, rows without an embedding take no
    part. With ``scope`` a query meets only the rows that have its value in that column."""
    place = F.lit(0) if scope is None else F.col(scope)
    # Columns get names of their own here, as queries may be rows of the same table.
    own = lambda df, key: df.where("embedding is not null").select(F.col(key).alias(key), place.alias(scope or "_all"), F.col("embedding").alias("embedding"))
    return _best_by_blocks(own(queries, "query_id"), own(vectors, "vec_id"), k, scope, least, _dense_scores)


def rank_score(similarity: Column, same_document: Column, section_path: Column, prompt: Column, text: Column) -> Column:
    depth = F.least(F.size(section_path) * PER_LEVEL, F.lit(MOST_LEVELS))
    overlap = F.least(tx.keyword_overlap(prompt, text) * OVERLAP, F.lit(OVERLAP))
    length = F.least(F.length(text) / LENGTH_CHARS, F.lit(LENGTH))
    return similarity + F.when(same_document, SAME_DOCUMENT).otherwise(0.0) + F.coalesce(depth, F.lit(0.0)) + overlap + length


def evidence(prompts: DataFrame, chunks: DataFrame, k: int = 4, most_candidates: int | None = None) -> DataFrame:
    """Evidence of each prompt: prompt_id, chunk_id, doc_id, text, section_path, order, score, rank_score, rank.

    prompts: prompt_id, prompt, doc_id (or null), project_id. A prompt with a doc_id looks at the chunks of that document only,
    another at those of its project. Candidates are chunks of 20 characters at least, one per text hash, the first by (doc_id,
    order); the 3k most similar of each prompt are scored, the k best of those above the least score stay.
    ``most_candidates``: only so many chunks of the document or project, the first by (doc_id, order); None: all.
    """
    scope_of = lambda doc, project: F.when(doc.isNotNull(), F.concat(F.lit("d"), doc.cast("string"))).otherwise(F.concat(F.lit("p"), project.cast("string")))
    scoped = prompts.select("prompt_id", "prompt", F.col("doc_id").alias("_doc"), scope_of(F.col("doc_id"), F.col("project_id")).alias("scope"))
    both = F.array(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("p"), F.col("project_id").cast("string")))
    strip = F.regexp_replace("text", r"(?U)^\s+|\s+\z", "")
    placed = chunks.withColumn("text", strip).select("chunk_id", "doc_id", "order", "text", "text_hash", "section_path", F.explode(both).alias("scope"))
    placed = placed.join(scoped.select("scope").distinct(), "scope", "left_semi")
    if most_candidates is not None:
        oldest = Window.partitionBy("scope").orderBy("doc_id", "order")
        placed = placed.withColumn("_n", F.row_number().over(oldest)).where(F.col("_n") <= most_candidates).drop("_n")
    same_text = Window.partitionBy("scope", "text_hash").orderBy("doc_id", "order")
    once = placed.where(F.length("text") >= LEAST_CHARS).withColumn("_n", F.row_number().over(same_text)).where("_n = 1 or text_hash is null").drop("_n")
    once = materialize(once, "candidates")
    # Keys take the scope along, so that vectors need no join to learn it.
    scoped_vectors = lambda df, key, text: sparse_vectors(df.select(F.struct(key, "scope").alias("_k"), text), "_k", text).select(f"_k.{key}", "_k.scope", "buckets", "weights")
    near = sparse_top_k(scoped_vectors(scoped, "prompt_id", "prompt"), scoped_vectors(once, "chunk_id", "text"), 3 * k, "prompt_id", scope="scope", counted=(scoped, once)).withColumnRenamed("score", "similarity").drop("rank")
    full = near.join(scoped, "prompt_id").join(once, ["chunk_id", "scope"])
    scored = full.withColumn("rank_score", rank_score(F.col("similarity"), F.coalesce(F.col("doc_id") == F.col("_doc"), F.lit(False)), F.col("section_path"), F.col("prompt"), F.col("text"))).where(F.col("rank_score") >= LEAST_SCORE)
    best = Window.partitionBy("prompt_id").orderBy(F.desc(F.round("rank_score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("prompt_id", "chunk_id", "doc_id", "text", "section_path", "order", F.col("similarity").alias("score"), "rank_score", "rank")


def manual_evidence(prompts: DataFrame) -> DataFrame:
    """Texts that the caller gave, as evidence rows with score 1. prompts: prompt_id, texts array<string>."""
    rows = prompts.select("prompt_id", F.posexplode("texts").alias("i", "text"))
    return rows.select("prompt_id", F.concat(F.lit("manual-"), F.col("i").cast("string")).alias("chunk_id"), "text", F.col("i").alias("order"), F.lit(1.0).alias("score"), F.lit(1.0).alias("rank_score"), (F.col("i") + 1).alias("rank"))


def grounded_prompt(questions: DataFrame, found: DataFrame) -> DataFrame:
    """prompt_id, grounded_prompt, citations; without evidence the question itself."""
    path = F.when(F.coalesce(F.size("section_path"), F.lit(0)) > 0, F.array_join("section_path", " / ")).otherwise("Context")
    bullet = F.concat(F.lit("- ["), F.col("chunk_id").cast("string"), F.lit("] "), path, F.lit("\n  "), F.coalesce("text", F.lit("")))
    cite = F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.left(F.coalesce("text", F.lit("")), F.lit(500)).alias("excerpt"), bullet.alias("bullet"))
    grouped = found.groupBy("prompt_id").agg(F.array_sort(F.collect_list(cite)).alias("c"))
    context = F.array_join(F.transform("c", lambda x: x["bullet"]), "\n")
    grounded = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), F.col("prompt"), F.lit("\n\n" + CLOSING))
    joined = questions.join(grouped, "prompt_id", "left")
    cited = F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["excerpt"].alias("excerpt")))
    return joined.select("prompt_id", F.when(F.col("c").isNull(), F.col("prompt")).otherwise(grounded).alias("grounded_prompt"), F.coalesce(cited, F.array().cast("array<struct<chunk_id:string,excerpt:string>>")).alias("citations"))


def cites(answer: Column, ids: Column) -> Column:
    """Whether the answer names one of the ids in brackets; without ids it does."""
    return (F.size(ids) <= 0) | F.exists(ids, lambda c: F.contains(answer, F.concat(F.lit("["), c, F.lit("]"))))


def echoes(answer: Column) -> Column:
    plain = F.lower(F.regexp_replace(answer, r"(?U)^\s+|\s+\z", ""))
    return F.coalesce((answer != "") & (F.startswith(plain, F.lit(SYSTEM_START)) | F.contains(plain, F.lit("context:\n-"))), F.lit(False))


def outcome(answer: Column, retry: Column, ids: Column) -> Column:
    """Struct (answer, reason, needs_grounding): accepted answers have reason ok; an echo or an answer without a citation
    gives way to a retry that is neither, else to a fallback."""
    echo, grounded = echoes(answer), cites(answer, ids)
    retried = retry.isNotNull() & ~echoes(retry) & cites(retry, ids)
    fine = ~echo & grounded
    reason = F.when(echo, "prompt_echo").when(F.size(ids) <= 0, "no_evidence").when(fine, "ok").when(retried, "retry_success").otherwise("fallback")
    text = F.when(fine, answer).when(retried, retry)
    return F.struct(text.alias("answer"), reason.alias("reason"), (~fine & ~retried).alias("needs_grounding"))


def triage_reasons(required: Column) -> Column:
    """Why a chunk should be looked at. Columns: text_coverage, ocr_conf_mean, curated, suggestions map<string,string>."""
    conflict = F.exists(F.map_entries("suggestions"), lambda e: F.map_contains_key(F.col("curated"), e["key"]) & ~e["value"].eqNullSafe(F.try_element_at("curated", e["key"])))
    return F.array_compact(
        F.array(
            F.when(F.col("text_coverage") < 0.5, F.lit("low_text_coverage")),
            F.when(F.col("ocr_conf_mean") < 0.5, F.lit("low_ocr_conf")),
            F.when(F.exists(required, lambda f: ~has_value(F.col("curated"), f)), F.lit("missing_required_fields")),
            F.when(F.coalesce(conflict, F.lit(False)), F.lit("suggestion_conflicts")),
        )
    )


def triage_queue(chunks: DataFrame, required: Column, limit: int) -> DataFrame:
    """Of the oldest 5 x limit chunks the first ``limit`` that have reasons."""
    oldest = chunks.orderBy("created_at", "chunk_id").limit(limit * 5)
    return oldest.withColumn("reasons", triage_reasons(required)).where(F.size("reasons") > 0).orderBy("created_at", "chunk_id").limit(limit)


def keep_suggestions(chunks: DataFrame, most: int) -> DataFrame:
    """Keeps the first ``most`` suggestions of every document, by chunk and then by place in the map."""
    one = chunks.select("doc_id", "chunk_id", "order", F.posexplode(F.map_entries("suggestions")).alias("i", "e"))
    w = Window.partitionBy("doc_id").orderBy("order", "chunk_id", "i")
    kept = one.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("chunk_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"])).alias("_kept"))
    return chunks.join(kept, "chunk_id", "left").withColumn("suggestions", F.coalesce("_kept", F.map_filter("suggestions", lambda k, v: F.lit(False)))).drop("_kept")
