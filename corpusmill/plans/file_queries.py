"""Queries that write files of the library's formats and read them again, and those of the parts that users bring along."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import signatures as sg
from ..functions import text as tx
from ..operators import curation, quality, releases, retrieval
from ..sources import archives
from ..sources import chunks as files
from ..sources.shared import new_folder, table
from .registry import CHUNKS, chunks_of, query
from .text_queries import _LINES, EMAIL, ID, PHONE, _records, _step_lines


@query(CHUNKS + """SELECT chunk_id, ord::INTEGER AS "order", text, lang FROM chunks WHERE doc_id % 2 = 0""")
def a1_chunk_scan(s, d):
    path = new_folder(s, "chunk-files")
    _records(s, d).withColumns({"rev": F.lit(1), "text_hash": F.lit("h")}).write.json(path)
    wanted = table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return files.read_chunks(s, path).join(wanted, "doc_id", "left_semi").select("chunk_id", "order", "content.text", F.try_element_at("metadata", F.lit("lang")).alias("lang"))


@query(CHUNKS + f"SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN (len(regexp_extract_all(text, '{EMAIL}')) + len(regexp_extract_all(text, '{PHONE}')) + len(regexp_extract_all(text, '{ID}')))::INTEGER ELSE 0 END AS n FROM chunks")
def a2_redactions_scan(s, d):
    c, path = chunks_of(s, d), new_folder(s, "redaction-files")
    c.where("doc_id % 2 = 0").select("chunk_id", pii.detect(F.col("text")).alias("redactions")).write.json(path)
    return files.with_redactions(c, files.read_redactions(s, path)).select("chunk_id", F.size("redactions").alias("n"))


@query(CHUNKS + "SELECT chunk_id, text, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM chunks")
def a12_bundle(s, d):
    path = new_folder(s, "bundle")
    files.write_bundle(chunks_of(s, d).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test")), {"chunk_id": "chunk_id", "text": "text"}, path)
    return s.read.parquet(path).select("chunk_id", "text", F.col("split").cast("string").alias("split"))


@query(CHUNKS + "SELECT to_json({'prompt': text, 'completion': ''})::VARCHAR AS value FROM chunks WHERE lang = 'en'")
def a13_export_reuse(s, d):
    """The second export has the settings of the first and so leaves its files, whatever rows it is given."""
    r, folder, settings = _records(s, d), new_folder(s, "exports"), {"project": 1, "preset": "sft"}
    first = files.export(r, files.fields_of("sft"), folder, settings, ["metadata['lang'] = 'en'"])
    again = files.export(r.limit(0), files.fields_of("sft"), folder, settings, ["metadata['lang'] = 'en'"])
    return s.read.text(f"{first}/data").where(F.lit(first == again))


@query(CHUNKS + """SELECT doc_id::VARCHAR AS doc_id, chunk_id, ord::VARCHAR AS "order", to_json({'type': 'text', 'text': text})::VARCHAR AS content, to_json({'lang': lang})::VARCHAR AS metadata FROM chunks""")
def a16_snapshot_csv(s, d):
    path = new_folder(s, "snapshot")
    files.write_snapshot_csv(_records(s, d), path)
    return s.read.csv(path, header=True, schema="doc_id string, chunk_id string, `order` string, content string, metadata string")


@query(CHUNKS + "SELECT text AS prompt, '' AS completion FROM chunks")
def b3_preset_before_template(s, d):
    return files.sorted_fields(_records(s, d), files.fields_of("sft", {"other": "content.text"}))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(text) WHEN 1 THEN '```' || trim(text) || '```  ' ELSE trim(text) || ' ```' END AS text FROM documents""")
def b4_sanitized(s, d):
    bare = F.trim("text")
    framed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n \t"), bare, F.lit(" \n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```"), bare, F.lit("```  "))).otherwise(F.concat(F.lit(" "), bare, F.lit(" ```\n")))
    return table(s, d, "documents").select("doc_id", files.sanitize(framed).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE NULL END AS found FROM customer")
def b5_first_location(s, d):
    none = F.create_map().cast("map<string,string>")
    own = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("f"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))).otherwise(none)
    other = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("f"), F.col("c_mktsegment"), F.lit("g"), F.lit("x"))).otherwise(F.create_map(F.lit("g"), F.lit("y")))
    return table(s, d, "customer").select("c_custkey", releases.first_location("f", own, other).alias("found"))


@query("SELECT row_number() OVER (ORDER BY 'k' || page_id // 40 || '.zip', 'p' || lpad(page_id::VARCHAR, 9, '0') || '.html') - 1 AS page_id, 'p' || lpad(page_id::VARCHAR, 9, '0') || '.html' AS url, md5(coalesce(html, '')) AS digest, (SELECT count(*) FROM pages) AS members FROM pages")
def a3_html_archives(s, d):
    """Pages written as archives of forty, and read by the archives' indexes."""
    folder = new_folder(s, "archives")
    name = F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".html"))
    pages = table(s, d, "pages").select(F.concat(F.lit("k"), F.floor(F.col("page_id") / 40).cast("string")).alias("archive"), name.alias("url"), "html")
    members = archives.write_archives(pages, folder).agg(F.sum("members").alias("n")).first()["n"]
    found, _ = archives.read_html(s, folder)
    return found.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"), F.lit(members).cast("long").alias("members"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS words, length(text)::INTEGER AS own FROM documents")
def c6_token_lengths(s, d):
    return table(s, d, "documents").select("doc_id", tx.token_length(F.col("text")).alias("words"), tx.token_length(F.col("text"), F.length).alias("own"))


@query(CHUNKS + r""", m AS (SELECT doc_id, ord, list_transform(range(64), lambda i: list_min(list_transform(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), lambda t: sha1(t || '-' || i)))) AS a FROM chunks)
SELECT doc_id, ord, CASE WHEN b IS NULL THEN 0.0 ELSE len(list_filter(range(1, 65), lambda i: a[i] = b[i])) / 64.0 END::DOUBLE AS similarity FROM (SELECT *, lag(a) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM m)""")
def f3_signature_jaccard(s, d):
    m = sg.with_minhash(chunks_of(s, d).select("doc_id", F.col("order").cast("long").alias("ord"), "text"), "text", "a")
    before = F.lag("a").over(Window.partitionBy("doc_id").orderBy("ord"))
    return m.withColumn("b", before).select("doc_id", "ord", sg.signature_jaccard(F.col("a"), F.coalesce("b", F.array().cast("array<string>"))).cast("double").alias("similarity"))


@query(CHUNKS + "SELECT chunk_id, text FROM chunks WHERE doc_id % 5 = 0")
def g8_existing_chunks(s, d):
    c = chunks_of(s, d)
    return curation.select_chunks(c, ids=c.where("doc_id % 5 = 0").select("chunk_id")).select("chunk_id", "text")


@query("SELECT o_orderstatus AS release, count(*) AS total, sum(CASE WHEN o_orderkey % CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END <> 0 THEN 1 ELSE 0 END)::BIGINT AS correct FROM orders GROUP BY 1")
def h12_eval_history(s, d):
    """Results of all releases, then those of one again, which replace its own."""
    path = new_folder(s, "history")

    def results(n: int):
        o = table(s, d, "orders").select(F.col("o_orderstatus").alias("release"), F.lit("x").alias("expected"), F.when(F.col("o_orderkey") % n == 0, "?").otherwise("x").alias("answer"))
        return quality.accuracy(o, "release")

    quality.keep_results(results(3), path)
    quality.keep_results(results(2).where("release = 'F'"), path)
    history = s.read.parquet(path)
    return quality.evaluated_releases(history).join(history, "release").select(F.col("release").cast("string").alias("release"), "total", "correct")


@query("""WITH v AS (SELECT item_id, [length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 't', '')), 1] AS v FROM benchmark)
SELECT item_id, i::INTEGER AS bucket, round(v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS weight FROM v, unnest([0, 1, 2]) u(i) WHERE v[i + 1] <> 0""")
def m3_other_embedding(s, d):
    @F.pandas_udf("array<float>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(t.count("e")), float(t.count("t")), 1.0])

    return retrieval.embed_with(table(s, d, "benchmark"), "item_id", letters).select("item_id", "bucket", F.round("weight", 6).alias("weight"))


@query("SELECT o_orderstatus AS status, count(*) AS total, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS correct FROM orders GROUP BY 1")
def m4_model_answers(s, d):
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("status"), F.lower("o_orderpriority").alias("prompt"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("none").alias("expected"))
    return quality.accuracy(quality.answered(o, F.upper), "status").select("status", "total", "correct")


@query(rf"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE (regexp_matches(t, '\b(?:DEBUG|INFO|WARN|ERROR|FATAL)\b')::INTEGER + 3)::INTEGER END AS n FROM (SELECT * FROM ({_LINES}))""")
def m6_suggestions_off(s, d):
    x = _step_lines(s, d)
    n = F.when(F.col("l_linenumber") % 2 == 0, F.size(pii.suggest(F.col("t"), use_rules=False))).otherwise(F.size(pii.suggest(F.col("t"))))
    return x.select("l_orderkey", "l_linenumber", n.alias("n"))
