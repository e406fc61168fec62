"""Queries of sources, text functions, personal data and chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import signatures as sg
from ..functions import text as tx
from ..operators import chunking, html, ingest, langid, ngram_language
from ..sources import chunks as files
from ..sources.shared import table
from .registry import CHUNKS, chunks_of, query

#: Chapters of the pages' bodies in SQL: the pages are regular enough for it.
BLOCKS = r"""WITH body AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '<body[^>]*>(.*)$', 1, 's'), '<!--.*?-->', '', 'gs'), '<nav>.*?</nav>|<footer>.*?</footer>', '<x>', 'gs') AS b FROM pages),
tok AS (SELECT page_id, url, unnest(regexp_extract_all(b, '<[^>]*>|[^<]+')) AS t, generate_subscripts(regexp_extract_all(b, '<[^>]*>|[^<]+'), 1) AS i FROM body),
node AS (SELECT *, lag(t) OVER (PARTITION BY page_id ORDER BY i) AS prior, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g') AS s FROM tok),
raw AS (SELECT page_id, url, i, prior = '<h1>' AS title, CASE WHEN prior = '<h1>' THEN trim(regexp_replace(s, '\s+', ' ', 'g')) ELSE regexp_replace(s, '^\s+|\s+$', '', 'g') END AS text FROM node WHERE t NOT LIKE '<%'),
blocks AS (SELECT page_id, url, (row_number() OVER w - 1)::INTEGER AS block_no, CASE WHEN title THEN 'title' END AS kind, text, coalesce(last_value(CASE WHEN title THEN text END IGNORE NULLS) OVER w, '') AS section, count(*) FILTER (WHERE title) OVER w AS island FROM raw WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


def _packed(most: int) -> str:
    """Blocks of an island taken until they have ``most`` tokens: parts (page_id, island, part, section, text)."""
    return BLOCKS.replace("WITH body", "WITH RECURSIVE body", 1) + rf""", item AS (SELECT *, row_number() OVER (PARTITION BY page_id, island ORDER BY block_no) AS r, len({TOKENS.format('text')}) AS n FROM blocks),
walk AS (SELECT page_id, island, r, 0 AS part, n AS held FROM item WHERE r = 1 UNION ALL SELECT i.page_id, i.island, i.r, CASE WHEN w.held >= {most} THEN w.part + 1 ELSE w.part END, CASE WHEN w.held >= {most} THEN i.n ELSE w.held + i.n END FROM walk w JOIN item i ON i.page_id = w.page_id AND i.island = w.island AND i.r = w.r + 1),
parts AS (SELECT page_id, island, part, min(section) AS section, regexp_replace(string_agg(text, chr(10) ORDER BY r), '^\s+|\s+$', '', 'g') AS text FROM walk JOIN item USING (page_id, island, r) GROUP BY 1, 2, 3)
"""


def name_id(name: str) -> str:
    h = f"sha1(unhex('{tx.URL_NAMESPACE}') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1)::BIGINT, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def language(text: str) -> str:
    """The language most of whose frequent words a text holds."""
    words = TOKENS.format(rf"lower(regexp_replace({text}, '[^\p{{L}}]+', ' ', 'g'))")
    score = {k: f"len(list_filter({words}, lambda x: x IN ({', '.join(repr(w) for w in langid.STOP_WORDS[k])})))" for k in sorted(langid.STOP_WORDS)}
    return f"(SELECT CASE WHEN m = 0 THEN NULL {' '.join(f'WHEN {k}_ = m THEN {k!r}' for k in score)} END FROM (SELECT *, greatest({', '.join(f'{k}_' for k in score)}) AS m FROM (SELECT {', '.join(f'{x} AS {k}_' for k, x in score.items())})))"


NORMAL = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def a4_page_scan(s, d):
    return table(s, d, "pages").select("page_id", "url", F.length("html").alias("n_chars"))


@query("""WITH i AS (SELECT 1 AS project_id, doc_id, sha256(text) AS doc_hash FROM documents), k AS (SELECT doc_hash, min(doc_id) AS known FROM i WHERE doc_id % 10 = 0 GROUP BY doc_hash),
n AS (SELECT * FROM i WHERE doc_id % 10 <> 0), f AS (SELECT doc_hash, min(doc_id) AS first FROM n GROUP BY doc_hash)
SELECT n.doc_id, n.doc_hash, coalesce(k.known, f.first) AS surviving_doc_id, k.known IS NULL AND n.doc_id = f.first AS is_new FROM n JOIN f USING (doc_hash) LEFT JOIN k USING (doc_hash)""")
def a5_ingest_dedup(s, d):
    rows = table(s, d, "documents").select(F.lit(1).alias("project_id"), "doc_id", ingest.content_key(F.col("text").cast("binary")).alias("doc_hash"), F.col("doc_id").alias("seq"))
    return ingest.ingest(rows.where("doc_id % 10 <> 0"), rows.where("doc_id % 10 = 0").drop("seq")).drop("project_id")


@query("SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, sha256(string_agg(url, '|' ORDER BY url)) AS doc_hash FROM pages GROUP BY 1")
def a6_listing_key(s, d):
    p = table(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.col("url").alias("name"))
    return ingest.listing_key(p, "host")


@query("""SELECT page_id, CASE WHEN starts_with(lower(html), '%pdf') THEN 'application/pdf' WHEN contains(lower(substr(html, 1, 4096)), '<html') OR contains(lower(substr(html, 1, 4096)), '<!doctype html') THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages""")
def a7_mime_sniff(s, d):
    return table(s, d, "pages").select("page_id", ingest.sniff(F.lit("page"), F.col("html").cast("binary")).alias("mime"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE round((doc_id % 3) / (strlen(text) + doc_id % 3), 9) END::DOUBLE AS bad_ratio FROM documents")
def a8_utf8_health(s, d):
    # No, one or two bytes that no UTF-8 text has are put in front of the text.
    bad = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FF"))).when(F.col("doc_id") % 3 == 2, F.unhex(F.lit("FE80"))).otherwise(F.lit("").cast("binary"))
    return table(s, d, "documents").select("doc_id", F.round(ingest.non_utf8_ratio(F.concat(bad, F.col("text").cast("binary"))), 9).alias("bad_ratio"))


def _records(s, d):
    c = chunks_of(s, d)
    return c.select(F.col("doc_id").cast("string").alias("doc_id"), "chunk_id", "order", F.struct(F.lit("text").alias("type"), "text").alias("content"), F.struct(F.lit(1).alias("page"), F.array("source", "lang").alias("section_path")).alias("source"), F.create_map(F.lit("lang"), "lang").alias("metadata"))


@query(CHUNKS + """SELECT to_json({'context': source || ' / ' || lang || ': ' || text, 'answer': ''})::VARCHAR AS value FROM chunks""")
def a9_b1_rag_lines(s, d):
    return files.json_lines(_records(s, d), files.fields_of("rag"))


@query(CHUNKS + "SELECT text AS prompt, '' AS completion FROM chunks")
def a11_b1_sft_rows(s, d):
    return files.sorted_fields(_records(s, d), files.fields_of("sft"))


@query(CHUNKS + "SELECT '1' AS page, text, source || ' / ' || lang AS section FROM chunks")
def a10_b2_template_rows(s, d):
    return files.sorted_fields(_records(s, d), files.fields_of(template={"text": "content.text", "section": "array_join(source.section_path, ' / ')", "page": "source.page"}))


@query(CHUNKS + "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(DISTINCT lang) AS n_tables FROM chunks")
def a14_export_manifest(s, d):
    r = _records(s, d).withColumn("content", F.struct(F.lit("table_text").alias("type"), F.col("content.text").alias("text"))).withColumn("metadata", F.create_map(F.lit("table_id"), F.try_element_at("metadata", F.lit("lang"))))
    return files.manifest(r)


@query(CHUNKS + "SELECT doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS files, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs_used, count(DISTINCT ord + 1) AS n_pages FROM chunks GROUP BY doc_id")
def a19_document_manifest(s, d):
    c = chunks_of(s, d).select("doc_id", "order", F.col("source").alias("file_path"), (F.col("order") + 1).alias("page"), F.lit(None).cast("string").alias("source_stage"), "lang")
    m = files.document_manifest(c)
    return m.select("doc_id", F.array_join("files", ",").alias("files"), F.array_join("langs_used", ",").alias("langs_used"), F.size("page_langs").cast("long").alias("n_pages"))


@query(f"SELECT doc_id, {NORMAL} AS normal FROM documents")
def c1_hash_form(s, d):
    return table(s, d, "documents").select("doc_id", tx.hash_form(F.col("text")).alias("normal"))


NFC = r"trim(regexp_replace(regexp_replace(nfc_normalize(replace(replace(replace({0}, chr(173), ''), chr(64257), 'fi'), chr(64258), 'fl')), '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {NFC.format('text')} AS normal FROM documents")
def c2_nfc_form(s, d):
    return table(s, d, "documents").select("doc_id", tx.nfc_form(F.col("text")).alias("normal"))


# SQL has NFC only; the texts hold no character that NFKC changes further, which the comparison itself would show.
@query(r"""WITH f AS (SELECT doc_id, nfc_normalize(regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) || chr(7) || 'e' || chr(769) || chr(13) || chr(9) ELSE '' END, '\r\n?', chr(10), 'g')) AS t FROM documents), c AS (SELECT doc_id, t, regexp_replace(t, '[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}]', '', 'g') AS text FROM f)
SELECT doc_id, text, (length(t) - length(text))::INTEGER AS removed FROM c""")
def c3_parse_form(s, d):
    odd = F.when(F.col("doc_id") % 2 == 0, F.lit("\r\n\x07é\r\t")).otherwise("")
    return table(s, d, "documents").select("doc_id", tx.parse_form(F.concat("text", odd)).alias("x")).select("doc_id", "x.text", "x.removed")


@query(r"""SELECT doc_id, round(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text), 9) AS ascii_ratio, round(length(regexp_replace(text, '[^\x{80}-\x{FF}]', '', 'g')) / length(text), 9) AS latin1_ratio,
round(length(regexp_replace(text, '[\x00-\x{FF}]', '', 'g')) / length(text), 9) AS other_ratio FROM documents""")
def c4_char_coverage(s, d):
    c = table(s, d, "documents").select("doc_id", tx.char_coverage(F.col("text")).alias("x"))
    return c.select("doc_id", *(F.round(F.col(f"x.{k}"), 9).alias(k) for k in ("ascii_ratio", "latin1_ratio", "other_ratio")))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_tokens FROM documents")
def c5_token_count(s, d):
    return table(s, d, "documents").select("doc_id", tx.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query(CHUNKS + "SELECT doc_id, ord, text FROM chunks")
def c7_token_windows(s, d):
    return chunks_of(s, d).select("doc_id", F.col("order").cast("long").alias("ord"), "text")


@query(f"SELECT doc_id, sha256(text) AS raw_hash, sha256(source || '/' || lang || text) AS stable_key, sha256(CASE WHEN text = '' THEN 'text' ELSE {NORMAL} END) AS text_hash FROM documents")
def c8_c10_hashes(s, d):
    return table(s, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("raw_hash"), tx.stable_key(F.array("source", "lang"), F.col("text")).alias("stable_key"), tx.text_hash(F.lit("text"), F.col("text")).alias("text_hash")
    )


@query(f"SELECT page_id, {name_id('url')} AS id FROM pages")
def c11_name_ids(s, d):
    return table(s, d, "pages").select("page_id", tx.name_id(F.col("url")).alias("id"))


@query(f"SELECT doc_id, {language('text')} AS detected FROM documents")
def c12_languages(s, d):
    return table(s, d, "documents").select("doc_id", langid.detect(F.col("text")).alias("detected"))


#: Trigram profiles of documents that aren't held out, in SQL.
PROFILES = r"""WITH t AS (SELECT doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) AS x FROM documents),
g AS (SELECT doc_id, lang, substr(' ' || x || ' ', i, 3) AS gram FROM t, unnest(range(1, length(x) + 1)) u(i) WHERE x <> ''),
c AS (SELECT gram, lang, count(*) AS c FROM g WHERE lang IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1, 2),
k AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(c) DESC, gram LIMIT 50000), n AS (SELECT lang, sum(c) AS n FROM c SEMI JOIN k USING (gram) GROUP BY 1),
p AS (SELECT k.gram, n.lang, ln((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (SELECT count(*) FROM k))) AS w FROM k CROSS JOIN n LEFT JOIN c ON c.gram = k.gram AND c.lang = n.lang)
"""
#: Detected languages of ``said`` (id, gram): ``found`` (id, detected).
BEST = """s AS (SELECT id, lang, sum(w) AS s, count(*) AS n FROM said JOIN p USING (gram) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, lang) AS r FROM s),
found AS (SELECT a.id, CASE WHEN a.s - b.s >= 0.1 * a.n THEN a.lang END AS detected FROM r a JOIN r b ON a.id = b.id AND a.r = 1 AND b.r = 2)"""


def _profiles(s, d):
    """Learnt from four fifths of the documents."""
    return ngram_language.fit(table(s, d, "documents").where("doc_id % 5 <> 0"))


@query(PROFILES + ", said AS (SELECT doc_id AS id, gram FROM g), " + BEST + " SELECT doc_id, detected, doc_id % 5 = 0 AS held_out FROM documents LEFT JOIN found ON id = doc_id")
def c12_ngram_languages(s, d):
    found = ngram_language.detect(table(s, d, "documents").select("doc_id", "text"), "doc_id", _profiles(s, d))
    return found.select("doc_id", "detected", (F.col("doc_id") % 5 == 0).alias("held_out"))


@query(CHUNKS + ", " + PROFILES.removeprefix("WITH ") + r""", b AS (SELECT doc_id, ord, trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) AS x FROM chunks),
said AS (SELECT doc_id || '-' || ord AS id, substr(' ' || x || ' ', i, 3) AS gram FROM b, unnest(range(1, length(x) + 1)) u(i) WHERE x <> ''), """ + BEST + """
SELECT doc_id, ord, first(detected IGNORE NULLS) OVER (PARTITION BY doc_id, ord // 3 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page_lang FROM chunks LEFT JOIN found ON id = doc_id || '-' || ord""")
def d13_ngram_page_languages(s, d):
    blocks = chunks_of(s, d).select("doc_id", (F.floor(F.col("order") / 3) + 1).alias("page"), F.col("order").alias("block_no"), "text")
    return ngram_language.page_languages(blocks, _profiles(s, d)).select("doc_id", F.col("block_no").cast("long").alias("ord"), "page_lang")


@query("SELECT doc_id, coalesce(CASE lower(l) WHEN 'eng' THEN 'en' WHEN 'spa' THEN 'es' WHEN 'fra' THEN 'fr' WHEN 'deu' THEN 'de' END, left(lower(l), 2)) AS code FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE CASE lang WHEN 'en' THEN 'ENG' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' ELSE 'deu' END END AS l FROM documents)")
def c13_language_codes(s, d):
    three = F.when(F.col("lang") == "en", "ENG").when(F.col("lang") == "es", "spa").when(F.col("lang") == "fr", "fra").otherwise("deu")
    return table(s, d, "documents").select("doc_id", tx.language_code(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(three)).alias("code"))


@query("SELECT source, coalesce(string_agg(DISTINCT CASE WHEN lang NOT IN ('en', 'de') THEN lang END, ',' ORDER BY CASE WHEN lang NOT IN ('en', 'de') THEN lang END), '') AS unknown FROM documents GROUP BY source")
def c14_unknown_languages(s, d):
    used = table(s, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("used"))
    return used.select("source", F.array_join(tx.unknown_languages(F.col("used"), F.array(F.lit("en"), F.lit("de"))), ",").alias("unknown"))


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_tax::VARCHAR AS a, l_quantity::VARCHAR AS q FROM lineitem), p AS (SELECT *, '$' || a || '$' AS m, '```x = ' || q || '```' AS f FROM t)
SELECT l_orderkey, l_linenumber, 'math' AS type, 6 AS start, 6 + length(m) AS stop, m AS text FROM p UNION ALL SELECT l_orderkey, l_linenumber, 'code_fence', 11 + length(m), 11 + length(m) + length(f), f FROM p
UNION ALL SELECT l_orderkey, l_linenumber, 'monospace', 12 + length(m) + length(f), 21 + length(m) + length(f), '    code' || chr(10) FROM p""")
def c15_spans(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("total $"), F.col("l_tax").cast("string"), F.lit("$ and ```x = "), F.col("l_quantity").cast("string"), F.lit("```\n    code\n")).alias("t"))
    spans = li.select("l_orderkey", "l_linenumber", F.explode(tx.detect_spans("t")).alias("x"))
    return spans.select("l_orderkey", "l_linenumber", "x.type", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("stop"), "x.text")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.page') AS VARCHAR), '') AS page FROM events")
def c16_safe_json(s, d):
    m = files.map_of_json(F.col("props"))
    return table(s, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("page")), F.lit("")).alias("page"))


@query("SELECT o_orderkey, greatest(0.0, least(1.0, o_totalprice / 400000.0)) AS x1, greatest(0.0, least(1.0, (o_totalprice - 200000.0) / 400000.0)) AS y0 FROM orders")
def c19_boxes(s, d):
    box = tx.clamp_box({"x0": F.lit(0.0), "y0": F.col("o_totalprice") - 200000.0, "x1": F.col("o_totalprice"), "y1": F.lit(1.0)}, F.lit(400000.0), F.lit(400000.0))
    return table(s, d, "orders").select("o_orderkey", box.alias("b")).select("o_orderkey", "b.x1", "b.y0")


WORDS = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: length(x) >= 3))"


@query(f"SELECT item_id, len({WORDS.format('text')}) AS n_keywords FROM benchmark")
def c20_keywords(s, d):
    return table(s, d, "benchmark").select("item_id", F.size(tx.keywords(F.col("text"))).cast("long").alias("n_keywords"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def c21_clean_numbers(s, d):
    return table(s, d, "events").select("event_id", tx.clean_number(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("value"))


EMAIL, PHONE, ID = (pii.PII[k].removeprefix("(?U)") for k in ("email", "phone", "id"))


@query(CHUNKS + f"SELECT chunk_id, len(regexp_extract_all(text, '{EMAIL}')) AS emails, len(regexp_extract_all(text, '{PHONE}')) AS phones, len(regexp_extract_all(text, '{ID}')) AS ids FROM chunks")
def e1_pii(s, d):
    found = chunks_of(s, d).select("chunk_id", pii.detect(F.col("text")).alias("m"))
    n = lambda k: F.size(F.filter("m", lambda x: x["type"] == k)).cast("long")
    return found.select("chunk_id", n("email").alias("emails"), n("phone").alias("phones"), n("id").alias("ids"))


@query(CHUNKS + f"SELECT doc_id, sum(len(regexp_extract_all(text, '{EMAIL}')) + len(regexp_extract_all(text, '{PHONE}')))::BIGINT AS pii_count FROM chunks GROUP BY doc_id")
def e2_pii_count(s, d):
    return chunks_of(s, d).groupBy("doc_id").agg(F.sum(F.size(pii.detect(F.col("text")))).alias("pii_count"))


@query(CHUNKS + f"""SELECT chunk_id, list_reduce(list_concat([text], regexp_extract_all(text, '{EMAIL}'), regexp_extract_all(text, '{PHONE}')), lambda a, m: replace(a, m, '[REDACTED]')) AS text FROM chunks""")
def e3_b15_redacted(s, d):
    c = chunks_of(s, d).withColumn("redactions", pii.detect(F.col("text")))
    return files.redacted(c).select("chunk_id", "text")


_LINES = "SELECT l_orderkey, l_linenumber, 'Step ' || l_linenumber || ': ' || CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'R' THEN 'WARN' ELSE 'fine' END || ' INC-' || l_partkey || ' on ' || strftime(l_shipdate, '%Y-%m-%d') AS t FROM lineitem"


def _step_lines(s, d):
    level = F.when(F.col("l_returnflag") == "A", "ERROR").when(F.col("l_returnflag") == "R", "WARN").otherwise("fine")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Step "), F.col("l_linenumber").cast("string"), F.lit(": "), level, F.lit(" INC-"), F.col("l_partkey").cast("string"), F.lit(" on "), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("t"))


@query(rf"""SELECT l_orderkey, l_linenumber, nullif(regexp_extract(t, '\b(?:DEBUG|INFO|WARN|ERROR|FATAL)\b'), '') AS severity, nullif(regexp_extract(t, '^Step\s?\d+:'), '') AS step_id,
nullif(regexp_extract(t, '\b(?:JIRA|BUG|INC)-\d+\b'), '') AS ticket_id, nullif(regexp_extract(t, '\b\d{{4}}-\d{{2}}-\d{{2}}'), '') AS datetime FROM ({_LINES})""")
def e4_rule_suggestions(s, d):
    x = _step_lines(s, d).withColumn("m", pii.suggest(F.col("t")))
    return x.select("l_orderkey", "l_linenumber", *(F.try_element_at("m", F.lit(k))["value"].alias(k) for k in pii.RULES))


@query(r"""SELECT doc_id, length(trim(text)) < 400 OR length(regexp_replace(text, '[^\x00-\x{FF}]', '', 'g')) / length(text) < 0.5 AS ocr FROM documents""")
def b13_ocr_needed(s, d):
    from ..operators.quality import ocr_needed

    return table(s, d, "documents").select("doc_id", ocr_needed(400).alias("ocr"))



@query(CHUNKS + r""", bits AS (SELECT chunk_id, b, sum(CASE WHEN (('0x' || right(md5(t), 16))::UBIGINT >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v
FROM (SELECT chunk_id, unnest(regexp_split_to_array(text, ' ')) AS t FROM chunks), (SELECT range::UBIGINT AS b FROM range(64)) GROUP BY chunk_id, b),
sums AS (SELECT chunk_id, sum(CASE WHEN v > 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END)::HUGEINT AS h FROM bits GROUP BY chunk_id)
SELECT chunk_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS simhash FROM sums""")
def f1_simhash(s, d):
    return chunks_of(s, d).select("chunk_id", sg.simhash(F.col("text")).alias("simhash"))


@query(r"""SELECT doc_id, array_to_string(list_transform(range(64), lambda i: coalesce(list_min(list_transform(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), lambda t: sha1(t || '-' || i))), '0')), ',') AS mins FROM documents""")
def f2_minhash(s, d):
    return sg.with_minhash(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.array_join("mins", ",").alias("mins"))


@query(CHUNKS + r"""SELECT doc_id, ord, array_to_string(list_transform(range(64), lambda i: list_min(list_transform(list_distinct(regexp_split_to_array(text, ' ')), lambda t: sha1(t || '-' || i)))), ',') AS mins FROM chunks""")
def f2_chunk_minhash(s, d):
    return sg.with_minhash(chunks_of(s, d).select("doc_id", F.col("order").cast("long").alias("ord"), "text"), "text").select("doc_id", "ord", F.array_join("mins", ",").alias("mins"))


@query(BLOCKS + "SELECT page_id, block_no, kind, 'text' AS type, text, section FROM blocks")
def d1_html_blocks(s, d):
    return html.extract(table(s, d, "pages")).select("page_id", "block_no", "kind", "type", "text", F.array_join("section_path", " / ").alias("section"))


def _order_pages(s, d):
    """A page for each order, made of its lines: heading, paragraph, list, table, second heading and preformatted text."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    orders = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    part = lambda x: x["l_partkey"].cast("string")
    items = F.array_join(F.transform("x", lambda x: F.concat(F.lit("<li>Part "), part(x), F.lit(" &amp; <b>more</b></li>"))), "")
    rows = F.array_join(F.transform("x", lambda x: F.concat(F.lit("<tr><td>"), x["l_linenumber"].cast("string"), F.lit("</td><td> "), part(x), F.lit("\n x</td></tr>"))), "")
    key = F.col("l_orderkey").cast("string")
    body = (F.lit("<html><body><nav>menu</nav><h1>Order "), key, F.lit("</h1><p>Lines &lt;all&gt;</p><ul>"), items, F.lit("</ul><table><tr><th>line</th><th>part</th></tr>"), rows, F.lit("</table><h2>Notes</h2><pre>a  b\n</pre><table><tr><td>"), key, F.lit("</td></tr></table></body></html>"))
    return orders.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("https://orders.example/"), key).alias("url"), F.concat(*body).alias("html"))


@query(r"""WITH n AS (SELECT l_orderkey AS page_id, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS page_id, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS block_no, 'Part ' || l_partkey || ' & more' AS text FROM lineitem)
SELECT page_id, 0 AS block_no, 'title' AS kind, 'text' AS type, 'Order ' || page_id AS text, 'Order ' || page_id AS section FROM n UNION ALL SELECT page_id, 1, NULL, 'text', 'Lines <all>', 'Order ' || page_id FROM n UNION ALL SELECT page_id, block_no, 'step', 'text', text, 'Order ' || page_id FROM s
UNION ALL SELECT page_id, n + 2, NULL, 'table_placeholder', '', 'Order ' || page_id FROM n UNION ALL SELECT page_id, n + 3, 'title', 'text', 'Notes', 'Order ' || page_id || ' / Notes' FROM n UNION ALL SELECT page_id, n + 4, NULL, 'text', 'a  b' || chr(10), 'Order ' || page_id || ' / Notes' FROM n
UNION ALL SELECT page_id, n + 5, NULL, 'table_placeholder', '', 'Order ' || page_id || ' / Notes' FROM n""")
def d2_typed_blocks(s, d):
    return html.extract(_order_pages(s, d), mode="typed").select("page_id", F.col("block_no").cast("long").alias("block_no"), "kind", "type", "text", F.array_join("section_path", " / ").alias("section"))


@query(BLOCKS + "SELECT page_id, block_no, kind, 'text' AS type, text, section FROM blocks")
def d2_typed_pages(s, d):
    return html.extract(table(s, d, "pages"), mode="typed").select("page_id", "block_no", "kind", "type", "text", F.array_join("section_path", " / ").alias("section"))


@query(BLOCKS + r""", p AS (SELECT page_id, url, i, t, s, sum(CASE t WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM node), q AS (SELECT *, count(*) FILTER (WHERE t = '<p>' AND depth = 1) OVER (PARTITION BY page_id ORDER BY i) AS g FROM p),
j AS (SELECT page_id, url, g, trim(regexp_replace(string_agg(s, ' ' ORDER BY i), '\s+', ' ', 'g')) AS text FROM q WHERE depth > 0 AND t NOT LIKE '<%' GROUP BY 1, 2, 3), h AS (SELECT page_id, text AS title FROM raw WHERE title)
SELECT page_id, host, (row_number() OVER (PARTITION BY host ORDER BY page_id, g) - 1)::INTEGER AS "order", text, sha256(title || lower(text)) AS text_hash FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM j JOIN h USING (page_id) WHERE text <> '')""")
def d3_paragraphs(s, d):
    return html.paragraphs(table(s, d, "pages")).select("page_id", "host", "order", "text", "text_hash")


@query(BLOCKS + "SELECT page_id AS doc_id, block_no, kind, text FROM blocks")
def d4_boilerplate_free(s, d):
    return html.blocks(table(s, d, "pages"), boilerplate=True).select("doc_id", "block_no", "kind", "text")


@query(BLOCKS + rf""", j AS (SELECT page_id, island, {TOKENS.format("string_agg(text, chr(10) ORDER BY block_no)")} AS w FROM blocks GROUP BY 1, 2), k AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 1200 THEN 1 ELSE CAST(ceil((len(w) - 1200) / 1000.0) AS BIGINT) + 1 END AS k FROM j),
c AS (SELECT page_id, island, i, {NFC.format("array_to_string(list_slice(w, i * 1000 + 1, i * 1000 + 1200), ' ')")} AS text FROM k, unnest(range(k)) t(i))
SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY island, i) - 1)::INTEGER AS "order", text, sha256({NORMAL}) AS text_hash FROM c""")
def d5_section_windows(s, d):
    return chunking.section_windows(html.blocks(table(s, d, "pages"), boilerplate=True)).select("doc_id", "order", "text", "text_hash")


@query(r"""SELECT l_orderkey AS page_id, 0 AS table_id, 'line' || chr(9) || 'part' || chr(10) || string_agg(l_linenumber || chr(9) || l_partkey || ' x', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY 1 UNION ALL SELECT DISTINCT l_orderkey, 1, l_orderkey::VARCHAR FROM lineitem""")
def d7_tables(s, d):
    return html.extract(_order_pages(s, d), tables_as_text=True).where("type = 'table_text'").select("page_id", "table_id", "text")


@query("""SELECT p_partkey AS page_id, 'figure' AS kind, p_name AS what, '/img/' || p_partkey || '.png' AS source FROM part UNION ALL SELECT p_partkey, 'image', sha256(p_name || p_partkey), strlen(p_name || p_partkey)::VARCHAR FROM part""")
def d8_d9_figures_images(s, d):
    key = F.col("p_partkey").cast("string")
    data = F.base64(F.encode(F.concat("p_name", key), "UTF-8"))
    body = (F.lit('<html><body><figure><img src="/img/'), key, F.lit('.png"><figcaption> '), F.col("p_name"), F.lit('</figcaption></figure><p><img src="data:image/png;base64,'), data, F.lit('"></p></body></html>'))
    p = table(s, d, "part").select(F.col("p_partkey").alias("page_id"), key.alias("url"), F.concat(*body).alias("html"))
    images = html.inline_images(p).select("page_id", F.lit("image").alias("kind"), F.col("image_hash").alias("what"), F.col("n_bytes").cast("string").alias("source"))
    return html.figures(p).select("page_id", F.lit("figure").alias("kind"), F.col("caption").alias("what"), F.col("src").alias("source")).unionByName(images)


@query(_packed(1000) + f""", h AS (SELECT *, sha256(section || {NORMAL}) AS text_hash FROM parts)
SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY island, part) - 1)::INTEGER AS "order", 'text' AS type, text, section, text_hash, {name_id('text_hash')} AS chunk_id FROM h""")
def d10_pack_by_section(s, d):
    c = chunking.pack_by_section(html.blocks(table(s, d, "pages")))
    return c.select("doc_id", "order", "type", "text", F.array_join("section_path", " / ").alias("section"), "text_hash", "chunk_id")


@query(_packed(900) + f""", h AS (SELECT *, sha256({NORMAL}) AS text_hash FROM parts)
SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY island, part) - 1)::INTEGER AS "order", 'text' AS type, text, NULL::INTEGER AS step_id, text_hash, {name_id('text_hash')} AS chunk_id FROM h""")
def d11_pack_by_layout(s, d):
    c = chunking.pack_by_layout(html.blocks(table(s, d, "pages"), mode="typed", tables_as_text=True))
    return c.select("doc_id", "order", "type", "text", "step_id", "text_hash", "chunk_id")


# Steps, tables with metadata and titles of the orders' pages: every heading and step begins a chunk.
@query(r"""WITH n AS (SELECT l_orderkey AS k, count(*)::INTEGER AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS k, (row_number() OVER w)::INTEGER AS r, 'Part ' || l_partkey || ' & more' AS text, l_linenumber || chr(9) || l_partkey || ' x' AS line FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
t AS (SELECT k, 'line' || chr(9) || 'part' || chr(10) || string_agg(line, chr(10) ORDER BY r) AS text FROM s GROUP BY 1)
SELECT k AS doc_id, 0 AS "order", 'text' AS type, 'Order ' || k || chr(10) || 'Lines <all>' AS text, NULL::INTEGER AS step_id, '' AS table_id FROM n UNION ALL SELECT k, r, 'text', text, r, '' FROM s UNION ALL SELECT k, n + 1, 'table_text', t.text, n, '0' FROM t JOIN n USING (k)
UNION ALL SELECT k, n + 2, 'text', 'Notes' || chr(10) || 'a  b', NULL, '' FROM n UNION ALL SELECT k, n + 3, 'table_text', k::VARCHAR, NULL, '1' FROM n""")
def d11_pack_order_pages(s, d):
    c = chunking.pack_by_layout(html.blocks(_order_pages(s, d), mode="typed", tables_as_text=True))
    return c.select("doc_id", "order", "type", "text", "step_id", F.coalesce(F.try_element_at("meta", F.lit("table_id")), F.lit("")).alias("table_id"))


_DOC_LINES = r"SELECT doc_id, 1 AS page, i AS line_no, l AS text, CASE WHEN length(l) < 20 THEN 14.0 ELSE 10.0 END AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"


def _doc_lines(s, d):
    x = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return x.select("doc_id", F.lit(1).alias("page"), "line_no", "text", F.when(F.length("text") < 20, 14.0).otherwise(10.0).alias("size"))


@query(rf"""WITH l AS ({_DOC_LINES}), m AS (SELECT *, median(size) OVER (PARTITION BY doc_id) AS med FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM m WHERE trim(text) <> '')
SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '[|\t]|  ') THEN 'table' WHEN size > 1.2 * med OR rn = 1 THEN 'title' WHEN regexp_matches(trim(text), '(?i)^(?:step\s*)?\d+[.)\s]|^[-*]\s+') THEN 'step' ELSE 'text' END AS kind FROM k""")
def d12_line_layout(s, d):
    lines = _doc_lines(s, d)
    b = chunking.lines_to_blocks(lines)
    kept = lines.where(F.trim("text") != "").withColumn("block_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_no")) - 1)
    return kept.join(b.select("doc_id", "block_no", "kind", "type"), ["doc_id", "block_no"]).select("doc_id", "line_no", F.when(F.col("type") != "text", "table").otherwise(F.coalesce("kind", F.lit("text"))).alias("kind"))


@query(rf"""WITH l AS ({_DOC_LINES}), x AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN upper(replace(text, 'ß', 'SS')) ELSE text END AS text FROM l),
k AS (SELECT *, CASE WHEN upper(replace(text, 'ß', 'SS')) = text AND regexp_matches(text, '\p{{Lu}}') THEN trim(text) END AS heading FROM x WHERE trim(text) <> '')
SELECT doc_id, line_no, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'INTRO') AS section FROM k""")
def d12_upper_case_sections(s, d):
    """Lines of documents, every fourth in capitals."""
    lines = _doc_lines(s, d).withColumn("text", F.when(F.col("line_no") % 4 == 1, F.upper("text")).otherwise(F.col("text")))
    return chunking.upper_case_sections(lines).select("doc_id", "line_no", "section")


@query(CHUNKS + f""", p AS (SELECT doc_id, (ord // 3 + 1)::BIGINT AS page, string_agg(text, ' ' ORDER BY ord) AS t FROM chunks GROUP BY 1, 2) SELECT doc_id, page, {language('t')} AS lang FROM p""")
def d13_page_languages(s, d):
    c = chunks_of(s, d).select("doc_id", (F.floor(F.col("order") / 3) + 1).alias("page"), F.col("order").alias("block_no"), "text")
    return langid.page_languages(c)


@query("""SELECT 'https://site0.example/p' || page_id AS url, floor(log2(page_id // 5 + 1 + 1e-9))::INTEGER AS depth, page_id // 5 AS seq FROM pages WHERE page_id % 5 = 0""")
def d15_crawl(s, d):
    """Pages of five sites; within a site page j links to the pages 2j + 1 and 2j + 2, and to one of another site."""
    from ..operators import crawl

    k = F.col("page_id")
    own = lambda j: F.concat(F.lit('<a href="/p'), (5 * j + k % 5).cast("string"), F.lit('#a">x</a>'))
    j = F.floor(k / 5)
    body = F.concat(F.lit("<html><body><p>"), own(2 * j + 1), F.lit('<a href="https://other.example/p'), k.cast("string"), F.lit('">y</a>'), own(2 * j + 2), F.lit("</p></body></html>"))
    pages = table(s, d, "pages").select("page_id", F.concat(F.lit("https://site"), (k % 5).cast("string"), F.lit(".example/p"), k.cast("string")).alias("url"), body.alias("html"))
    return crawl.reachable(pages, html.links(pages), "https://site0.example/p0", max_depth=40, max_pages=1 << 30)


@query(BLOCKS + "SELECT 'parsed' AS what, page_id, block_no, text FROM blocks WHERE page_id % 10 <> 0 UNION ALL SELECT 'error', page_id, NULL, 'no parser for application/x-unknown' FROM pages WHERE page_id % 10 = 0")
def d16_dispatch(s, d):
    pages = table(s, d, "pages").withColumn("mime", F.when(F.col("page_id") % 10 == 0, "application/x-unknown").otherwise("text/html"))
    parsed, errors = ingest.dispatch(pages, {"text/html": lambda p: html.blocks(p)})
    return parsed.select(F.lit("parsed").alias("what"), F.col("doc_id").alias("page_id"), "block_no", "text").unionByName(errors.select(F.lit("error").alias("what"), "page_id", F.lit(None).cast("int").alias("block_no"), F.col("error").alias("text")))
