"""Text functions: Column in, Column out. Python only where Spark has no Unicode normalisation or match offsets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"(?U)\s+"
#: Three-letter codes with a two-letter form.
LANGUAGE_CODES = {"eng": "en", "spa": "es", "fra": "fr", "deu": "de"}
#: Fixed value: the name space of name-based ids for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value made once, also where lambdas inside the body use it many times."""
    return F.transform(F.array(value), body)[0]


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def hash_form(text: Column) -> Column:
    return F.lower(collapse(text))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_length(text: Column, tokenizer=None) -> Column:
    """Words, or what ``tokenizer`` (a pandas UDF from text to int) counts."""
    return token_count(text) if tokenizer is None else tokenizer(text)


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfc_form(text: Column) -> Column:
    """Soft hyphens gone, fi and fl ligatures spelled out, NFC, control characters to spaces, white space collapsed."""
    plain = F.replace(F.replace(F.replace(text, F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return collapse(F.regexp_replace(_nfc(plain), r"[\x00-\x1F\x7F]", " "))


def parse_form(text: Column) -> Column:
    """Struct (text, removed): line ends to LF, NFKC, control characters but LF and TAB removed and counted."""
    folded = _nfkc(F.regexp_replace(text, "\r\n?", "\n"))
    clean = F.regexp_replace(folded, r"[\p{Cc}&&[^\n\t]]", "")
    return F.struct(clean.alias("text"), (F.length(folded) - F.length(clean)).alias("removed"))


def char_coverage(text: Column) -> Column:
    """Struct of the shares of ASCII, Latin-1 (beyond ASCII) and other characters; an empty text has zeros."""
    n = F.length(text)
    share = lambda pattern: F.when(n > 0, F.length(F.regexp_replace(text, pattern, "")) / n).otherwise(0.0)
    return F.struct(share(r"[^\x00-\x7F]").alias("ascii_ratio"), share(r"[^\x80-\xFF]").alias("latin1_ratio"), share(r"[\x00-\xFF]").alias("other_ratio"))


def windows(text: Column, target: int, overlap: int) -> Column:
    """Array of windows of ``target`` tokens that overlap, the last ending at the last token."""
    step = max(1, target - overlap)

    def of(words: Column) -> Column:
        n = F.size(words)
        count = F.when(n <= target, 1).otherwise(F.ceil((n - target) / step).cast("int") + 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * step + 1, target), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens(text), of)


def stable_key(section_path: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.array_join(section_path, "/"), text), 256)


def hashed_text(kind: Column, text: Column) -> Column:
    """What a chunk's hash is made from: its text in hash form, or its type where it has none."""
    return hash_form(F.when(kind.isin("text", "table_text") & (text != ""), text).otherwise(kind))


def text_hash(kind: Column, text: Column, section_path: Column | None = None) -> Column:
    key = hashed_text(kind, text)
    return F.sha2(key, 256) if section_path is None else stable_key(section_path, key)


def name_id(name: Column) -> Column:
    """Version-5 id of a name under the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def language_code(lang: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(lang)), F.left(F.lower(lang), F.lit(2)))


def unknown_languages(used: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(used, allowed))


SPAN = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
#: Patterns of spans.
FENCE = re.compile(r"(?P<fence>```|~~~)(.*?)(?P=fence)", re.DOTALL)
DISPLAY_MATH = re.compile(r"\\\[(.+?)\\\]|(?<!\\)\$\$(.+?)(?<!\\)\$\$", re.DOTALL)
INLINE_MATH = re.compile(r"(?<!\\)\$(.+?)(?<!\\)\$")
INDENTED = re.compile(r"(?:^[ \t]{4,}[^\n]*(?:\n|\Z))+", re.MULTILINE)


def spans_of(text: str) -> list[tuple[str, int, int, str]]:
    found = [(kind, m.start(), m.end(), m[0]) for kind, pattern in (("code_fence", FENCE), ("math", DISPLAY_MATH), ("math", INLINE_MATH), ("monospace", INDENTED)) for m in pattern.finditer(text) if m.end() > m.start()]
    return sorted(found, key=lambda s: s[1])


@F.pandas_udf(SPAN)
def detect_spans(texts: pd.Series) -> pd.Series:
    """Fenced code, mathematics and runs of indented lines, with their offsets, by start."""
    return texts.map(lambda s: [dict(zip(("type", "start", "end", "text"), x, strict=True)) for x in spans_of(s or "")])


def clamp_box(box: dict[str, Column], width: Column, height: Column) -> Column:
    """x0, y0, x1, y1 as shares of the page, within 0 to 1."""
    share = lambda x, of: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / of))
    return F.struct(*(share(box[k], width if k[0] == "x" else height).alias(k) for k in ("x0", "y0", "x1", "y1")))


def keywords(text: Column) -> Column:
    """Distinct lower-case words of 3 letters or digits at least, other characters dropped."""
    bare = F.transform(F.split(F.lower(text), SPACES), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) >= 3))


def keyword_overlap(prompt: Column, text: Column) -> Column:
    wanted = keywords(prompt)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, keywords(text))) / F.size(wanted)).otherwise(0.0)


def clean_number(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))
