"""Personal data and rule suggestions by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns, in the order of their types.
PII = {
    "email": r"(?U)\b[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?U)\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "id": r"(?U)\bID\d{3,}\b",
}
#: Field -> pattern; the first match of each is suggested.
RULES = {
    "severity": r"\b(?:DEBUG|INFO|WARN|ERROR|FATAL)\b",
    "step_id": r"(?m)^Step\s?\d+:",
    "ticket_id": r"\b(?:JIRA|BUG|INC)-\d+\b",
    "datetime": r"\b\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?\b",
}
#: Fixed values of a suggestion and of a redaction.
CONFIDENCE, RATIONALE, MASK = 0.9, "regex match", "[REDACTED]"
#: What a text must hold for a pattern to match; cheap to test, and most texts hold none of it.
SIGN = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.rlike(t, F.lit(r"\p{Nd}{4}")), "id": lambda t: F.contains(t, F.lit("ID"))}


def detect(text: Column) -> Column:
    """Array of (type, text) of all matches, type by type."""

    def found(kind: str, pattern: str) -> Column:
        matches = F.when(SIGN[kind](text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))
        return F.transform(matches, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))

    return F.concat(*(found(kind, pattern) for kind, pattern in PII.items()))


def redact(text: Column, matches: Column) -> Column:
    """Replaces every occurrence of every match, in order."""
    return F.aggregate(matches, text, lambda out, m: F.replace(out, m["text"], F.lit(MASK)))


def suggest(text: Column, most: int = 200, use_rules: bool = True) -> Column:
    """field -> (value, confidence, rationale, span); the first ``most`` rules that match."""
    entry = lambda v: F.struct(v.alias("value"), F.lit(CONFIDENCE).alias("confidence"), F.lit(RATIONALE).alias("rationale"), v.alias("span"))
    rules = RULES if use_rules else {}
    found = F.array(*(F.struct(F.lit(field).alias("key"), F.nullif(F.regexp_extract(text, p, 0), F.lit("")).alias("v")) for field, p in rules.items())) if rules else None
    if found is None:
        return F.create_map().cast("map<string,struct<value:string,confidence:double,rationale:string,span:string>>")
    hits = F.slice(F.filter(found, lambda x: x["v"].isNotNull()), 1, most)
    return F.map_from_arrays(F.transform(hits, lambda x: x["key"]), F.transform(hits, lambda x: entry(x["v"])))
