"""Agreement between annotators. audits: chunk_id, user, action, before and after map<string,string>, created_at, audit_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def changed(before: Column, after: Column) -> Column:
    """Entries of ``after`` that differ from ``before`` or are new."""
    return F.map_filter(after, lambda k, v: ~v.eqNullSafe(F.try_element_at(before, k)))


def kappa(pairs: DataFrame, *keys: str) -> DataFrame:
    """Cohen's kappa of the pairs (a, b) of each group; 1 where chance alone agrees always."""
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    left = cells.groupBy(*keys, F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*keys, F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    counted = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    po, pe = F.col("agree") / F.col("n"), F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    joined = counted.join(chance, list(keys), "left") if keys else counted.crossJoin(F.broadcast(chance))
    return joined.select(*keys, "n", F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def annotator_pairs(audits: DataFrame) -> DataFrame:
    """Per chunk and field the last values of the two users who changed it first: chunk_id, field, a, b."""
    when = F.struct("created_at", "audit_id")
    values = audits.select("chunk_id", "user", when.alias("at"), F.explode(changed(F.col("before"), F.col("after"))).alias("field", "value"))
    users = values.groupBy("chunk_id", "field", "user").agg(F.min("at").alias("first"), F.max_by("value", "at").alias("value"))
    ranked = users.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id", "field").orderBy("first"))).where("n <= 2")
    return ranked.groupBy("chunk_id", "field").agg(F.max(F.when(F.col("n") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("value"))).alias("b"), F.count("*").alias("k")).where("k = 2").drop("k")


def agreement(audits: DataFrame) -> DataFrame:
    return kappa(annotator_pairs(audits), "field")


def conflicts(audits: DataFrame) -> DataFrame:
    """Audits with ``action`` marked _conflict where an earlier audit of another user left the chunk with another value in a
    field that this one changes.

    Earlier values are not met one by one: of every chunk and field six witnesses are enough, the earliest value of all, and the
    earliest ones with another user, another value or both, and those that differ from these in turn.
    """
    keys, at = ["chunk_id", "field"], F.struct("created_at", "audit_id")
    mine = audits.select("audit_id", "chunk_id", "user", at.alias("at"), F.explode(changed(F.col("before"), F.col("after"))).alias("field", "value"))
    said = audits.where("user is not null").select("chunk_id", "user", at.alias("at"), F.explode("after").alias("field", "value")).groupBy(*keys, "user", "value").agg(F.min("at").alias("at"))
    said = materialize(said.withColumn("x", F.struct("at", "user", "value")).select(*keys, "x"), "said")
    user, value = (lambda w: ~F.col("x.user").eqNullSafe(F.col(f"{w}.user"))), (lambda w: ~F.col("x.value").eqNullSafe(F.col(f"{w}.value")))
    first = materialize(said.groupBy(*keys).agg(F.min("x").alias("a")), "first-said")
    pick = lambda condition: F.min(F.when(condition, F.col("x")))
    second = said.join(first, keys).groupBy(*keys, "a").agg(pick(user("a")).alias("b"), pick(value("a")).alias("c"), pick(user("a") & value("a")).alias("d"))
    second = materialize(second, "second-said")
    third = said.join(second, keys).groupBy(*keys, "a", "b", "c", "d").agg(pick(user("a") & value("b")).alias("e"), pick(value("a") & user("c")).alias("f"))
    met = mine.join(materialize(third, "third-said"), keys)
    earlier = lambda w: (F.col("user") != F.col(f"{w}.user")) & ~F.col("value").eqNullSafe(F.col(f"{w}.value")) & (F.col(f"{w}.at") < F.col("at"))
    hit = met.where(reduce(lambda x, y: x | y, (F.coalesce(earlier(w), F.lit(False)) for w in "abcdef"))).select("audit_id").distinct()
    marked = audits.join(hit.withColumn("_hit", F.lit(True)), "audit_id", "left")
    return marked.withColumn("action", F.when(F.col("_hit"), F.concat("action", F.lit("_conflict"))).otherwise(F.col("action"))).drop("_hit")
