"""Connected components by smallest label, with pointer jumping; every round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id, component (the smallest id reachable) of every id that a link names.

    A round takes the smallest label among neighbours and then the label's own label, so a chain of n links needs about
    log n rounds. Labels and links stay distributed; the driver sees one count a round.
    """
    both = links.select("a", "b").where("a <> b")
    edges = materialize(both.union(both.select("b", "a")).distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = lower.select(F.col("id").alias("new"), F.col("new").alias("next"))
        step = materialize(lower.join(jump, "new", "left").select("id", "old", F.least(F.col("new"), F.coalesce("next", "new")).alias("label")), "labels")
        if step.where("old <> label").limit(1).count() == 0:
            return step.select("id", F.col("label").alias("component"))
        labels = step.select("id", "label")
