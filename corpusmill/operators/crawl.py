"""Traversal of known pages by links, level by level."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize
from .numbering import numbered


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str, h: str) -> str | None:
        try:
            return urldefrag(urljoin(b, h))[0]
        except ValueError:
            return None

    return pd.Series([one(b or "", h or "") for b, h in zip(base, href, strict=True)], dtype=object)


def reachable(pages: DataFrame, links: DataFrame, start: str, max_depth: int = 2, max_pages: int = 1000, prefix: str | None = None) -> DataFrame:
    """url, depth, seq of the pages that a breadth-first walk from ``start`` visits: same host, below ``prefix`` if given,
    first come first served up to ``max_pages``. pages: url; links: url, link_no, href. A level is a join of the frontier
    with the links, less what was visited."""
    host = F.try_parse_url("url", F.lit("HOST"))
    known = pages.select("url").distinct()
    known = known.where(host == F.try_parse_url(F.lit(start), F.lit("HOST")))
    if prefix:
        known = known.where(F.col("url").startswith(prefix))
    edges = links.select("url", "link_no", resolve("url", "href").alias("to"))
    visited = materialize(known.where(F.col("url") == start).select("url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq")), "crawl")
    for depth in range(1, max_depth + 1):
        count = visited.count()
        frontier = visited.where(F.col("depth") == depth - 1)
        found = frontier.join(edges, "url").groupBy(F.col("to").alias("url")).agg(F.min(F.struct("seq", "link_no")).alias("by"))
        fresh = found.join(known, "url", "left_semi").join(visited, "url", "left_anti")
        ranked = numbered(fresh, ["by", "url"]).where(F.col("n") <= max_pages - count)
        step = materialize(ranked.select("url", F.lit(depth).alias("depth"), (F.col("n") + count - 1).cast("long").alias("seq")), "crawl")
        if step.limit(1).count() == 0:
            break
        visited = visited.unionByName(step)
    return visited
