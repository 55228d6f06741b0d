"""Bounded breadth-first crawl over stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, normalized, same_domain
from ..session import checkpointed


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 50, same_site: bool = True) -> DataFrame:
    """links: url, target (both normalised); seeds: url, seq. url, depth and seq of the pages reached, max_pages of them, by depth, then the place
    of the page they were first found on, then URL. A page is visited once. same_site: a link must stay in the domain of its page.

    One join for each level up to max_depth; what was visited is kept from the frontier by an anti-join, and each level is cut to max_pages
    rows, as no later page could be reached by more. Each level is checkpointed, so plans stay short and no level is computed twice.
    """
    order = ["depth", "seq", "url"]
    front = seeds.select(normalized("url").alias("url"), F.col("seq").cast("long").alias("seq")).filter("url <> ''").groupBy("url").agg(F.min("seq").alias("seq")).withColumn("depth", F.lit(0)).orderBy("seq", "url").limit(max_pages)
    front = checkpointed(front)
    seen = front
    for depth in range(1, max_depth + 1):
        next_ = front.select(F.col("url").alias("from"), F.col("seq").alias("from_seq")).join(links.select(F.col("url").alias("from"), F.col("target").alias("url")), "from")
        if same_site:
            next_ = next_.filter(same_domain(host("url"), host("from")))
        next_ = next_.groupBy("url").agg(F.min(F.struct("from_seq", "url")).alias("found")).join(seen.select("url"), "url", "left_anti")
        next_ = next_.orderBy("found").limit(max_pages)
        # max_pages rows at most are numbered in one task
        front = checkpointed(next_.withColumn("seq", F.row_number().over(Window.orderBy("found")).cast("long")).select("url", "seq", F.lit(depth).alias("depth")))
        seen = seen.unionByName(front)
    return seen.orderBy(*order).limit(max_pages)
