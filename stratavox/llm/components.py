"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, release, stored


def _least(links: DataFrame) -> DataFrame:
    """Per node u the least of itself and its neighbours; partial sums keep hubs from one task."""
    return links.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def _step(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v; gives (u, v) with u > v again."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        joined = both.join(_least(both), "u").where("v > u")
        new = joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("least"))
        joined = links.join(least, "u")
        new = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return new.where("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the links (a, b); label is the least node that it reaches.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the
    longest chain.  Raises ``RuntimeError`` rather than return unfinished labels.
    """
    since = mark()
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        now = stored(_step(_step(now, large=True), large=False), "links")
        release(links.sparkSession, since, keep=1)  # the round before is read no more
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
