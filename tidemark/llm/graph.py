"""Connected components by repeated contraction, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in links (a long, b long): the smallest id reachable from it.

    Each round every vertex takes the neighbour of the smallest hash, if that is smaller than its own,
    and links are rewritten to the vertices taken. Hashes stand in random order, so that a round removes
    a constant share of the vertices, also on chains; a star is done in three. Rounds aggregate with
    map-side partial sums and only join on equal keys, so that one vertex with very many links is safe.
    """
    left = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("best"))
        taken = cut(best.select(F.col("a").alias("id"), F.when(F.col("best.h") < F.xxhash64("a"), F.col("best.b")).otherwise(F.col("a")).alias("to")))
        if labels is None:
            labels = taken
        else:
            step = taken.select(F.col("id").alias("to"), F.col("to").alias("next"))
            labels = cut(labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        a = taken.select(F.col("id").alias("a"), F.col("to").alias("x"))
        b = taken.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = left.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = cut(moved.distinct())
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("to").agg(F.min("id").alias("component"))
    return labels.join(least, "to").select("id", "component")
