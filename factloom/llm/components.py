"""Connected components of a link table, by joins: each round hangs neighbours under smaller ids until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest id that each node of links (a, b) reaches.

    Alternates large-star (a node's larger neighbours move under its smallest) and small-star (its smaller
    neighbours do); per round two aggregations and two joins, none of which gathers a node's neighbours.
    """
    ends = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    edges = stored(links.where("a <> b").select(*ends).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = stored(large.where("low <> high").distinct(), "links")
        least = large.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        moved = large.withColumnRenamed("high", "u").join(least, "u")
        small = moved.select(F.col("m").alias("low"), F.col("low").alias("high")).unionByName(moved.select(F.col("m").alias("low"), F.col("u").alias("high")))
        new = stored(small.where("low <> high").distinct(), "links")
        drop_stored(edges)
        drop_stored(large)
        edges = new
    nodes = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return stored(nodes.groupBy("node").agg(F.min("root").alias("root")), "components")
