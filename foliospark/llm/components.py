"""Connected components by alternating large and small stars, entirely as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """``node, label`` for every end of an edge (``u, v``), of which there are at most ``rows``; the label is the smallest node of the component.

    Self-loops and repeated edges do no harm. Nodes that touch no edge are left out.
    """
    work = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    state = None
    while True:
        now = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        done, work = work, scratch.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", now[0])
        scratch.drop(done)
    return work.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(work.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
