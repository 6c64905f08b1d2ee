"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (u, v) that is not the least of its component; root is the least.

    Each round reads and writes the edges in the shared folder, so no lineage grows and a lost executor costs one
    round at most. The rounds end when a round changes nothing.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select("u", F.col("v").alias("root"))
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # In the large-star result every v is less than its u; the small star hangs u and its v on the least v.
        small = _with_least(large)
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        last, now = now, materialize(hung.filter("u <> v").distinct(), "edges")
        discard(last)
