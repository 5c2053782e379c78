"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import attach, written


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, root): every linked node that is not a root, with the smallest node reachable.

    Each round links every node to smaller ones only and is written to the
    shared folder; the rounds end when nothing changes, after about log(n) of
    them.  Minima are combined before the shuffle, and the few nodes with a
    thousandth of all links or more get theirs by broadcast (``attach``), their
    links spread over the join, so no task needs all links of a node.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = attach(both, least, "a", "n", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = attach(large, lower, "a", "n", mark[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
