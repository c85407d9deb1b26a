"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import mark, saved, settled


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b long): label is the least node of its component.

    Alternates large-star and small-star steps until nothing changes, which takes rounds as the
    logarithm of the longest path.  Each step is one aggregation with partial sums and one
    join, and its edges are written to the shared folder, so neither the plan nor a lost
    executor's work grows with the rounds; the edges of the round before go.
    A table without edges gives no rows.
    """
    before = mark()
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        summary = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (summary.n, summary.h) == state or not summary.n:
            break
        state = (summary.n, summary.h)
        now = settled(lambda now=now: _round(now), "edges", before)
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _round(now: DataFrame) -> DataFrame:
    """One large star and one small star.

    The least neighbours are written before they are joined: then the edges of a node that has
    very many, which all hang on the least node of a large component, can be split by adaptive execution.
    """
    both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = both.filter("v > u").join(least, "u").filter("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    # small star: each node with its neighbours below it, of which few are left
    least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    small = large.withColumnRenamed("b", "u").join(least, "u")
    return small.select(F.col("m"), F.explode(F.array("a", "u")).alias("b")).filter("m <> b").select(F.col("m").alias("a"), "b").distinct()
