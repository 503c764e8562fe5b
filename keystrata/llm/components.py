"""Connected components of an undirected graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, store


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: ties each node's larger neighbours to the least of it and its neighbours. Else ties each
    node and its smaller neighbours to the least of these."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        tied = tied.where("b > a").select("m", F.col("b").alias("x"))
    else:
        tied = tied.select("m", F.col("b").alias("x")).union(least.select("m", F.col("a").alias("x")))
    return tied.where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of an edge reaches. edges: (a, b) longs. The
    number of rounds grows with the logarithm of the longest path; each is written to shared storage."""
    spark = edges.sparkSession
    path = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = spark.read.parquet(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.max(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        after = store(_stars(_stars(now, True), False))
        erase(spark, path)
        path = after
    pairs = spark.read.parquet(path)
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).union(pairs.select("a", "a")).distinct()
