"""Connected components of a link table that nobody holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import staged


def _only_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    several = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    chained = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b), component being the smallest node that can be reached.

    Alternates the large-star and small-star steps: every node links its larger neighbours, then its smaller ones, to the
    smallest it knows. A round is staged to the shared folder; the number of rounds grows with the logarithm of the longest
    path. Links of a node to itself and repeated links do no harm.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = staged(links, "links")
    while not _only_stars(links):
        both = links.union(links.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = large.join(lowest, large["a"] == lowest["u"])
        small = joined.select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("l"))
        links = staged(small.select("l.*").where("a > b").distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
