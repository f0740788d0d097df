"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.storage import stored


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of `links` (a, b) with the smallest node it can reach.

    Each round connects the larger neighbours of every node to its smallest one, then the smaller
    neighbours. Rounds grow with the logarithm of the longest path. A node is met through its
    minimum only, which is combined before the shuffle, so a node with very many links stays one
    row per task; each round is written to the shared folder.
    """
    spark = links.sparkSession
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "links",
    )
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        after = stored(small, "links")
        # A star forest has no node that is both a child and a centre, and one centre per child.
        state = after.agg(F.count("*").alias("n"), F.countDistinct("a").alias("children")).first()
        inner = after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        edges = after
        if inner and state["n"] == state["children"]:
            break
    else:
        raise RuntimeError("links did not contract")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return spark.createDataFrame([], stars.schema).unionByName(stars).unionByName(centres)
