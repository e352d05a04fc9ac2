"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.llm.common import save, scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, component): each linked node with the smallest id that it reaches.

    Nodes without links, links with a null end and links to oneself give no row. Each round saves its links in the
    shared folder, so lineage stays short; no links reach the driver, only their count and checksum.
    """
    with scratch(edges.sparkSession):
        links = settle(edges)
        return save(links, "components", outlive=True)


def settle(edges: DataFrame) -> DataFrame:
    """Large and small stars in turn until nothing changes: (node, component)."""
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = save(links, "links")
    before = None
    while True:  # each round brings some node nearer to its smallest, so it ends
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        links = save(small_star(large_star(links)), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()
