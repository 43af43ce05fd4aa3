"""Distributed connected components by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.workspace import Scratch, delete_dir


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that is reachable.

    Each round first links all larger neighbours of a node to its least
    neighbour, then all smaller ones; the edges end as stars around the least
    node. Neighbourhoods are never gathered: a node's least neighbour is an
    aggregate that is joined back to its edges. Rounds grow with the logarithm
    of the longest path. Nodes can be of any type that has an order; edges with
    a null end are no edges. Without edges the result is empty.
    """
    a, b = F.col("a"), F.col("b")

    def keep(frame: DataFrame) -> tuple[DataFrame, str]:
        path = f"{scratch.path}/{scratch.kept:02d}-stars"
        return scratch.keep(frame.where(a != b).distinct(), "stars"), path

    stars, path = keep(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")))
    before = None
    while True:
        seen = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            return stars.select(a.alias("node"), b.alias("component")).union(
                stars.select(b, b.alias("component")).distinct()
            )
        before, old = seen, path
        both = stars.union(stars.select(b, a))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = (
            both.join(least, "a")
            .where(b > a)
            .select(b.alias("a"), F.least("a", "least").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(a.alias("a"), F.col("least").alias("b")),
                    F.struct(b.alias("a"), F.col("least").alias("b")),
                )
            ).alias("e")
        )
        stars, path = keep(small.select("e.*"))
        delete_dir(scratch.spark, old)
