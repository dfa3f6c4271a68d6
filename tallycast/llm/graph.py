"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.storage import drop_scratch, write_scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    ``edges`` has long columns a and b. Each round links the larger neighbours of a node to
    its smallest one, then the smaller ones; both are joins and minima over edge rows, so
    no node's neighbours are gathered in one place, and the number of edges never grows.
    Rounds end when the edge set no longer changes; a round is kept in the shared folder.
    Null ends are ignored, as are loops and repeated edges.
    """
    spark = edges.sparkSession
    current = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr(
        "greatest(a, b) AS u", "least(a, b) AS v"
    )
    before, kept = None, []
    while True:
        path = write_scratch(current.distinct(), "edges")
        kept.append(path)
        edge = spark.read.schema("u long, v long").parquet(path)
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in kept[:-1]:
            drop_scratch(spark, old)
        kept = kept[-1:]
        if now == before or now[0] == 0:
            return edge.selectExpr("u AS node", "v AS component")
        before = now
        both = edge.union(edge.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        current = (
            large.join(smallest, "u")
            .select(F.explode(F.expr("array(struct(v AS u, m AS v), struct(u AS u, m AS v))")).alias("e"))
            .select("e.*")
            .where("u <> v")
        )
