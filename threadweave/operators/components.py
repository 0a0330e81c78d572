"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of an undirected edge list with the least vertex of its component.

    Returns ``(node, component)`` for each vertex that occurs in an edge; a vertex with only a
    self loop is its own component. Edges with a null end are ignored, repeated edges and both
    directions count once, an empty input gives no rows. Each round re-links every vertex to the
    least vertex in reach, so the number of rounds grows with the logarithm of the diameter. A
    round is cut from its lineage by a reliable checkpoint. Raises after ``max_rounds``.
    """
    a, b = F.col(src), F.col(dst)
    given = edges.where(a.isNotNull() & b.isNotNull())
    nodes = given.select(F.explode(F.array(a, b)).alias("node")).distinct()
    links = cut(given.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _state(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = links.select("hi", "lo").unionAll(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = F.least(F.min("lo").over(Window.partitionBy("hi")), F.col("hi"))
        large = both.select(F.col("lo").alias("v"), "hi", least.alias("m")).where("v > hi")
        large = large.select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        small = large.select("hi", "lo", F.min("lo").over(Window.partitionBy("hi")).alias("m"))
        small = small.select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
        links = cut(small.where("hi <> lo").distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    row = links.agg(F.count(F.lit(1)), F.sum(mixed)).first()
    return row[0], row[1]
