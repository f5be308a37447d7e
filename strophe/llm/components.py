"""Connected components of an edge table by alternating large-star and small-star joins.

Each step is two aggregations and two joins on a vertex; a star that holds a third of all edges is aggregated before
the shuffle, and its join is on the vertex and one of ``SALTS`` parts of its neighbours, so it meets in as many tasks. After O(log^2 n) steps (few in practice) every component is a star around its
lowest vertex. Each step is written to the shared folder, so lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import discard, stored


SALTS = 16


def _to_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (u, v) with ``low``'s m of their u."""
    part = F.pmod(F.xxhash64("v"), F.lit(SALTS))
    return edges.withColumn("part", part).join(low.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["u", "part"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a < b."""
    if large:  # every neighbour above u goes to the lowest of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = _to_lowest(both.filter(F.col("v") > F.col("u")), low).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:  # u and its neighbours below go to the lowest of those
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = _to_lowest(down, low).select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.filter(F.col("a") < F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(sig, label) for each vertex of the links (a, b): label is the lowest vertex of its component."""
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        new = stored(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges, now = new, state(new)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("sig"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("sig"), F.col("a").alias("label")).distinct())
