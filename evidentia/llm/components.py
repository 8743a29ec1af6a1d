"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, saved


def _edges(df: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v."""
    return df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """A table (u, p) of roots from (u, p) with p < u: every vertex looks where its parent points, until nothing changes."""
    last = None
    while True:
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
        now = saved(parents.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
        dropped(last)
        if now.where("moved").isEmpty():
            return now
        parents = last = now


def components(edges: DataFrame) -> DataFrame:
    """(vertex, least): for each vertex of the edges (a, b), loops aside, the least vertex that it can reach.

    Each round, every vertex with a smaller neighbour hooks to its least one; the
    trees that this makes shrink to their roots by doubling jumps, and the edges
    between different trees are the next round's. A hub's edges combine before
    they are shuffled. A round has the largest vertex of each edge hooked, so
    stars take two rounds and paths one.
    """
    now = saved(_edges(edges), "edges")
    done = None
    while not now.isEmpty():
        parents = _roots(now.groupBy("u").agg(F.min("v").alias("p")))
        roots = parents.select("u", F.col("p").alias("root"))
        lows = now.select("v").distinct().join(roots.select(F.col("u").alias("v")), "v", "left_anti").select(F.col("v").alias("u"), F.col("v").alias("root"))
        every = saved(roots.unionByName(lows), "roots")
        dropped(parents)
        if done is None:
            later = every.select(F.col("u").alias("vertex"), F.col("root").alias("least"))
        else:
            later = done.join(every.withColumnRenamed("u", "least").hint("merge"), "least", "left").select("vertex", F.coalesce("root", "least").alias("least"))
        later = saved(later, "least")
        dropped(done)
        done = later
        a, b = every.select("u", F.col("root").alias("a")), every.select(F.col("u").alias("v"), F.col("root").alias("b"))
        left = saved(_edges(now.join(a, "u").join(b, "v").select("a", "b")), "edges")
        dropped(now, every)
        now = left
    return done if done is not None else now.select(F.col("u").alias("vertex"), F.col("v").alias("least"))
