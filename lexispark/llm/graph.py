"""Connected components as DataFrames: alternating large-star and small-star steps until all edges are stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, parts_for


#: Edges of a node from which on they are spread.
HUB = 100_000
#: Edges that a task takes (under 1 MB), where there are more than the cores have to do.
EDGES = 50_000


def components(edges: DataFrame, most_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges (a, b: long). Loops and repeats do no harm.

    A star's centre may have any degree: minima are pre-aggregated, and the join back spreads the edges of large centres.
    The tasks of a round, and so the files of its shuffles, are as many as the edges call for, however many partitions the session asks for.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))

    def back(e: DataFrame, m: DataFrame, most: int) -> DataFrame:
        return e.join(m.drop("n"), "a") if most <= hub else join_spread(e, cut(m), ["a"], "n")

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    # A round never adds edges, and no node has more than there are.
    rows = e.count()
    tasks = max(e.sparkSession.sparkContext.defaultParallelism, parts_for(rows, EDGES))
    e = e.coalesce(tasks)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        m = least(both).select("a", F.least("a", "m").alias("m"), "n")
        # Where every node is the least of its neighbourhood or has one edge only, all edges are stars around their components' least nodes.
        inner, most = m.coalesce(tasks).agg(F.count_if((F.col("m") < F.col("a")) & (F.col("n") > 1)), F.max("n")).first()
        if not inner:
            break
        # Each edge gives one row; the same row may come of several, which the next step's distinct() ends.
        large = cut(back(both, m, most).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks))
        m = least(large)
        small = back(large, m, rows if rows <= hub else m.agg(F.max("n")).first()[0])
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b")))
        e = cut(small.coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    tops = e.select(F.col("b").alias("node")).distinct().coalesce(tasks)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
