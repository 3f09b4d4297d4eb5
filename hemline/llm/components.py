"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node of the edges ``a``, ``b`` (bigint).

    Each round every node hooks to its smallest neighbour and to that one's, and the graph is contracted to the
    hooks, so the number of rounds grows with the logarithm of the longest path. Smallest neighbours are combined
    before the shuffle; edges of a node with very many neighbours meet only in joins that Spark can split. Each round
    is written out, which cuts the lineage.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("n"), F.least("a", "b").alias("p"))
        hook = stored(hook, "hooks")
        up = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
        hook = stored(hook.join(up, "p").select("n", F.col("q").alias("p")), "hooks")
        if labels is None:
            labels = hook.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            moved = hook.select(F.col("n").alias("root"), F.col("p").alias("_to"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        labels = stored(labels, "labels")
        a, b = hook.select(F.col("n").alias("a"), F.col("p").alias("x")), hook.select(F.col("n").alias("b"), F.col("p").alias("y"))
        moved = edges.join(a, "a").join(b, "b").filter("x <> y")
        edges = stored(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
