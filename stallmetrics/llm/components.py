"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def components(edges: DataFrame) -> DataFrame:
    """v, root for each vertex of edges (a, b: long), root being a vertex of its component.

    Each round maps every vertex to the least of itself and its neighbours and contracts the
    edges by that map; maps are composed. With labels in random order the number of vertices
    falls by a constant factor a round. Only joins, aggregates with map-side combining and
    written tables: no vertex's neighbours are gathered, and nothing goes to the driver but
    whether edges are left.
    """
    edges = Stored(edges.filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.df.isEmpty():
        both = edges.df.unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")), "parents")
        if labels is None:
            merged = Stored(least.df.select("v", F.col("p").alias("root")), "labels")
        else:
            step = least.df.withColumnRenamed("v", "root")
            merged = Stored(labels.df.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
            labels.drop()
        labels = merged
        of = lambda name, to: least.df.select(F.col("v").alias(name), F.col("p").alias(to))  # noqa: B023, E731
        contracted = Stored(edges.df.join(of("a", "pa"), "a").join(of("b", "pb"), "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        edges.drop()
        least.drop()
        edges = contracted
    edges.drop()
    return labels.df if labels else edges.df.sparkSession.createDataFrame([], "v long, root long")
