"""Connected components of a link table, without bringing links or nodes to the driver.

Alternates two star operations on the links: every larger neighbour of a node is joined to the node's smallest
neighbour, then every smaller one is.  The links turn into stars around the smallest node of each component in a number
of rounds that grows with the logarithm of the component's size.  A node of very high degree is only ever aggregated
(partial sums before the shuffle) or joined (Spark splits such a join), never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretide.llm import storage


def local_stars(n: int, left, right):
    """numpy: for nodes 0..n-1 and links left-right, the smallest node reachable from each."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of any comparable type to ``(node, root)``: the smallest node of each linked node's component.

    Null ends and links of a node to itself are ignored; repeated links count once.  An empty table gives no rows.

    Rounds end when a link table has the count and both checksums (64 bits each) of the one before.  A round that changes
    links moves some to smaller nodes, and such tables would have to agree in all three by chance, about 1 in 2**64 a
    round, to end too early.
    """
    spark = links.sparkSession
    stars, path = _stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large, large_paths = _joined(both, least, lambda e: e.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        # a smaller neighbour and the node itself both go to the smallest neighbour
        stars, new_paths = _joined(large, least, lambda e: e.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")))
        for old in (path, *large_paths, *new_paths[:-1]):
            storage.remove(spark, old)
        path, last, mark = new_paths[-1], mark, _mark(stars)
        if mark == last:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _joined(links: DataFrame, least: DataFrame, turn) -> tuple[DataFrame, list[str]]:
    """Links with the smallest neighbour of their first end, turned and stored.

    The smallest neighbours are stored before the join.  Joined straight from their aggregate they would keep its
    partitions, and Spark could not split the partition of a node with very many links.
    """
    stored, path = _stored(least)
    found, last_path = _stored(turn(links.join(stored, links["a"] == stored["k"])).distinct())
    return found, [path, last_path]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = storage.new_path(spark, "links")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksums: equal for equal link tables."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
