"""Connected components of an edge table by alternating large and small stars, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself are hung on the smallest of them."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    hung = edges.join(least, F.col("b") == F.col("u")).select(F.col("m"), F.col("a").alias("x"))
    own = least.select("m", F.col("u").alias("x"))
    return hung.unionByName(own).where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


#: Edges of one file of a round's table.
FILE_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b -> (node, root): every node of an edge and the smallest node that it reaches.

    Rounds grow with the logarithm of the longest path; each writes its edges to the shared folder, in files of about ``FILE_EDGES``. Every round
    keeps at most as many edges as it got. The round that changes nothing is the last: by then every node hangs on its root.
    """
    edges = stage(edges.where("a < b").distinct(), "edges")
    print_of = [F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))]
    before = edges.agg(*print_of).first()
    while before[0]:
        edges = stage(_small_star(_large_star(edges)).coalesce(-(-before[0] // FILE_EDGES)), "stars")
        after = edges.agg(*print_of).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
