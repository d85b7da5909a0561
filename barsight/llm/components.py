"""Connected components by alternating large-star and small-star."""

from pyspark.sql import functions as F

from barsight.session import cut_lineage


def _print_of(edges):
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()


def components(edges):
    """Edges (a, b) of integers -> (node, root): the smallest node each node can reach.

    Large-star links the larger neighbours of a node to its smallest neighbour (or itself);
    small-star links the smaller neighbours and the node itself to the smallest. Both only take a
    minimum per node and join it back, so a node with very many neighbours is combined before the
    shuffle and its join can be split. Rounds end when the edges no longer change. Every round is
    a written table. Nodes without an edge to another node don't appear; null ends are skipped.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _print_of(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = cut_lineage(small.where("a <> b").distinct())
        last, seen = seen, _print_of(now)
        if tuple(last) == tuple(seen):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
