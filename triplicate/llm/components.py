"""Connected components of a graph given as links, by repeated joins with stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplicate.llm.common import FREQUENT, join_hot, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b) of one column type, for every linked node.

    Alternates two steps until nothing changes: every node points its larger neighbours, then its smaller ones, to
    the smallest node that it knows. Each step groups by node with partial aggregation and writes its links to the
    shared folder; the number of rounds grows with the logarithm of the longest chain. Self-links give a component
    of one node; no links give no rows. Nodes with very many neighbours are joined apart.
    """
    links = materialize(links.select("a", "b"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(both.where("a <> b"))
    before, total = None, links.count()
    while True:
        # Larger neighbours of each node, to the smallest of its neighbourhood.
        arcs = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = arcs.groupBy("a").agg(F.min("b").alias("least"), F.count_if(F.col("b") > F.col("a")).alias("n")).where("n > 0")
        least = least.select("a", F.least("a", "least").alias("least"), "n")
        least = materialize(least) if total > FREQUENT else least
        large = join_hot(arcs.where("b > a"), least, ["a"], "n", total)
        down = materialize(large.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct())
        # Smaller neighbours of each node, and the node, to the smallest of them; links now point downwards.
        least = down.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
        least = materialize(least) if total > FREQUENT else least
        joined = join_hot(down, least, ["a"], "n", total)
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select("a", F.col("least").alias("b")))
        links = materialize(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
