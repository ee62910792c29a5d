"""Connected components of large sparse graphs, by contraction over a few written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); ``comp`` is the least node of the component.

    In each round a node moves to its least neighbour and edges are contracted, so about a
    constant share of nodes goes away. Degrees are reduced before the shuffle, and rounds are
    written tables: a hub costs no more than its edges, and nothing is collected. Nodes should
    have no meaning in their order (hashes); a long ordered chain would take many rounds.
    """
    edges = stage(edges.select("a", "b").filter("a != b"), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        moved = stage(least.select("node", F.least("node", "to").alias("to")), "moved")
        maps.append(moved)
        to_a, to_b = moved.toDF("a", "new_a"), moved.toDF("b", "new_b")
        edges = stage(
            edges.join(to_a, "a").join(to_b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
            .filter("a != b").distinct(),
            "edges",
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    total = maps[-1].toDF("node", "comp")
    for moved in reversed(maps[:-1]):
        later = total.toDF("to", "comp")
        total = moved.join(later, "to", "left").select("node", F.coalesce("comp", "to").alias("comp"))
    # Contraction goes to smaller neighbours only, but the last name needn't be the least of all.
    return stage(total, "components")
