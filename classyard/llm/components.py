"""Connected components of a graph given as a table of edges."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classyard.llm.common import stored


def _edges(pairs: DataFrame) -> DataFrame:
    """Each edge once, smaller node first, none from a node to itself."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the smallest node of each
    component.  In a round every node moves to its smallest neighbour, if that is
    smaller, and on along those moves to their end (pointer doubling); edges between
    nodes that are not yet one go on to the next round under their new names.  So an edge
    is joined once and only what is left of it again; all but the nodes that are smaller
    than their neighbours are gone after a round, so rounds grow with the logarithm."""
    left, moves = stored(_edges(edges), "cc-edges"), []
    while True:
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        move = stored(near.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-moves")
        while True:
            jump = move.select(F.col("node").alias("label"), F.col("label").alias("far"))
            far = stored(move.join(jump, "label").select("node", "label", "far"), "cc-moves")
            move = far.select("node", F.col("far").alias("label"))
            if far.where("label <> far").isEmpty():
                break
        moves.append(move)
        to = lambda x: move.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}"))
        left = stored(_edges(left.join(to("b"), "b").join(to("a"), "a").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "cc-edges")
        if left.isEmpty():
            break
    # where a node's last move leads, from the last round back
    label = moves.pop()
    while moves:
        far = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        label = stored(moves.pop().join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "cc-labels")
    return label
