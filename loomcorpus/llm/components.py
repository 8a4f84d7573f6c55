"""Connected components by rounds of joins and partial sums; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest reachable node.

    Each round, every node takes the smallest label among its neighbours', labels jump to their
    label's label, and edges are redrawn between labels; edges inside a label fall away. A round is
    written, and the rounds end when no edge is left. Stars, which is what the operators draw, take
    one or two rounds.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "component-edges")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = materialize(nodes.select("node", F.col("node").alias("label")), "component-labels")
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min("b").alias("low"))
        near = materialize(best.select(F.col("a").alias("old"), F.least("a", "low").alias("up")), "component-step")
        step = near
        for _ in range(2):  # follow two links further, so that chains shrink faster
            above = step.select(F.col("old").alias("_o"), F.col("up").alias("_u"))
            step = step.join(above, F.col("up") == F.col("_o"), "left").select(
                "old", F.coalesce("_u", "up").alias("up")
            )
        step = materialize(step, "component-step")
        relabelled = materialize(
            members.join(step, F.col("label") == F.col("old"), "left").select(
                "node", F.coalesce("up", "label").alias("label")
            ),
            "component-labels",
        )
        left = step.select(F.col("old").alias("a"), F.col("up").alias("x"))
        right = step.select(F.col("old").alias("b"), F.col("up").alias("y"))
        moved = pairs.join(left, "a").join(right, "b").filter("x <> y")
        redrawn = materialize(
            moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "component-edges"
        )
        discard(near, step, members, pairs)
        members, pairs = relabelled, redrawn
    return members.select("node", F.col("label").alias("root"))
