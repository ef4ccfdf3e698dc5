"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` for every node of the links (a, b); the label is the least node
    of the component. Links with a null end link nothing, loops on one node nothing else; repeated
    links count once. Labels are written as a table each round, so lineage stays short.

    First each node hands its links to lesser nodes over to the least of them, so that of the
    many links of a group of copies one a node remains. Neighbours' labels are reduced to a
    minimum before they are shuffled, so a hub costs one row per task; each round also jumps to
    the label of the label, which about halves the distance to the least node. Without links
    there is no round.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    down = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    down = scratch.save(down.where("not x and not y").select("u", "v").distinct(), "down", narrow=True)
    if down.isEmpty():
        return down.select(F.col("u").alias("node"), F.col("v").alias("label"))
    least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")), "least", narrow=True)
    # written, so that a node with very many links can be split where they are joined
    star = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    both = scratch.save(star.union(star.select("v", "u")).distinct(), "links", narrow=True)
    scratch.drop(down, least)
    labels = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels", narrow=True)
    moved = True
    while moved:
        near = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("n")).agg(F.min("label").alias("m"))
        closer = labels.join(near, labels["node"] == near["n"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("jump"))
        fresh = closer.join(jump, closer["label"] == jump["j"], "left").select("node", "old", F.least("label", "jump").alias("label"))
        fresh = scratch.save(fresh, "labels", narrow=True)
        moved = not fresh.where("old <> label").isEmpty()
        scratch.drop(labels)
        labels = fresh
    scratch.drop(both)
    return labels.select("node", "label")
