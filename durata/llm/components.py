"""Connected components of an edge table by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import hot_join, hot_keys, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(a, b)``: the smallest node that links reach.

    Each round takes the least label of a node, its neighbours and its label's own
    label, so a chain of n links takes about log n rounds.  Rounds are stored
    tables; the loop ends when no label changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    total = label.count()
    for _ in range(most_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        low = label.join(near, label["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("root").alias("up"))
        hot = hot_keys(label.groupBy("root").agg(F.count("*").alias("n")), ["root"], "n", total)
        new = stored(hot_join(low, up, ["low"], hot, "left").select("node", F.least("low", "up").alias("root"), (F.least("low", "up") < F.col("root")).alias("moved")))
        label, moved = new.select("node", "root"), not new.filter("moved").isEmpty()
        if not moved:
            return label
    raise RuntimeError("components did not settle")
