"""Connected components of an undirected graph, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.common import drop_table, materialize


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, comp) for every id in edges (a, b); comp is the smallest id reachable, itself included.

    Self-loops, repeated edges and nulls are allowed (a null end joins nothing). No edges: no rows.
    Each round takes the least label among the neighbours, then the label of that label; labels
    only fall, and a long path halves with each round. Every round is written to the shared
    folder, so lost executors repeat one round at most. Minima are combined before each shuffle.
    """
    pairs = edges.where("a is not null and b is not null")
    both = materialize(
        pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, labels.id == near.a, "left").select("id", F.least("comp", "near").alias("to"), F.col("comp").alias("old"))
        hooked = materialize(hooked, "cc-hook")
        over = hooked.select(F.col("id").alias("via"), F.col("to").alias("further"))
        jumped = materialize(
            hooked.join(over, F.col("to") == F.col("via"), "left").select("id", F.least("to", "further").alias("comp"), "old"), "cc-labels"
        )
        moved = jumped.where("comp <> old").limit(1).count()
        drop_table(hooked)
        drop_table(labels)
        labels = jumped.select("id", "comp")
        if not moved:
            drop_table(both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
