"""Connected components of a link table, with no vertex or link ever on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, persisted


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root`` for every end of ``edges (a, b)``; root is the least node reachable.

    Each round lowers a node's label to the least label among its neighbours and
    then to that label's own label (pointer jumping). The link table keeps its
    degrees (bounded by the caller's construction), so no join key on that side
    grows; the label side of the jump may be hot, and is a plain sort-merge join
    that adaptive execution splits. Every round is a written table, so a lost
    executor costs at most one round. Repeated links count once, links of a node
    to itself not at all; no links give no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = persisted(both, "links")
    labels = persisted(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "root")
        lowered = labels.select("node", "root").unionByName(seen).groupBy("node").agg(F.min("root").alias("root"))
        own = labels.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        jumped = lowered.join(own, F.col("root") == F.col("__n"), "left").select("node", F.least("root", F.coalesce("__r", "root")).alias("root"))
        new = persisted(jumped, "labels")
        old = labels.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        changed = new.join(old, (F.col("node") == F.col("__n")) & (F.col("root") == F.col("__r")), "left_anti").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
