"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node of an edge: id, comp (the smallest id it can reach).

    Every round is written to shared storage. Each node takes the smallest label around it, then its label's label, so
    rounds grow with the logarithm of a path's length in practice. Joins read written tables on both sides: Spark splits a
    hub's rows over tasks. An empty edge table gives no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialize(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        around = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("comp").alias("m"))
        near = labels.join(around, labels["id"] == around["u"]).select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        near = materialize(near)
        of = near.select(F.col("id").alias("root"), F.col("comp").alias("jump"))
        jumped = materialize(near.join(of, near["comp"] == of["root"]).select("id", "was", F.least("comp", "jump").alias("comp")))
        labels = jumped.select("id", "comp")
        if jumped.where("was <> comp").isEmpty():
            return labels
