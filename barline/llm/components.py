"""Connected components of a table of links, by repeated contraction.

Every round points each node at its smallest neighbour, jumps once, and contracts the links to the
new roots. All state stays in Spark; each round is cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import cut, dealt_join


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the same for all nodes that links connect.

    Self links and repeated links are harmless, null ends are ignored; an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    links = cut(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = True
    while not links.isEmpty():
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        # very many nodes may point at one
        up = near.select(F.col("v").alias("p"), F.col("p").alias("pp")).join(near.groupBy("p").count(), "p")
        step = cut(dealt_join(near, up, ["p"], "v", "left").select("v", F.coalesce("pp", "p").alias("p")))
        if first:
            labels, first = step.select(F.col("v").alias("node"), F.col("p").alias("root")), False
        else:
            onward = step.withColumnRenamed("v", "root").join(labels.groupBy("root").count(), "root")
            labels = cut(dealt_join(labels, onward, ["root"], "node", "left").select("node", F.coalesce("p", "root").alias("root")))
        of_a = step.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        of_b = step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        links = links.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        links = cut(links.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels
