"""Connected components of a table of links, by repeated contraction.

Every round each component hooks onto its smallest neighbour, the hooks are shortened by pointer jumping, and the
links are rewritten to the new components until none joins two of them. A node's own links never have to meet in one
task: the minimum is a partially aggregated group, and the joins on a node with many links can be split by Spark.
Each round ends in written tables, so lost executors cost a re-read. Only the question "is any link left" reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import cut

JUMPS = 2


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is the smallest node reachable.

    Links to oneself, repeated links and links with a null end add nothing; an empty table gives an empty result.
    ``files``: the most files of each table of a round, as for :func:`cut`.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), files)
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("to")).select("c", F.least("c", "to").alias("to"))
        for _ in range(JUMPS):
            hooks = cut(hooks, files)
            next_hop = hooks.select(F.col("c").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(next_hop, "to").select("c", F.col("further").alias("to"))
        hooks = cut(hooks, files)
        labels = cut(labels.join(hooks.withColumnRenamed("c", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), files)
        to_a = hooks.select(F.col("c").alias("a"), F.col("to").alias("new_a"))
        to_b = hooks.select(F.col("c").alias("b"), F.col("to").alias("new_b"))
        moved = edges.join(to_a, "a").join(to_b, "b").where(F.col("new_a") != F.col("new_b"))
        edges = cut(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), files)
    return labels
