"""Connected components of a link table by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import cut


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``links (a, b)``; the root is the smallest id that can be reached.

    Every round lets each vertex point at its smallest neighbour (never a larger one, so there are no cycles), shortens
    the pointers by jumping until they end at roots, and keeps only the links between different roots. All tables are
    written, so a lost executor costs a re-read. No links give an empty table.
    """
    edges = cut(links.where("a <> b").select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("nb")).select("id", F.least("id", "nb").alias("root")))
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("top"))
            jumped = cut(hooks.join(up, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            hooks = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("id").alias("root"), F.col("root").alias("top"))
            labels = cut(labels.join(step, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
        ends = hooks.withColumnsRenamed({"id": "a", "root": "ra"}), hooks.withColumnsRenamed({"id": "b", "root": "rb"})
        edges = cut(edges.join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return labels if labels is not None else links.sparkSession.createDataFrame([], "id long, root long")
