"""Connected components of links between numbers, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Tasks that the links of one node are dealt to.
SALTS = 16


def _star(links: DataFrame) -> DataFrame:
    """Link every node and its neighbours to the smallest of them; the links of a node with very many neighbours meet it in many tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    least = least.select("u", F.least("u", "m").alias("m"), salts.alias("salt"))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(least, ["u", "salt"]).drop("salt")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for each node of ``links(a, b)``, both bigint.

    Large and small stars alternate until no link changes. Every round is stored, so a
    lost executor costs one round. Self links and repeated links do no harm; no links: no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    loops = links.where("a = b").select(F.col("a").alias("node")).distinct()
    previous = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(small, "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return nodes.union(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
