"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the smallest node of the component.

    Every round hooks each node that is still linked to its smallest neighbour, follows these
    pointers twice, and draws the links anew between what the nodes point to; a link within one
    node is done. The number of rounds grows with the logarithm of the longest chain. Each round is
    a written table, so a lost executor repeats no earlier round. Nulls in links are left out; an empty
    table gives no rows.
    """
    both = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))  # a < b: pointers only go down
        for _ in range(2):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            hooks = hooks.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
        hooks = materialize(hooks, "hooks")
        ups = hooks.select(F.col("node").alias("root"), "up")
        roots = materialize(roots.join(ups, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        a, b = (hooks.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b"))
        moved = moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = materialize(moved, "links")
    return roots
