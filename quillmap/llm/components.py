"""Connected components over an edge table, without collecting anything.

Every node holds a parent, at first itself. A round hooks each node and its
parent onto the smallest grandparent among the neighbours and then shortcuts
to the grandparent (the scheme known as FastSV), so long chains collapse in
a logarithmic number of rounds. All group-bys are minima, which combine on the
map side; the joins put a plain shuffle of edges against a table with one row
per node, so adaptive execution can split a hot node. Each round is cut with
a checkpoint in the shared folder and survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmap.llm.shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map the ends of integer edges to the smallest id they reach.

    Returns (node long, component long) with one row per node that has an edge.
    Self loops give the node alone, repeated edges count once, edges with a
    null end are ignored, an empty table gives an empty table.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    both = cut(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    tree = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("f")))
    total = _total(tree)
    while True:
        up = tree.select(F.col("node").alias("f"), F.col("f").alias("gp"))
        grand = tree.join(up, "f").select("node", "f", "gp")
        least = both.join(grand.select(F.col("node").alias("v"), "gp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("gp").alias("m"))
        hooked = grand.join(least, "node").select("node", "f", F.least("gp", "m").alias("m"))
        new = hooked.select("node", "m").union(hooked.select(F.col("f").alias("node"), "m"))
        new = cut(new.groupBy("node").agg(F.min("m").alias("f")))
        now = _total(new)
        tree = new
        if now == total:
            return tree.select("node", F.col("f").alias("component"))
        total = now


def _total(tree: DataFrame) -> object:
    """Parents only ever shrink, so an unchanged sum means an unchanged table."""
    return tree.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
