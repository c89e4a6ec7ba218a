"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long); a root is its component's smallest node, and a row too.

    Edges point from the larger node to the smaller. In a round each node hooks to its smallest
    neighbour, hands its other neighbours on to that one, and skips to its parent's parent.
    Rows are dealt by the larger node, so the hub of a star is no key; only the skip joins on
    parents, as a plain equi-join that Spark can split. Each round's edges, at most as many as
    at first, go to the shared checkpoint folder.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        # written, so that both sides of the joins are plain exchanges, which Spark splits where one is hot
        parents = cut(links.groupBy("u").agg(F.min("v").alias("p")))
        handed = links.join(parents, "u").where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        above = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        skipped = parents.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("v"))
        links = cut(handed.unionByName(skipped).distinct())
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
