"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import checkpointed, release


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for each node that ``links`` (a, b) ties to another.

    Large stars tie the greater neighbours of every node to the least one, small stars the
    lesser ones; both only ever join what is joined already, and a number of rounds that
    grows with the logarithm of the links leaves one star for each component. Rounds work
    on tables of links; none is gathered. The least neighbours are written before they are
    joined, so that both sides of the join are shuffled for it and Spark can split the
    links of a node that has very many.

    Defined cases: links of a node with itself and null ends tie nothing; repeated links and
    both directions count once; without links there are no rows.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = checkpointed(links.where("a <> b").select(*pair("a", "b")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.where("v > u").join(least, "u").where("v <> m").select(*pair("v", "m")).distinct())
        release(edges, least)
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.where("u <> v").distinct())
        release(large, least)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v"), F.col("v"))).distinct()
        before = now
