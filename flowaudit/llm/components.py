"""Connected components of a table of links, by repeated contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): nodes with equal labels are connected; only linked nodes come out.

    In a round each node hops to the neighbour (or itself) that comes first in the order of a
    hash; links are rewritten to where their ends went. In a hash order a constant share of the
    nodes goes per round, so there are O(log n) rounds over shrinking tables. The hops are
    composed at the end. Nothing is collected; minima are partially aggregated, and joins have
    one row per node on one side, so a hub with many links can be split.
    """
    def rank(c):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))

    e = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hops = []
    while True:
        e = checkpoint(e)
        if hops and e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.min(rank("b")).alias("m")) \
            .select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("to"))
        hop = checkpoint(hop)
        hops.append(hop)
        to_a, to_b = (hop.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        e = e.join(to_a, "a").join(to_b, "b").filter("to_a <> to_b") \
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
    out = hops[0].withColumnRenamed("to", "label")
    for hop in hops[1:]:
        out = out.join(hop.withColumnRenamed("node", "label"), "label", "left") \
            .select("node", F.coalesce("to", "label").alias("label"))
    return out
