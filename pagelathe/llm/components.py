"""Connected components of an edge table, by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Both steps are an
aggregate with map-side combining and an equi-join, so a node with very many edges is never gathered
in one task. Each round is written to the shared folder, which cuts the lineage; nothing but two
numbers a round reaches the driver: no table is broadcast, as few bytes of such a file hold many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.runtime import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component): the smallest node that each node reaches.

    Only nodes with an edge to another node appear. Repeated edges, self-loops, either direction and
    an empty table are all fine; edges with a null end are ignored.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = materialize(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "cc")
    state = _state(now)
    while state[0]:
        n = 2 * state[0]  # no table of a round has more rows
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first: a join with an aggregate in the same stage could not be split for a hot node.
        least = materialize(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least", n)
        # large-star: the larger neighbours of a node go to its smallest neighbour
        large = both.where("b > a").join(least.hint("merge"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc-large", n)
        # small-star: a node's smaller neighbours, and the node, go to the smallest
        low_of = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "cc-low", n)
        small = large.join(low_of.hint("merge"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(low_of.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialize(small, "cc", n)
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
