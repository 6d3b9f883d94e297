"""Connected components by alternating large and small stars, all as joins and aggregations.

A round replaces each edge by edges to the least neighbour, first for larger neighbours, then for
smaller ones, until the edges are stars around the least node of each component. The rounds are
logarithmic in the longest path. A hub's edges are never gathered: its least neighbour is a
partial aggregation, and the join that brings it back is salted by the other end of the edge. To
smaller neighbours a node has few edges, one for each bucket or block that it was found in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tables

#: Parts that the edges of each node are dealt to. The other side of the join is copied as often, so these
#: are few; adaptive execution splits further what is still large.
SALTS = 4


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on `key`, of which `one` has each value few times and `many` any number of times:
    its rows of a value are dealt to SALTS parts by `by`."""
    copies = one.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node that isn't its component's least."""
    now = tables.saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, tables.saved(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "edges")
        before, state = state, _state(now)
        tables.done_with(last)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())
