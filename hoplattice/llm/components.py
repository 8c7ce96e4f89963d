"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplattice.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge; ``root`` is the smallest node of its component.

    ``edges`` has long columns ``a`` and ``b``. Each round replaces the edges by
    stars around ever smaller nodes and writes them to the shared folder, so a
    round never recomputes the ones before; rounds grow with the logarithm of the
    largest component's diameter. Nothing but a count and a checksum comes to the
    driver. Self-loops and repeated edges are harmless; no edges give no rows.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.union(current.select("b", "a"))
        # stored, so that both sides of the join are plain shuffles, which Spark may split at a hot node
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
        smallest = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = down.join(smallest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        current = stored(small.where("a <> b").distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
