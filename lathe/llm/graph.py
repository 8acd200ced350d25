"""Connected components of a large graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, written


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id in links (a, b: longs without nulls).

    Each round maps a node to the neighbour, or itself, that comes first in an
    order drawn anew, and contracts the links; a constant share of the nodes is
    expected to go in each round. Every step is a join or a sum by key.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = written(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    turn = 0
    while not links.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("o"), c.alias("to"))  # noqa: B023, E731
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        first = written(first.select("a", F.least("m", order(F.col("a")))["to"].alias("to")), "first")
        to_a, to_b = first.withColumnRenamed("to", "na"), first.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        moved = links.join(to_a, "a").join(to_b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        relabelled = labels.join(first.select(F.col("a").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        old = (links, labels, first)
        links, labels = written(moved, "links"), written(relabelled, "labels")
        discard(*old)
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    out = written(labels.join(least, "label").select("id", "component"), "components")
    discard(links, labels)
    return out
