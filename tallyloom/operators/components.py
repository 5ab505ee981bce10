"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.shared import cut_at, remove


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(vertex, component): the smallest vertex that can be reached, for every vertex of edges (a, b).

    Each round takes the smallest label among a vertex's neighbours, hands it to the vertex that was the label so far (so all
    that have this label get it, not only the neighbours), then takes the label of that label. Labels are written to the shared folder each round, and those of the round before are deleted when
    the new ones are whole; the driver sees one count.
    """
    spark = edges.sparkSession
    both, links = cut_at(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels, path = cut_at(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("c")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        step = labels.join(near, "a").select("a", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        handed = step.groupBy(F.col("old").alias("a")).agg(F.min("c").alias("handed"))
        step = step.join(handed, "a", "left").select("a", "old", F.least("c", F.coalesce("handed", "c")).alias("c"))
        far = labels.join(handed, "a").select(F.col("a").alias("c"), F.least("c", "handed").alias("far"))  # every label is a vertex
        before = path
        new, path = cut_at(step.join(far, "c", "left").select("a", F.least("c", F.coalesce("far", "c")).alias("c"), "old"), "labels")
        remove(spark, before)
        changed = new.filter("c <> old").limit(1).count()
        labels = new.select("a", "c")
        if not changed:
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    remove(spark, links)
    return labels.select(F.col("a").alias("vertex"), F.col("c").alias("component"))
