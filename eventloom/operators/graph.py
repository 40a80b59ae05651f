"""Connected components of a link table, by min-label propagation with pointer jumping. Nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, label) for every id that has a link; label is the smallest id of its component.

    Each round a node takes the smallest label among itself and its neighbours, then its label's label, so chains shorten
    geometrically, and rounds end. A table in the shared folder ends each round; the one before it is deleted.

    Hubs and giant components are hot keys: what a round sends for a label or to a node is aggregated map-side first, and the joins' large partitions are split by Spark's skew join."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        new = labels.join(heard, "id").select("id", F.least("label", "heard").alias("near"), F.col("label").alias("old"))
        jump = new.select(F.col("id").alias("near"), F.col("near").alias("far"))
        before, labels = labels, stored(new.join(jump, "near").select("id", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("old")).alias("changed")), "labels")
        discard(before)
        if labels.where("changed").limit(1).count() == 0:
            discard(edges)
            out = labels.select("id", "label")
            out.stored_at = labels.stored_at  # the caller may discard it
            return out
