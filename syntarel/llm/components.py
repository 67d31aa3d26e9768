"""Connected components of an edge table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b); component is the smallest id reachable.

    Each round takes the least label among a vertex's neighbours and then its
    label's label, so the rounds grow with the logarithm of a path's length.
    Nothing but counts reaches the driver; a round's table is written to the
    shared folder and dropped after the next. Loops and repeated edges do no
    harm; rows with a null are left out.
    """
    some = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # A vertex's smaller neighbours are tied to the least of them, which leaves hardly more edges than vertices.
    some = materialize(some.distinct(), "pairs")
    lowest = materialize(some.groupBy("a").agg(F.min("b").alias("m")), "lowest")
    least = some.join(lowest.hint("merge"), "a")
    few = least.select("a", F.col("m").alias("b")).union(least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    few = materialize(few, "few")
    both = materialize(few.union(few.select("b", "a")), "edges")
    release(some, lowest, few)
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), "component")
        new = materialize(lower, "labels")
        jumped = new.select("id", "component", F.col("next").alias("via")).join(new.select(F.col("id").alias("via"), F.col("next").alias("far")), "via")
        result = materialize(jumped.select("id", F.least("via", "far").alias("component"), (F.least("via", "far") < F.col("component")).alias("moved")), "labels")
        release(new)
        release(labels)
        labels = result
        if labels.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    release(both)
    out = labels.select("id", "component")
    out._syntarel_path = labels._syntarel_path
    return out
