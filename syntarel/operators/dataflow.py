"""Reaching definitions and groupings of variable references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def reaching_definitions(refs: DataFrame, scope: list[str], name: str, is_use: Column, order: list, definition: Column) -> DataFrame:
    """Uses with ``reaching``, the latest ``definition`` before them, by (scope, name) and ``order``.

    An as-of join as a segmented scan: rows are dealt to ranges of (scope, name, order), so
    a hot scope lies in many ranges. The last definition is found inside of each
    range, and carried from range to range by one row a range and name. Uses that
    no definition reaches are left out; of rows equal in ``order`` definitions come first.
    """
    spark, keys = refs.sparkSession, [*scope, name]
    marked = refs.withColumn("__use", is_use).withColumn("__def", F.when(~is_use, definition))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(marked.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("__range", *keys).orderBy(*order, F.col("__use").cast("int"))
    last = F.last("__def", ignorenulls=True)
    local = dealt.withColumn("__near", last.over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # Every name has a row a range that holds some of it: at most one for each range.
    ends = dealt.where("__def is not null").groupBy("__range", *keys).agg(F.max_by("__def", F.struct(*order)).alias("__def"))
    held = dealt.select("__range", *keys).distinct().join(ends, ["__range", *keys], "left")
    before = last.over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    carried = held.withColumn("__far", before).where("__far is not null").select("__range", *keys, "__far")
    found = local.where("__use").join(carried, ["__range", *keys], "left").withColumn("reaching", F.coalesce("__near", "__far"))
    return found.where("reaching is not null").select(*refs.columns, "reaching")


def group_references(refs: DataFrame, by: list[str], order: str) -> DataFrame:
    """By group: its first ``order`` and all of them, ascending."""
    return refs.groupBy(*by).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(order)).alias("all"))
