"""Ranges: what lies inside of them, and their unions, without a row for every point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def inside(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, width: int = 256) -> DataFrame:
    """Pairs of ``ranges`` and ``points`` of equal ``by`` with low <= at <= high (integers); columns of both but for the points' ``by``.

    The axis is cut into bins of ``width``: a range has a row for every bin that it
    meets, a point is in one, so the join is an equality (on ``by`` and bin, which
    spreads a hot ``by``) with a residue. Nested ranges make depth x points / width more
    rows. Null bounds, places and ``by`` meet nothing.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    left = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(bins))
    right = points.withColumn("__bin", F.floor(F.col(at) / width))
    return left.join(right, [*by, "__bin"]).where(F.col(at).between(F.col(low), F.col(high))).drop("__bin")


def union_ranges(df: DataFrame, by: list[str], low: str, high: str, apart: int = 1) -> DataFrame:
    """``by``, ``low``, ``high`` and ``ranges`` (how many) of the unions of integer ranges that overlap or lie ``apart`` or less from each other.

    A sweep: a range begins a union if it starts past all ends before it. The
    rows are dealt to ranges of (by, low), so a hot ``by`` lies in many of these; the
    greatest end and the number of unions so far are carried from one to the next by
    one row for each. Ranges with a null bound, or that end before they start, are left out; ``by`` may be null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"k{k}" for k in range(len(by))]
    plain = df.where(F.col(low) <= F.col(high)).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(low).cast("long").alias("a"), F.col(high).cast("long").alias("b"))
    dealt = written(plain.repartitionByRange(parts, *keys, "a").withColumn("part", F.spark_partition_id()), "sweep")

    def carried(rows: DataFrame, value, name: str) -> DataFrame:
        """Adds ``value`` of all earlier parts of a row's key."""
        own = rows.groupBy(*keys, "part").agg(value(F.col(name)).alias("own"))
        before = value("own").over(W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        far = own.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("part").alias("o_part"), before.alias("far"))
        same = F.col("part") == F.col("o_part")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"o_{k}"))
        return rows.join(far, same).drop("o_part", *[f"o_{k}" for k in keys])

    inside_ = W.partitionBy("part", *keys).orderBy("a", "b")
    near = F.max("b").over(inside_.rowsBetween(W.unboundedPreceding, -1))
    swept = carried(dealt, F.max, "b").withColumn("end", F.greatest(near, "far")).withColumn("begins", (F.col("end").isNull() | (F.col("a") > F.col("end") + apart)).cast("long")).drop("far", "end")
    swept = written(swept, "sweep")
    # Rows alike in both bounds may change places: the one that begins comes first.
    upto = W.partitionBy("part", *keys).orderBy("a", "b", F.desc("begins")).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = carried(swept, F.sum, "begins").withColumn("number", F.sum("begins").over(upto) + F.coalesce("far", F.lit(0)))
    found = numbered.groupBy(*keys, "number").agg(F.min("a").alias("low"), F.max("b").alias("high"), F.count("*").alias("ranges"))
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.col("low").alias(low), F.col("high").alias(high), "ranges")
