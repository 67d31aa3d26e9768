"""Order-dependent operators without a single-partition window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

#: Ranges at least, rows of a range on average beyond that, and ranges at most: the cuts between them are part of a plan (1 MB).
LEAST_RANGES, RANGE_ROWS, MOST_RANGES = 4096, 1 << 16, 1 << 16


def splitters(df: DataFrame, key: str, rows: int, seed: int = 17) -> list[int]:
    """Sampled keys, ascending, repeated if the sample holds a key repeatedly: about LEAST_RANGES, or one in RANGE_ROWS rows if that is more, MOST_RANGES at most."""
    wanted = min(MOST_RANGES, max(LEAST_RANGES, rows / RANGE_ROWS))
    sample = df.select(F.col(key).cast("long").alias("k")).where("k is not null").sample(min(1.0, wanted / max(1, rows)), seed)
    return sorted(r[0] for r in sample.collect())


def range_of(key: Column, cuts: list[int], spread: Column | None = None) -> Column:
    """Number of the range, from 0, that a key falls into: how many of the ascending ``cuts`` are below it.

    A key that several cuts share has as many ranges; its rows are dealt to them
    by ``spread``, a long, in its order. Found by halving a constant array.
    """
    if not cuts:
        return F.when(key.isNotNull(), F.lit(0))
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")

    def count(before: Callable[[Column, Column], Column]) -> Column:
        def halve(s: Column, _: Column) -> Column:
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            goes_on = s["low"] < s["high"]
            right = goes_on & before(F.get(table, middle), key)
            return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right | ~goes_on, s["high"]).otherwise(middle).alias("high"))

        start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve)["low"]

    first = count(lambda cut, k: cut < k)
    if spread is None or len(set(cuts)) == len(cuts):
        return F.when(key.isNotNull(), first)
    ranges = count(lambda cut, k: cut <= k) - first + 1
    # ``first`` lies before the cuts that equal the key, so that its rows take the ranges between those.
    return F.when(key.isNotNull(), F.when(ranges <= 2, first).otherwise(first + _part(spread, ranges)))


def _part(spread: Column, parts: Column) -> Column:
    """Which of so many equal parts of the longs a value is in, in order."""
    share = spread.cast("double") / F.lit(float(1 << 64)) + 0.5
    return F.least(F.floor(share * parts).cast("int"), parts - 1)


def with_ordinal(df: DataFrame, key: str, into: str = "ordinal") -> DataFrame:
    """Adds the row's number (from 0) by a unique ``key``; null keys come last.

    Spark deals the rows to ranges of the key; they are written so that all that follows
    sees the same ranges. The ranges' row counts, one row each, are summed up in
    one place, and rows are numbered inside of their range. ``into`` is replaced.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.drop(into).repartitionByRange(ranges, F.asc_nulls_last(key)).withColumn("__range", F.spark_partition_id()), "ordinals")
    before = F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(F.asc_nulls_last(key))) - 1
    return dealt.join(F.broadcast(offsets), "__range").withColumn(into, F.col("__before") + inside).drop("__range", "__before")


def batches(df: DataFrame, key: str, size: int, into: str = "batch") -> DataFrame:
    """Adds the number of the fixed-size batch that a row falls into."""
    return with_ordinal(df, key, "__ordinal").withColumn(into, F.floor(F.col("__ordinal") / size)).drop("__ordinal")


def dedup_last_wins(df: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """One row a key: its first place in ``order`` and the values of its last row."""
    return df.groupBy(*key).agg(F.min(order).alias("first_position"), *[F.max_by(v, order).alias(v) for v in values])


def distinct_first_seen(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the least ``order`` at which they appear."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("first_seen"))
