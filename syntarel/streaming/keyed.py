"""State by key over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_by_key(stream: DataFrame, keys: list[str], order: list[str], values: list[str], into: str, checkpoint: str) -> StreamingQuery:
    """Keeps the row of each key that is last by ``order``, however late rows arrive; runs over what is there and ends.

    Spark holds one row a key in its state store. Each batch writes the keys that it has
    changed to a folder of its own below ``into``; a batch that is run again after a failure
    overwrites it, and rows that arrive twice change nothing. Null keys are one key.
    """
    last = stream.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"))

    def one(batch: DataFrame, number: int) -> None:
        batch.select(*keys, "last.*").write.mode("overwrite").parquet(f"{into}/batch={number}")

    return last.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, into: str, keys: list[str]) -> DataFrame:
    """The state that :func:`latest_by_key` has written: of each key the row of its last batch."""
    rows = spark.read.parquet(into)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")
