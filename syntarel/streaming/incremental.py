"""Structured Streaming over a folder of sources: changed files are parsed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import code
from ..sources import ast_table


def source_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """path, language, text of files as they appear below ``root``.

    Spark's file streams leave out names that begin with an underscore or a dot;
    a scan by ``read_sources`` has them.
    """
    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    files = stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("language", ast_table.language_of(F.col("path"), sensitive=True)).where("language is not null").select("path", "language", "text")


def units_stream(sources: DataFrame) -> DataFrame:
    """Syntax nodes as a stream; parsing keeps no state."""
    return ast_table.ast_nodes(sources)


def index_changes(sources: DataFrame, into: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Write the units of every batch of files below ``into``, one folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each
    file counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        units = code.code_units(ast_table.ast_nodes(batch))
        units.write.mode("overwrite").parquet(f"{into}/batch={number}")
        if then:
            then(units)

    return sources.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
