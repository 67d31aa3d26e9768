"""Where intermediate tables go, and tables in buckets that joins read without a shuffle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str = "project") -> str:
    """A fresh folder below the shared one (``spark.checkpoint.dir``), or a local one where all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='syntarel-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read from it; a lost executor loses none of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """A Parquet table whose files hold the rows of one bucket each, by a hash of ``keys``.

    A join or grouping on these keys reads it as it lies. It is known to the
    session's catalog under a name of its own until :meth:`forget`; its folder stays,
    and ``Buckets`` of the same folder, keys and number read it again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], number: int):
        self.spark, self.path, self.keys, self.number = spark, path, list(keys), number
        self._name = f"syntarel_{uuid.uuid4().hex}"
        names = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"create table {self._name} ({schema}) using parquet clustered by ({names}) into {number} buckets location '{path}'")

    def append(self, df: DataFrame, dealt: bool = False) -> int:
        """Adds rows, a file a bucket; how many there were. ``dealt``: the plan deals them by the keys anyway."""
        seen = Observation()
        columns = self.spark.table(self._name).columns
        rows = df.select(*columns)
        counted = (rows if dealt else rows.repartition(self.number, *self.keys)).observe(seen, F.count("*").alias("n"))
        counted.write.insertInto(self._name)
        return seen.get["n"]

    def read(self) -> DataFrame:
        return self.spark.table(self._name)

    def forget(self) -> DataFrame:
        """Takes the name out of the catalog; the rows as a plain table."""
        df = self.read()
        self.spark.sql(f"drop table {self._name}")
        return self.spark.read.schema(df.schema).parquet(self.path)
