"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Without the setting, a private one is chosen (and recorded in the session)
    where everything runs in one process, as in local tests. On a cluster that is
    an error: executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.syntarel.local.dir", None)
        if not path:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="syntarel-")
            spark.conf.set("spark.syntarel.local.dir", path)
    return path.rstrip("/")


#: Rows and bytes that a Python worker gets at once; a batch of whole texts then takes some tens of MB at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with ``values`` for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches within BATCH, so that workers' memory doesn't follow the texts."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/syntarel/{name}-{uuid.uuid4().hex}"


#: What :func:`materialize` has written within each open :func:`cleared`, of this thread alone.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def cleared(spark: SparkSession):
    """On leaving, delete all tables that :func:`materialize` has written meanwhile, those that results are read from included.

    What is given to the function that this yields stays, and is the outer one's to delete.
    """
    outer, own = _written.get(), []
    token = _written.set((*outer, own))

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df._syntarel_path)
        if outer:
            outer[-1].append(df._syntarel_path)
        return df

    try:
        yield keep
    finally:
        _written.reset(token)
        for path in own:
            delete_path(spark, path)


def materialize(df: DataFrame, name: str, plain: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Parquet is used rather than ``checkpoint()`` since it is compressed and
    keeps column pruning; a lost executor loses none of it. The write's shuffle
    files go as soon as it is done, since nothing else reads them. Columns in
    ``plain`` hold hashes, which no dictionary makes smaller.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._syntarel_path = path
    if _written.get():
        _written.get()[-1].append(path)
    return out


def release(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for each; they must not be read again."""
    for df in frames:
        path = getattr(df, "_syntarel_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def id_text(col: str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(modulus: int, col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo ``modulus``."""
    return F.crc32(id_text(col)) % F.lit(modulus)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a single row put beside every row of ``df``."""
    return df.withColumn("__one", F.lit(0)).join(F.broadcast(one.limit(1).withColumn("__one", F.lit(0))), "__one").drop("__one")
