"""Files below a folder, listed and read in tasks.

A round lists the folders that the last one has found, each folder in a task of its
choice, and writes what lies in them; there are as many rounds as levels. Spark's own
readers leave out empty files and names that begin with an underscore or a dot; these are
listed like all others. Only the number of folders left and of bytes reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch

#: Schemes that tasks open by themselves, with the name that they know each by, and the credentials of their machines.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
ENTRIES = "path string, folder boolean, bytes long, modified timestamp"
#: Bytes of texts that a task hands on at once, rows of a listing likewise, and folders that a task of the first rounds is dealt.
_BATCH_BYTES, _BATCH_ROWS, _FOLDERS = 8 << 20, 10_000, 64


def address(spark: SparkSession, root: str) -> str | None:
    """The folder's full address as tasks open it, or null if its file system is Spark's alone or ``root`` is a file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toUri()
    scheme = SCHEMES.get(uri.getScheme())
    if not scheme or (system.exists(path) and system.getFileStatus(path).isFile()):
        return None
    return f"{scheme}://{uri.getRawAuthority() or ''}{uri.getRawPath().rstrip('/')}"


def listed(spark: SparkSession, at: str, skip: Iterable[str] = ()) -> DataFrame:
    """path (below the address ``at``), folder, bytes, modified of all files, those below a name in ``skip`` left out.

    One call lists a folder's own entries. Times are cut to milliseconds. An empty
    folder has no rows; one that is missing is an error. Hidden ``.crc`` files, the
    checksums of local file systems, count as none.
    """
    skipped = set(skip)

    def entries(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(at)
        columns = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
        for batch in batches:
            for above in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{above}".rstrip("/") or "/"))
                rows = [(f"{above}/{x.base_name}".lstrip("/"), x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1_000_000 * 1000) for x in found if not (x.base_name in skipped or (x.base_name[0] == "." and x.base_name.endswith(".crc")))]
                for i in range(0, len(rows), _BATCH_ROWS):
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows[i : i + _BATCH_ROWS], strict=True), columns, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "folder", "bytes", "modified"])

    base, level = scratch(spark, "listing"), spark.createDataFrame([("",)], "path string")
    folders, rounds = 1, []
    while folders:
        to = f"{base}/level-{len(rounds)}"
        level.repartition(max(1, -(-folders // _FOLDERS)), "path").mapInArrow(entries, ENTRIES).write.parquet(to)
        rounds.append(to)
        level = spark.read.schema(ENTRIES).parquet(to).where("folder").select("path")
        folders = level.count()
    return spark.read.schema(ENTRIES).parquet(*rounds).where("not folder")


def contents(files: DataFrame, at: str) -> DataFrame:
    """Adds text to files (path, bytes and others) below ``at``; bytes that aren't UTF-8 become U+FFFD.

    Files are dealt by path to as many tasks as their bytes fill partitions of
    ``spark.sql.files.maxPartitionBytes``. One that has gone meanwhile is an error
    unless ``spark.sql.files.ignoreMissingFiles`` says otherwise.
    """
    from pyspark.sql import types as T

    spark = files.sparkSession
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    lenient = spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true"
    schema = T.StructType([*files.schema.fields, T.StructField("text", T.StringType())])
    place = files.columns.index("path")

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(at)
        for batch in batches:
            taken, texts, held = [], [], 0
            paths = batch.column(place).to_pylist()
            for i, path in enumerate(paths):
                try:
                    with system.open_input_file(f"{base}/{path}") as file:
                        texts.append(file.read().decode("utf-8", "replace"))
                    taken.append(i)
                    held += len(texts[-1])
                except FileNotFoundError:
                    if not lenient:
                        raise
                if taken and (held >= _BATCH_BYTES or i + 1 == len(paths)):
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(taken)).columns, pa.array(texts, pa.string())], names=schema.names)
                    taken, texts, held = [], [], 0

    total = files.agg(F.sum("bytes")).first()[0] or 0
    return files.repartition(max(1, -(-total // most)), "path").mapInArrow(read, schema)
