"""Sharding by size-tiered compaction.

An arrival is written as a run of small immutable shards, one a task, without a
shuffle. Runs of similar size form a tier; once a tier has FAN runs they are merged
into one run of target-sized shards, again without a shuffle: the scan packs small
files into partitions of the target size. A manifest lists the live runs; each
version is a file of its own, put in place by one atomic rename that fails if the
version exists, so readers see one version or the next and writers can't both win.

The manifest grows with the logarithm of the data, since tiers hold less than FAN
runs each. Runs that a merge has replaced stay for GRACE versions, listed in the
manifest, so that readers of these versions can finish; what a failed merge or a writer
that died has left is deleted by :meth:`ShardStore.vacuum`. Only DataFrame reads and
writes touch the rows.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settings

#: Runs of a tier that are merged, bytes of a full shard, and the size that tiers start from.
FAN, TARGET, UNIT = 4, 128 << 20, 1 << 20
#: Versions for which replaced runs are kept.
GRACE = 1


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A table of immutable shards under ``root``, on a file system whose rename is atomic and fails if the target is there: HDFS and local disks, not plain object stores."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan: int = FAN, unit: int = UNIT):
        self.spark, self.root, self.target, self.fan, self.unit = spark, root.rstrip("/"), target, fan, unit
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- manifest ---------------------------------------------------------

    def _fs(self):
        path = self._path(self.root)
        return path.getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        folder = self._path(f"{self.root}/manifest")
        fs = self._fs()
        if not fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return max((int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"runs": [], "replaced": []}
        stream = self._fs().open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def runs(self, version: int | None = None) -> list[dict]:
        """The live runs (path, bytes, shards, rows) of a version, the latest by default."""
        return self._manifest(self.version() if version is None else version)["runs"]

    def _commit(self, runs: list[dict], base: int, replaced: list[dict] | None = None) -> int:
        """Put version ``base`` + 1 in place; :class:`Conflict` if it's there. ``replaced`` has path and the version that replaced it."""
        fs, new = self._fs(), base + 1
        folder = f"{self.root}/manifest"
        fs.mkdirs(self._path(folder))
        part = self._path(f"{folder}/.{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps({"version": new, "runs": runs, "replaced": replaced or []}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._fs().getUri(), self._conf)
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(option, 1)
        kinds[0] = option.NONE
        try:
            context.rename(part, self._path(f"{folder}/v{new:08d}.json"), kinds)
        except Exception as error:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"version {new}") from error
            raise
        return new

    # -- data -------------------------------------------------------------

    def _run(self, name: str) -> dict:
        sizes = [x.getLen() for x in self._fs().listStatus(self._path(f"{self.root}/{name}")) if x.getPath().getName().startswith("part-")]
        rows = self.spark.read.parquet(f"{self.root}/{name}").count() if sizes else 0
        return {"path": name, "bytes": sum(sizes), "shards": len(sizes), "rows": rows}

    def _write(self, df: DataFrame) -> dict:
        name = f"runs/{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.root}/{name}")
            return self._run(name)
        except Exception:
            self._delete(name)
            raise

    def _delete(self, name: str) -> None:
        self._fs().delete(self._path(f"{self.root}/{name}"), True)

    def append(self, df: DataFrame) -> int:
        """Write an arrival as a run and commit it; the new version. An empty arrival is a run of no rows."""
        return self._add(self._write(df))

    def _add(self, run: dict) -> int:
        return self._retry(lambda manifest, new: ([*manifest["runs"], run], manifest["replaced"]))

    def arrivals(self, df: DataFrame, part: Column, n: int) -> list[dict]:
        """Write the parts 0 to n - 1 of a table as runs, in one scan; they aren't committed yet."""
        stage = f"{self.root}/runs/.{uuid.uuid4().hex}"
        df.withColumn("__part", part).write.partitionBy("__part").parquet(stage)
        fs, out = self._fs(), []
        for k in range(n):
            source, name = self._path(f"{stage}/__part={k}"), f"runs/{uuid.uuid4().hex}"
            if fs.exists(source):
                fs.rename(source, self._path(f"{self.root}/{name}"))
                out.append(self._run(name))
            else:
                out.append(self._write(df.limit(0)))
        fs.delete(self._path(stage), True)
        return out

    def _retry(self, change) -> int:
        while True:
            base = self.version()
            try:
                runs, replaced = change(self._manifest(base), base + 1)
                keep = [x for x in replaced if x["at"] > base + 1 - GRACE]
                new = self._commit(runs, base, keep)
            except Conflict:
                continue
            for x in replaced:
                if x not in keep:
                    self._delete(x["path"])
            return new

    def tier(self, run: dict) -> int:
        return max(0, int(math.log(max(1, run["bytes"]) / self.unit, self.fan)) + 1 if run["bytes"] > self.unit else 0)

    def compact(self) -> int:
        """Merge every tier of ``fan`` runs or more, from the smallest, until none is left; the version."""
        packing = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        while True:
            tiers: dict[int, list[dict]] = {}
            for run in self.runs():
                tiers.setdefault(self.tier(run), []).append(run)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if full is None:
                return self.version()
            old = tiers[full]
            with settings(self.spark, packing):  # scans pack files into partitions of the target size
                new = self._write(self.read_runs(old))
            gone = [x["path"] for x in old]

            def change(manifest: dict, version: int, gone=gone, new=new) -> tuple[list[dict], list[dict]]:
                live = manifest["runs"]
                if not set(gone) <= {x["path"] for x in live}:
                    self._delete(new["path"])
                    raise RuntimeError("runs were merged by another writer")
                return [*(x for x in live if x["path"] not in gone), new], [*manifest["replaced"], *({"path": x, "at": version} for x in gone)]

            self._retry(change)

    def vacuum(self) -> list[str]:
        """Delete the runs that the latest manifest doesn't know, of writers that failed; none may be at work. Their names."""
        manifest, folder = self._manifest(self.version()), self._path(f"{self.root}/runs")
        known = {x["path"] for key in ("runs", "replaced") for x in manifest[key]}
        names = [f"runs/{x.getPath().getName()}" for x in self._fs().listStatus(folder)] if self._fs().exists(folder) else []
        stray = sorted(x for x in names if x not in known)
        for x in stray:
            self._delete(x)
        return stray

    def read_runs(self, runs: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{x['path']}" for x in runs]
        return self.spark.read.parquet(*paths)

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All rows and columns of a version, one of the last GRACE ones or the latest; with ``shard`` a further column of this name, the row's file.

        A column of the table's own that is called so is replaced by it.
        """
        runs = self.runs(version)
        if not runs:
            raise ValueError("nothing has been committed")
        df = self.read_runs(runs)
        return df.withColumn(shard, F.col("_metadata.file_name")) if shard else df


def shard(docs: DataFrame, root: str, arrivals: int = 4, target: int = TARGET, fan: int = FAN) -> ShardStore:
    """Append ``docs`` in ``arrivals`` parts (by a hash of the id), compacting after each.

    Rows are stored as they are, nulls, repeated rows and all columns included
    (but for one named ``__part``); an empty table gives a store of no rows. The table is
    scanned once.
    """
    store = ShardStore(docs.sparkSession, root, target, fan)
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(arrivals))
    for run in store.arrivals(docs, part, arrivals):
        store._add(run)
        store.compact()
    return store
